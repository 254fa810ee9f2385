import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenlake.functions import alphabet
from tokenlake.functions import text as tx
from tokenlake.operators import merges, scoring, trainers


def signal_rows(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(3)], "doc_id long, text string, lang string")
    rows = tx.byte_rows(docs, "doc_id", "lang")
    return rows.withColumn("signal", (F.col("byte") * 37 % 11).cast("double"))


def test_span_names():
    for name in ("20746865", "##61"):
        assert trainers.span_name(trainers.hex_name(name)) == name
    assert trainers.hex_name("2061") == alphabet.SPACE_CHAR + "a"


def test_span_trainer_fills_the_vocabulary(spark):
    names = trainers.train_spans(signal_rows(spark), 776, proportion=0.996)
    assert names[:770] == alphabet.span_vocab() and len(names) == len(set(names)) == 776
    spans_only = trainers.train_spans(signal_rows(spark), 776, proportion=0.996, languages=["en"])
    assert set(names[770:773]) & set(spans_only[770:])


def test_mutual_information_merges_agree_on_both_ways(spark):
    words = spark.createDataFrame([(" the", 40), (" then", 30), (" zq", 25), ("t", 90), ("aaaa", 22)], "pretoken string, n long")
    ways = [merges.train(words, alphabet.SIZE + 5, driver_words=d, measure=merges.MUTUAL_INFORMATION) for d in (0, 100)]
    assert ways[0] == ways[1] and len(ways[0]) == 5
    assert (ways[0][0].left, ways[0][0].right) == (alphabet.BYTE_ID[ord("z")], alphabet.BYTE_ID[ord("q")])
    with pytest.raises(ValueError):
        merges.train(words, 300, measure="other")


def test_existing_tokens_keep_their_identifier(spark):
    table = spark.createDataFrame([([0, 1, 2], 5), ([0, 1], 1)], "ids array<int>, n long")
    for driver_words in (0, 100):
        growth = merges.Growth(4, 5, ["a", "##b", "##c", "ab"])
        found = merges.grow(table, growth, driver_words=driver_words)
        assert [(m.left, m.right, m.joined, m.num_merges) for m in found] == [(0, 1, 3, 6), (3, 2, 4, 5)]
        assert growth.names == ["a", "##b", "##c", "ab", "abc"]


class Toy:
    context, stride = 8, 3

    def score(self, windows):
        return [{s: w.astype(float) + k for k, s in enumerate(scoring.SIGNALS)} for w in windows]


def test_windows_score_each_place_once(spark):
    cuts = scoring.strided(np.arange(20), 8, 3)
    assert cuts[0] == (0, 8, 0) and [c[2] for c in cuts[1:]] == [c[1] for c in cuts[:-1]] and cuts[-1][1] == 20
    df = spark.createDataFrame([(1, list(range(20))), (2, []), (3, None)], "doc_id long, input_ids array<int>")
    got = {r.doc_id: r for r in scoring.score_documents(df, Toy()).collect()}
    assert got[1].surprisal == [float(i) for i in range(20)] and got[1].eos_nll[5] == 8.0 and got[2].entropy == got[3].entropy == []


@pytest.mark.parametrize("gone", [True, False])
def test_entry_without_the_training_data_folders(tmp_path, gone):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", *(["llm", "corpus_pipeline.py"] if gone else [])))
    if not gone and not (copy / "tokenlake" / "llm").exists():
        pytest.skip("the folders are gone already")
    code = "import __spark_entry__ as e; q = set(e.queries()); assert set(e.oracle_sql()) <= q; print(len(q), any(x.startswith('op1_') for x in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, there = out.stdout.split()
    assert int(n) > 50 and there == str(not gone)
