import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tokenlake.llm import common, linededup, sql


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, _dh2 string, drops int, n int")


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.execute(sql.LINE_DEDUP).fetchall(), key=str)


def test_random_lines_match_sql(spark):
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "eta9", "", "mu", "é", "x1"]
    stock = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 6, 9, 12, 14, 31, 40]))) for _ in range(25)]

    def line():
        parts = rng.choice(stock).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            parts[rng.randrange(len(parts))] = "".join(rng.choice("pqrs") for _ in range(5))
        return " " * rng.randrange(2) + " ".join(parts)

    rows = [(i, "\n".join(rng.choice(["", line(), line(), line()]) for _ in range(rng.randrange(1, 9)))) for i in range(80)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(None, rows[3][1] + "\nmore"), (None, None), (200, "")]
    got = linededup.dedup(frame(spark, rows)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted((tuple(r) for r in got), key=str) == by_sql(rows)
    assert sum(r.n_dropped for r in got) > 20


def test_several_fields_short_lines_and_runs(spark):
    name = lambda i, k: "".join(chr(97 + (i * 7 + k * 3 + j) % 26) for j in range(6))
    notice = lambda i: f"this page was printed by {name(i, 0)} for the members of the club in {name(i, 1)} on their visit"
    short = lambda i: f"written and read by {name(i, 2)} alone"
    rows = [(i, "\n".join([f"own {name(i, 5)}", notice(i), short(i)])) for i in range(3)]
    got = {r.doc_id: r for r in linededup.dedup(frame(spark, rows)).collect()}
    assert got[0].n_dropped == 0 and [got[i].text for i in (1, 2)] == [f"own {name(i, 5)}" for i in (1, 2)]
    run = "\n".join(" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(8)) for i in range(7))  # 56 words in short lines
    two = {r.doc_id: r.text for r in linededup.dedup(frame(spark, [(1, "mine\n" + run), (2, "yours\n\n" + run)])).collect()}
    assert two == {1: "mine\n" + run, 2: "yours\n"}


def test_very_many_lines_and_text_ids(spark):
    many = "\n".join(f"line {chr(97 + i % 26) * (1 + i // 26 % 9)} of many" for i in range(100_000))
    rows = [(1, many), (2, many + "\nlast"), (3, "first\n" + many)]
    got = {r.doc_id: r for r in linededup.dedup(frame(spark, rows)).collect()}
    assert got[1].n_dropped == 0 and got[2].text == "last" and got[3].text == "first" and got[3].n_lines == 100_001
    texts = spark.createDataFrame([("b", "p q r\nb"), ("a", "p q r\na"), ("c", "p q r\nc")], "doc_id string, text string")
    assert {r.doc_id: r.text for r in linededup.dedup(texts).collect()} == {"a": "p q r\na", "b": "b", "c": "c"}
    assert linededup.dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_hot_keys_join_as_any_other(spark, how):
    rows = spark.range(6000).select("id", F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 500).alias("key"))
    table = spark.createDataFrame([(7, "hot"), (8, "cold"), (8, "twice"), (9999, "none")], "key int, name string")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    got = common.join_hot(rows, table, "key", F.col("id"), counts, how)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(table, "key", how).collect()), key=str)
