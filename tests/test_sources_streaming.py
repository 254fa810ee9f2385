import json

from tokenlake.sources import io
from tokenlake.streaming import counters


def test_delimited_lines_and_json(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("w\trt\nab\t1.5\n")
    assert io.read_delimited(spark, str(tmp_path / "a.tsv"), "\t").first().rt == 1.5
    (tmp_path / "b.csv").write_text("A, B\n1, 2\n")
    assert io.read_delimited(spark, str(tmp_path / "b.csv"), ", ").first().B == 2
    (tmp_path / "l.txt").write_text("  x \n\ny\n")
    assert [r.value for r in io.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["x", "", "y"]
    assert io.read_path_list(spark, str(tmp_path / "l.txt")) == ["x", "y"]
    (tmp_path / "c.jsonl").write_text(json.dumps([{"a": 1}, {"a": 2}]) + "\n")
    assert sorted(r.a for r in io.read_jsonl(spark, str(tmp_path / "c.jsonl"), "a int").collect()) == [1, 2]
    io.write_jsonl_as_parquet(spark, str(tmp_path / "c.jsonl"), "a int", str(tmp_path / "c.parquet"))
    assert spark.read.parquet(str(tmp_path / "c.parquet")).count() == 2


def test_configs_and_corpora(spark, tmp_path):
    df = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, text string")
    io.write_config(df, str(tmp_path / "r"), "c", "train")
    io.write_config(df.limit(1), str(tmp_path / "r"), "c", "val")
    io.write_config(df.limit(1), str(tmp_path / "r"), "c", "train")
    assert io.read_config(spark, str(tmp_path / "r"), "c", "train").count() == 1
    assert io.read_config(spark, str(tmp_path / "r"), "c", "val").count() == 1
    io.write_corpus(df, str(tmp_path / "w" / "part"), 1)
    assert io.read_documents(spark, str(tmp_path / "w"), glob="*/*.parquet").count() == 2
    assert io.list_files(spark, str(tmp_path / "w")).count() >= 2


def test_vocabulary_files_load_in_the_public_library(tmp_path):
    from tokenizers import Tokenizer

    from tokenlake.functions import alphabet

    vocab = [*alphabet.byte_vocab(), "ab"]
    io.write_vocabulary(str(tmp_path), vocab, [("a", "b")])
    assert Tokenizer.from_file(str(tmp_path / "tokenizer.json")).encode("ab").tokens == ["Ġ", "ab"]


def test_streamed_counts_and_quota(spark, tmp_path):
    schema = "doc_id long, lang string, text string"
    spark.createDataFrame([(i, "en", " abcd") for i in range(6)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert [(r.pretoken, r.n) for r in run(counters.pretoken_counts(stream()), "words", "complete")] == [(" abcd", 6)]
    assert sorted(r.doc_id for r in run(counters.language_quota(stream(), 12), "quota", "append")) == [0, 1, 2]
