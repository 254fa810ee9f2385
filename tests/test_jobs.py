import json

from tokenlake import jobs


def test_jobs_end_to_end(spark, tmp_path):
    rows = [(i, "the cat sat on the mat with the other cat", "en" if i % 2 else "fr") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "c"))
    run = lambda *a: jobs.main([str(x) for x in a])
    run("tokenize", tmp_path / "c", tmp_path / "tok")
    first = spark.read.parquet(str(tmp_path / "tok")).first()
    assert first.num_tokens == len(first.input_ids) == len(first.pre_token_boundaries)
    run("subset", tmp_path / "c", tmp_path / "sub", "--budget", 50)
    assert spark.read.parquet(str(tmp_path / "sub")).count() == 2
    run("train-merges", tmp_path / "c", tmp_path / "v", "--sizes", "260,264", "--threshold", 2)
    assert len(json.loads((tmp_path / "v/260/vocab.json").read_text())) == 260
    run("statistics", tmp_path / "c", tmp_path / "s", "--tokenizers", f"{tmp_path}/v/260,{tmp_path}/v/264", "--by-language")
    run("statistics", tmp_path / "c", tmp_path / "s", "--tokenizers", f"{tmp_path}/v/260", "--by-language")
    got = spark.read.option("header", True).csv(str(tmp_path / "s")).collect()
    assert sorted((r.lang, r.tokenizer_name) for r in got) == [("en", "260"), ("en", "264"), ("fr", "260"), ("fr", "264")]
    assert len({float(r.fertility) for r in got if r.lang == "en"}) == 2


def test_scoring_and_signal_trainers(spark, tmp_path):
    rows = [(i, "the cat sat on the mat with the other cat", "en" if i % 2 else "fr") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([(90, "the new cap", "en"), (91, "", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "d"))
    run = lambda *a: jobs.main([str(x) for x in a])
    run("train-ngrams", tmp_path / "c", tmp_path / "n", "--order", 3)
    run("score", tmp_path / "d", tmp_path / "s", "--ngrams", tmp_path / "n", "--order", 3)
    got = spark.read.parquet(str(tmp_path / "s")).orderBy("pos").collect()
    assert bytes(r.byte for r in got) == b" the new cap" and all(r.surprisal >= 0 and r.space_nll > 0 for r in got)
    run("train-thresholds", tmp_path / "c", tmp_path / "t", "--ngrams", tmp_path / "n", "--order", 3, "--sizes", "701,703", "--threshold", 2)
    assert len(json.loads((tmp_path / "t/701/vocab.json").read_text())) == 701 and (tmp_path / "t/703/stats.csv").read_text().startswith("num_moves,")
    run("train-merges", tmp_path / "c", tmp_path / "m", "--sizes", "262", "--threshold", 2, "--measure", "mutual-information")
    assert (tmp_path / "m/262/merges_data.csv").read_text().count("\n") == 5
    for name in ("a", "b"):
        run("bits-per-byte", tmp_path / "c", tmp_path / "b", "--ngrams", tmp_path / "n", "--order", 3, "--name", name)
    rows = spark.read.parquet(str(tmp_path / "b/documents")).collect()
    assert len(rows) == 8 and all(r.a == r.b > 0 for r in rows)
