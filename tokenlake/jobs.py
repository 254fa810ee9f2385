"""Jobs for spark-submit: ``python -m tokenlake.jobs COMMAND --help``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions import alphabet
from tokenlake.functions import text as tx
from tokenlake.operators import encoders, incremental, merges, ngrams, ordered, stats, subsets, trainers
from tokenlake.sources import io


def _corpus(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = spark.read.parquet(a.corpus).withColumnRenamed(a.id, "doc_id").withColumnRenamed(a.text, "text")
    return rows if not a.rows else ordered.head(rows, "doc_id", a.rows)


def tokenize(spark: SparkSession, a: argparse.Namespace) -> None:
    """Byte-level encoding of a corpus, with pre-token boundaries, as zstd Parquet."""
    ids = tx.byte_ids(F.col("text"))
    rows = _corpus(spark, a).where(F.col("text").isNotNull())
    keep = [c for c in ("doc_id", "lang") if c in rows.columns]
    out = rows.select(*keep, ids.alias("input_ids"), subsets.byte_length(F.col("text")).cast("int").alias("num_tokens"), tx.boundary_flags(F.col("text")).alias("pre_token_boundaries"))
    io.write_corpus(out, a.out)


def subset(spark: SparkSession, a: argparse.Namespace) -> None:
    """Token-budget subset by language."""
    io.write_corpus(subsets.language_quota(_corpus(spark, a), a.languages.split(","), a.budget, a.shift), a.out)


def train_ngrams(spark: SparkSession, a: argparse.Namespace) -> None:
    """n-gram table with interpolated probabilities."""
    table = io.materialise(ngrams.counts(_corpus(spark, a), list(range(1, a.order + 1))), "ngrams")
    ngrams.probabilities(table).write.partitionBy("order").parquet(a.out)


def train_merges(spark: SparkSession, a: argparse.Namespace) -> None:
    """Merge vocabularies of several sizes: one run to the largest, of which the others are prefixes."""
    sizes = sorted(int(s) for s in a.sizes.split(","))
    found = merges.train(tx.dictionary(_corpus(spark, a)), sizes[-1], a.threshold, not a.standard, measure=a.measure)
    names = merges.tokens(found)
    for size in sizes:
        part = [(names[m.left], names[m.right], names[m.joined], m.num_merges) for m in found if m.joined < size]
        io.write_vocabulary(os.path.join(a.out, str(size)), names[:size], [m[:2] for m in part], merge_rows=part)


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    """Surprisal, entropy, space and end-of-text signals of every byte of a corpus, by an n-gram table of any corpus."""
    ngrams.score_corpus(_corpus(spark, a), spark.read.parquet(a.ngrams), a.order).write.parquet(a.out)


def bits_per_byte(spark: SparkSession, a: argparse.Namespace) -> None:
    """Bits per byte of each document's head of ``context`` bytes, and their mean, by an n-gram table; a column a model, side by side."""
    docs = _corpus(spark, a).where(F.col("text").isNotNull())
    scored = ngrams.score_corpus(docs, spark.read.parquet(a.ngrams), a.order).where(F.col("pos") < a.context)
    found = scored.groupBy("doc_id").agg((F.sum("surprisal") / F.count(F.lit(1))).alias(a.name))
    if io.exists(spark, f"{a.out}/documents"):
        found = ordered.attach(spark.read.parquet(f"{a.out}/documents"), found.select(F.col("doc_id").alias("_id"), a.name), "doc_id", "_id").drop("_id")
    found = io.materialise(found, "bits")
    found.write.mode("overwrite").parquet(f"{a.out}/documents")
    values = [c for c in found.columns if c != "doc_id"]
    io.append_delimited(found.agg(*(F.avg(c).alias(c) for c in values)).coalesce(1), f"{a.out}/means")


def _signals(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A corpus as rows a byte with the signal of a scored table."""
    docs = _corpus(spark, a)
    scored = spark.read.parquet(a.scores) if a.scores else ngrams.score_corpus(docs, spark.read.parquet(a.ngrams), a.order)
    kept = ["doc_id", "lang"] if "lang" in docs.columns else ["doc_id"]
    return tx.byte_rows(docs, *kept).join(scored.select("doc_id", "pos", F.col(a.measure).alias("signal")), ["doc_id", "pos"])


def train_thresholds(spark: SparkSession, a: argparse.Namespace) -> None:
    """Threshold-incremental vocabularies of several sizes from one pass, with their checkpoints."""
    sizes = sorted(int(s) for s in a.sizes.split(","))
    found, trace = incremental.train(_signals(spark, a), sizes, a.threshold, a.include_left_byte)
    for size in sizes:
        stop = trace.where(F.col("vocab_size") >= size).agg(F.min("num_moves")).first()[0]
        upto = trace if stop is None else trace.where(F.col("num_moves") <= stop)
        rows = [tuple(r) for r in upto.orderBy("num_moves").collect()]  # one a thousand visits
        io.write_vocabulary(os.path.join(a.out, str(size)), found[size], unknown=alphabet.UNK, checkpoints=rows)


def train_spans(spark: SparkSession, a: argparse.Namespace) -> None:
    """Span vocabularies from a corpus and its n-gram table, by surprisal or entropy."""
    rows = _signals(spark, a)
    languages = a.languages.split(",") if a.languages else None
    for size in (int(s) for s in a.sizes.split(",")):
        names = trainers.train_spans(rows, size, a.proportion, a.percentile, languages)
        io.write_vocabulary(os.path.join(a.out, str(size)), names, unknown=alphabet.UNK)


def statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    """Statistics rows of saved tokenizers that have none yet, appended to a folder of CSV files."""
    docs = _corpus(spark, a)
    by = ("lang",) if a.by_language else ()
    words = io.materialise(tx.dictionary(docs, *by), "dictionary")
    wanted = a.tokenizers.split(",")
    if io.exists(spark, a.out):
        done = {str(r["tokenizer_name"]) for r in io.read_delimited(spark, a.out).select("tokenizer_name").distinct().collect()}
        wanted = [w for w in wanted if os.path.basename(w) not in done]
    for folder in wanted:
        config = io.read_json_config(spark, os.path.join(folder, "tokenizer.json"))["model"]
        vocab = config["vocab"]
        encoder = encoders.bpe([tuple(m) for m in config["merges"]]) if config["type"] == "BPE" else encoders.wordpiece(list(vocab), config["unk_token"])
        table = F.array(*(F.lit(alphabet.CHARS[b]) for b in range(256)))
        chars = F.array_join(F.transform(tx.raw_bytes(tx.prefixed(F.col("pretoken"))), lambda b: F.get(table, b)), "")
        alone = words.select(*by, "n", F.col("pretoken").alias("raw"), chars.alias("pretoken"))
        unknown = vocab.get(config.get("unk_token") or "", -1)
        known = encoders.encode_words(alone.select("pretoken").distinct(), encoder)
        lookup = spark.createDataFrame(list(vocab.items()), "token string, token_id int")
        ids = encoders.with_ids(known, lookup, unknown).select("pretoken", "ids")
        rows = alone.join(ids, "pretoken").select(*by, "n", "ids", F.col("raw").alias("pretoken"))
        io.append_delimited(stats.tokenizer_statistics(rows, os.path.basename(folder), unknown, by), a.out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tokenlake")
    commands = parser.add_subparsers(dest="command", required=True)
    options = {
        tokenize: (),
        subset: (("--languages", str, "en"), ("--budget", int, 10_000_000), ("--shift", int, 0)),
        train_ngrams: (("--order", int, 5),),
        train_merges: (("--sizes", str, "16000"), ("--threshold", int, 20), ("--standard", bool, False), ("--measure", str, merges.FREQUENCY)),
        score: (("--ngrams", str, ""), ("--order", int, 5)),
        bits_per_byte: (("--ngrams", str, ""), ("--order", int, 5), ("--context", int, 2048), ("--name", str, "bpb")),
        train_thresholds: (("--scores", str, ""), ("--ngrams", str, ""), ("--order", int, 5), ("--measure", str, "surprisal"), ("--sizes", str, "16000"), ("--threshold", int, 20), ("--include-left-byte", bool, False)),
        train_spans: (("--scores", str, ""), ("--ngrams", str, ""), ("--order", int, 5), ("--measure", str, "surprisal"), ("--sizes", str, "16000"), ("--proportion", float, None), ("--percentile", float, None), ("--languages", str, "")),
        statistics: (("--tokenizers", str, ""), ("--by-language", bool, False)),
    }
    for job, extra in options.items():
        p = commands.add_parser(job.__name__.replace("_", "-"), help=job.__doc__)
        p.set_defaults(job=job)
        p.add_argument("corpus")
        p.add_argument("out")
        for name, kind, default in (("--id", str, "doc_id"), ("--text", str, "text"), ("--rows", int, 0), *extra):
            p.add_argument(name, **({"action": "store_true"} if kind is bool else {"type": kind, "default": default}))
    a = parser.parse_args(argv)
    a.job(SparkSession.builder.appName(f"tokenlake {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main()
