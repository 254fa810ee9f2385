"""Sources and sinks: tables in, tables and tokenizer files out."""

from __future__ import annotations

import ast
import csv
import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest number of rows in a written file.
ROWS_A_FILE = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share. Where the session names none one is made, but only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tokenlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/tokenlake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tokenlake_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that ``materialise`` returned and that nothing reads any more."""
    path = getattr(df, "_tokenlake_path", None)
    if path:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_documents(spark: SparkSession, path: str, text: str = "text", key: str = "id", glob: str | None = None) -> DataFrame:
    """(id, text): a Parquet corpus, optionally by a glob below ``path`` such as ``*/*.parquet``; only two columns are read."""
    return spark.read.parquet(f"{path.rstrip('/')}/{glob}" if glob else path).select(F.col(key).alias("id"), F.col(text).alias("text"))


def read_config(spark: SparkSession, root: str, config: str, split: str) -> DataFrame:
    """One split of a named configuration, laid out as ``root/config=.../split=...``: partitions are pruned."""
    return spark.read.parquet(root).where((F.col("config") == config) & (F.col("split") == split)).drop("config", "split")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None) -> DataFrame:
    """CSV, TSV or ``", "``-separated text with a header."""
    reader = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): stripped lines of text."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a file whose every line is a list of objects with ``schema``."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    kind = kind if kind.startswith("struct") else f"struct<{kind}>"
    return spark.read.text(path).select(F.inline(F.from_json("value", f"array<{kind}>")))


def read_json_config(spark: SparkSession, path: str) -> dict:
    """A small JSON document, on the driver."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_path_list(spark: SparkSession, path: str) -> list[str]:
    """A short list of paths, one a line."""
    return [r["value"] for r in read_lines(spark, path).where(F.col("value") != "").collect()]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below ``root``, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def write_corpus(df: DataFrame, path: str, rows_a_file: int = ROWS_A_FILE, mode: str = "error") -> None:
    """zstd Parquet in files of bounded size."""
    df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)


def write_sharded(df: DataFrame, path: str, shards: int, mode: str = "error") -> None:
    df.repartition(shards).write.mode(mode).parquet(path)


def write_config(df: DataFrame, root: str, config: str, split: str) -> None:
    """Add or replace one split of a named configuration; other splits stay."""
    rows = df.withColumns({"config": F.lit(config), "split": F.lit(split)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config", "split").parquet(root)


def append_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """Append result rows to a folder of CSV files."""
    df.write.mode("append").option("header", True).option("sep", sep).csv(path)


def write_jsonl_as_parquet(spark: SparkSession, path: str, schema: T.StructType | str, out: str) -> None:
    if not path.endswith(".jsonl"):
        raise ValueError("a .jsonl file is expected")
    read_jsonl(spark, path, schema).write.parquet(out)


def tokenizer_json(vocab: list[str], merges: list[tuple[str, str]] | None = None, unknown: str | None = None) -> dict:
    """A tokenizer document in the public JSON format: BPE where merges are given, else WordPiece; byte-level around it."""
    level = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    ids = {t: i for i, t in enumerate(vocab)}
    if merges is not None:
        model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": ids, "merges": [list(m) for m in merges]}
    else:
        model = {"type": "WordPiece", "unk_token": unknown, "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": ids}
    return {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": level, "decoder": level, "model": model}


def write_vocabulary(folder: str, vocab: list[str], merges: list[tuple[str, str]] | None = None, unknown: str | None = None, merge_rows: list[tuple] | None = None, checkpoints: list[tuple] | None = None) -> None:
    """vocab.json, merges.txt and tokenizer.json in a folder of the driver; merges_data.csv and stats.csv where there are rows for them."""
    from pathlib import Path

    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    (root / "vocab.json").write_text(json.dumps({t: i for i, t in enumerate(vocab)}, ensure_ascii=False))
    if merges is not None:
        (root / "merges.txt").write_text("#version: 0.2\n" + "".join(f"{a} {b}\n" for a, b in merges))
    for name, header, rows in (("merges_data.csv", ("left_token", "right_token", "joined_token", "num_merges"), merge_rows), ("stats.csv", ("num_moves", "vocab_size", "unique_segments", "threshold"), checkpoints)):
        if rows is not None:
            with (root / name).open("w", newline="") as file:
                csv.writer(file).writerows([header, *rows])
    (root / "tokenizer.json").write_text(json.dumps(tokenizer_json(vocab, merges, unknown), ensure_ascii=False))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def parse_literals(df: DataFrame, column: str, kind: T.DataType | str) -> DataFrame:
    """``column``, text of Python lists, dicts or tuples, as values of ``kind``; null where it is no such literal."""

    @F.arrow_udf("string")
    def as_json(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                try:
                    out.append(None if text is None else json.dumps(ast.literal_eval(text)))
                except (ValueError, SyntaxError, TypeError):
                    out.append(None)
            yield pa.array(out, pa.string())

    return df.withColumn(column, F.from_json(as_json(F.col(column)), kind))
