"""Token-budget subsets, and packing of token streams into sequences of fixed length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenlake.functions import alphabet
from tokenlake.functions import text as tx
from tokenlake.operators import ordered
from tokenlake.sources.io import materialise


def byte_length(text: Column) -> Column:
    """Tokens of a byte-level encoding, without encoding: the prefixed text's bytes."""
    return F.octet_length(tx.prefixed(text)).cast("long")


def language_quota(docs: DataFrame, languages: list[str], budget: int, shift: int = 0, order: str = "doc_id", length: Column | None = None) -> DataFrame:
    """Rows of each language from token ``budget * shift`` on until the budget is met.

    With ``before`` and ``after`` the running token totals around a row, it stays if ``before`` is below the end of
    the budget and ``after`` reaches its start; the last row goes over, and one across a border is in both subsets.
    """
    rows = docs.where(F.col("lang").isin(languages)).withColumn("num_tokens", byte_length(F.col("text")) if length is None else length)
    rows = ordered.running_total(rows, F.col("num_tokens"), order, "after", by=("lang",))
    before = F.col("after") - F.col("num_tokens")
    return rows.where((before < budget * (shift + 1)) & (F.col("after") >= budget * shift)).drop("after")


def packed_slices(tokens: DataFrame, length: int, eod: int = alphabet.EOS_ID, eod_in_lengths: bool = False) -> DataFrame:
    """(sequence, slot, part): what each document gives to each sequence of ``length`` tokens it touches, as an array.

    Documents (doc_id, input_ids) follow each other. One that ends inside a sequence is closed by an end token. As
    lengths do not count it, it replaces the next document's first token; with ``eod_in_lengths`` each document carries
    its own instead. The remainder is dropped. Places come from lengths alone; tokens move once, a slice a row.
    """
    rows = tokens.where(F.size("input_ids") > 0).select("doc_id", "input_ids")
    if eod_in_lengths:
        rows = rows.withColumn("input_ids", F.concat("input_ids", F.array(F.lit(eod))))
    placed = ordered.doc_offsets(rows.select("doc_id", F.size("input_ids").cast("long").alias("n")), F.col("n"))
    placed = materialise(placed.select("doc_id", "first_pos", "end_pos"), "offsets")
    total = placed.agg(F.max("end_pos")).first()[0] or 0
    rows = rows.join(placed, "doc_id")
    first = F.col("first_pos")
    if not eod_in_lengths:
        closed = F.concat(F.array(F.lit(eod)), F.slice("input_ids", 2, F.size("input_ids")))
        rows = rows.withColumn("input_ids", F.when((first > 0) & (first % length != 0), closed).otherwise(F.col("input_ids")))
    touched = F.sequence(F.floor(first / length), F.floor((F.col("end_pos") - 1) / length))
    rows = rows.select("input_ids", "first_pos", F.explode(touched).alias("sequence")).where(F.col("sequence") < total // length)
    start = F.greatest(F.col("sequence") * length - first, F.lit(0)).cast("int")
    size = F.least((F.col("sequence") + 1) * length - first, F.size("input_ids").cast("long")).cast("int") - start
    return rows.select("sequence", ((first + start) % length).alias("slot"), F.slice("input_ids", start + 1, size).alias("part"))


def packed_sequences(tokens: DataFrame, length: int, **how) -> DataFrame:
    """(sequence, input_ids): one row of ``length`` tokens each."""
    rows = packed_slices(tokens, length, **how)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("slot", "part"))), lambda x: x["part"])
    return rows.groupBy("sequence").agg(F.flatten(parts).alias("input_ids"))


def packed_tokens(tokens: DataFrame, length: int, **how) -> DataFrame:
    """(sequence, slot, token): the packed sequences, one row a token."""
    rows = packed_slices(tokens, length, **how).select("sequence", "slot", F.posexplode("part").alias("_at", "token"))
    return rows.select("sequence", (F.col("slot") + F.col("_at")).alias("slot"), "token")
