"""Pre-tokenization, byte encoding and decoding, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenlake.functions import alphabet

#: Fixed value: the pre-tokenization pattern of byte-level vocabularies, with Unicode classes.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def prefixed(text: Column) -> Column:
    """The text behind one blank, unless it is empty or starts with one."""
    return F.when((text == "") | text.startswith(" "), text).otherwise(F.concat(F.lit(" "), text))


def pretokens(text: Column) -> Column:
    """Array of pre-tokens; their concatenation is the prefixed text."""
    return F.regexp_extract_all(prefixed(text), F.lit(PATTERN), F.lit(0))


def raw_bytes(text: Column) -> Column:
    """The text's UTF-8 bytes as an array of numbers from 0 to 255."""
    chars = F.split(F.decode(F.encode(text, "utf-8"), "iso-8859-1"), "")  # a character for each byte
    return F.when(F.length(text) > 0, F.transform(chars, lambda c: F.ascii(c))).when(text.isNotNull(), F.array().cast("array<int>"))


def byte_ids(text: Column) -> Column:
    """Identifiers in the byte alphabet of the prefixed text."""
    table = F.array(*(F.lit(alphabet.BYTE_ID[b]) for b in range(256)))
    return F.transform(raw_bytes(prefixed(text)), lambda b: F.get(table, b))


def decode_ids(ids: Column) -> Column:
    """The text of byte identifiers; special tokens have none."""
    table = F.array(*(F.lit(f"{alphabet.ID_BYTE[i]:02X}" if i in alphabet.ID_BYTE else "") for i in range(alphabet.SIZE)))
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "utf-8")


def boundary_flags(text: Column) -> Column:
    """For each byte of the prefixed text, whether a pre-token starts there."""
    flags = F.transform(pretokens(text), lambda p: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), F.octet_length(p) - 1)))
    return F.flatten(flags)


def pretoken_rows(docs: DataFrame, *kept: str) -> DataFrame:
    """(kept columns, pretoken): a row for each pre-token."""
    return docs.where(F.col("text").isNotNull()).select(*kept, F.explode(pretokens(F.col("text"))).alias("pretoken"))


def dictionary(docs: DataFrame, *by: str) -> DataFrame:
    """(by, pretoken, n): distinct pre-tokens with their counts. Counts by pre-token stand for the corpus in all that follows."""
    return pretoken_rows(docs, *by).groupBy(*by, "pretoken").agg(F.count(F.lit(1)).alias("n"))


def byte_rows(docs: DataFrame, *kept: str) -> DataFrame:
    """(kept, pos, byte, is_start): the long table of bytes."""
    zipped = F.arrays_zip(raw_bytes(prefixed(F.col("text"))).alias("byte"), boundary_flags(F.col("text")).alias("is_start"))
    rows = docs.where(F.col("text").isNotNull()).select(*kept, F.posexplode(zipped).alias("pos", "_z"))
    return rows.select(*kept, "pos", F.col("_z").getField("byte").alias("byte"), F.col("_z").getField("is_start").alias("is_start"))
