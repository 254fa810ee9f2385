"""Text normalisers and simple pre-tokenizers by name."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _unicode(form: str):
    @F.arrow_udf(T.StringType())
    def normal(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else unicodedata.normalize(form, t) for t in batch.to_pylist()], pa.string())

    return normal


def normalise(text: Column, kind: str, **options) -> Column:
    """One normaliser: Lowercase, Strip, StripAccents, Replace (pattern, content), NFC, NFD, NFKC, NFKD, Nmt or Bert."""
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return _unicode(kind)(text)
    if kind == "Lowercase":
        return F.lower(text)
    if kind == "Strip":
        return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    if kind == "StripAccents":
        return F.regexp_replace(_unicode("NFD")(text), r"\p{Mn}+", "")
    if kind == "Replace":
        return F.replace(text, F.lit(options["pattern"]), F.lit(options["content"]))
    if kind == "Nmt":  # control characters go, all blanks are one kind
        return F.regexp_replace(F.regexp_replace(text, r"[\x01-\x08\x0B\x0E-\x1F\x7F\x8F\x9F]", ""), r"[\t\n\f\r\u00A0\u1680\u2000-\u200F\u2028\u2029\u202F\u205F\u2581\u3000\uFEFF\uFFFD]", " ")
    if kind == "Bert":
        clean = F.regexp_replace(F.regexp_replace(text, r"[\x00\uFFFD]|[\p{Cc}\p{Cf}&&[^\t\n\r]]", ""), r"(?U)\s", " ")
        spaced = F.regexp_replace(clean, r"([\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF])", " $1 ")
        out = normalise(spaced, "StripAccents") if options.get("strip_accents", True) else spaced
        return F.lower(out) if options.get("lowercase", True) else out
    raise ValueError(f"unknown normaliser {kind!r}")


def chain(text: Column, *steps: tuple[str, dict] | str) -> Column:
    for step in steps:
        kind, options = (step, {}) if isinstance(step, str) else step
        text = normalise(text, kind, **options)
    return text


#: What each pre-tokenizer takes as one piece.
PIECES = {
    "Whitespace": r"(?U)\w+|[^\w\s]+",
    "WhitespaceSplit": r"(?U)\S+",
    "Digits": r"(?U)\p{N}+|\P{N}+",
    "IndividualDigits": r"(?U)\p{N}|\P{N}+",
    "Punctuation": r"\p{P}|\P{P}+",
    "Bert": r"(?U)[\p{P}$+<=>^`|~]|[^\s\p{P}$+<=>^`|~]+",
    "UnicodeScripts": r"\p{IsLatin}+|\p{IsCyrillic}+|\p{IsGreek}+|\p{IsHan}+|[\p{IsHiragana}\p{IsKatakana}]+|\p{IsArabic}+|\p{IsCommon}+|.",
}


def pre_tokenize(text: Column, kind: str, **options) -> Column:
    """Array of pieces. CharDelimiterSplit takes ``delimiter``, Split ``pattern``, Metaspace ``replacement``."""
    if kind == "ByteLevel":
        from tokenlake.functions.text import pretokens

        return pretokens(text)
    if kind == "CharDelimiterSplit":
        return F.filter(F.split(text, r"\Q" + options["delimiter"] + r"\E"), lambda x: x != "")
    if kind == "Split":
        return F.filter(F.split(text, options["pattern"]), lambda x: x != "")
    if kind == "Metaspace":
        mark = options.get("replacement", "▁")
        whole = F.concat(F.lit(mark), F.translate(text, " ", mark))
        return F.regexp_extract_all(whole, F.lit(f"{mark}[^{mark}]*"), F.lit(0))
    if kind in PIECES:
        return F.regexp_extract_all(text, F.lit(PIECES[kind]), F.lit(0))
    raise ValueError(f"unknown pre-tokenizer {kind!r}")
