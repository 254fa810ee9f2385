"""The span trainer: vocabularies seeded with byte spans of a signal and completed by pair merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.functions import alphabet
from tokenlake.operators import merges, spans, vocabulary
from tokenlake.sources.io import materialise


def hex_name(token: str) -> str:
    """A token's text from its span name (hex bytes, behind ``##`` on continuations)."""
    mark = alphabet.CONTINUATION if token.startswith(alphabet.CONTINUATION) else ""
    return mark + alphabet.to_chars(bytes.fromhex(token.removeprefix(alphabet.CONTINUATION)))


def span_name(text: str) -> str | None:
    """The other way; None for special tokens."""
    mark = alphabet.CONTINUATION if text.startswith(alphabet.CONTINUATION) and len(text) > 2 else ""
    body = text.removeprefix(mark)
    return mark + alphabet.to_bytes(body).hex().upper() if body and all(c in alphabet.BYTES for c in body) else None


def apply_spans(rows: DataFrame, found: DataFrame, tokens: DataFrame, chosen: DataFrame) -> DataFrame:
    """(units, n): distinct pre-tokens as unit names with their counts, once chosen spans stand for one unit each.

    Units are chosen spans where they lie, single bytes elsewhere, ``##`` on all but a pre-token's first. Spans that
    were not chosen leave their bytes as they are.
    """
    kept = found.join(tokens.join(chosen.select("token"), "token", "left_semi"), ["doc_id", "start"]).select("doc_id", "start", "stop", "token")
    covered = kept.withColumn("pos", F.explode(F.sequence("start", "stop"))).select("doc_id", "pos", "start", "token")
    word = F.sum(F.col("is_start").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))
    marked = rows.withColumn("word", word).join(covered, ["doc_id", "pos"], "left")
    single = F.concat(F.when(F.col("is_start"), "").otherwise(alphabet.CONTINUATION), F.lpad(F.hex("byte"), 2, "0"))
    units = marked.where(F.col("start").isNull() | (F.col("start") == F.col("pos"))).withColumn("unit", F.coalesce("token", single))
    words = units.groupBy("doc_id", "word").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "unit"))), lambda x: x["unit"]).alias("units"))
    return words.groupBy("units").agg(F.count(F.lit(1)).alias("n"))


def train_spans(rows: DataFrame, final_size: int, proportion: float | None = None, percentile: float | None = None, languages: list[str] | None = None, threshold: int = 1) -> list[str]:
    """The vocabulary's token texts.

    rows: (doc_id, pos, byte, is_start, signal[, lang]). Spans fill the budget by frequency, or by turns of
    ``languages``; the rest comes from merges of neighbouring units. Without ``proportion`` spans may fill it all.
    """
    if percentile is not None and not 0 <= percentile <= 100:
        raise ValueError("percentile must lie between 0 and 100")
    base = alphabet.span_vocab()
    room = vocabulary.budget(final_size, 1.0 if proportion is None else proportion, len(base))
    rows = materialise(rows, "signal")
    tau = spans.signal_percentile(rows, percentile) if percentile is not None else None
    found = materialise(spans.find_spans(rows, tau), "spans")
    tokens = materialise(spans.span_tokens(found, rows), "tokens")
    known = rows.sparkSession.createDataFrame([(n,) for n in map(span_name, base) if n], "token string")
    if languages:
        counts = tokens.join(rows.select("doc_id", "lang").distinct(), "doc_id").groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
        chosen = vocabulary.round_robin(counts, known, room, languages).orderBy("place").select("token")
    else:
        counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        chosen = vocabulary.by_frequency(counts, known, int(room)).select("token")
    picked = [r["token"] for r in chosen.collect()]  # a vocabulary
    names = (base + [hex_name(t) for t in picked])[:final_size]
    if len(names) >= final_size:
        return names
    seeded = rows.sparkSession.createDataFrame([(t,) for t in picked] or [("",)], "token string")
    ids = {n: i for i, n in enumerate(map(span_name, names)) if n}
    table = rows.sparkSession.createDataFrame(list(ids.items()), "unit string, id int")
    words = apply_spans(rows, found, tokens, seeded).withColumn("w", F.xxhash64(F.array_join("units", " ")))
    flat = words.select("w", "n", F.posexplode("units").alias("at", "unit")).join(F.broadcast(table), "unit")
    coded = flat.groupBy("w", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids")).select("ids", "n")
    growth = merges.Growth(len(names), final_size, names)
    merges.grow(coded, growth, threshold)
    return growth.names
