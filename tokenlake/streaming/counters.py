"""Incremental forms over unbounded document streams (extensions of the batch operators)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tokenlake.functions import text as tx
from tokenlake.operators import counting


def pretoken_counts(stream: DataFrame) -> DataFrame:
    """(pretoken, n) so far; write in update or complete mode."""
    return tx.dictionary(stream)


def byte_pair_counts(stream: DataFrame) -> DataFrame:
    """(left, right, n) so far, from each document's own pre-tokens."""
    return counting.adjacent_pairs(tx.pretoken_rows(stream).withColumn("n", F.lit(1).cast("long")))


def windowed_tokens(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Tokens by event-time window, late rows accepted up to ``late``."""
    tokens = F.octet_length(tx.prefixed(F.col("text")))
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("documents"))


def language_quota(stream: DataFrame, budget: int) -> DataFrame:
    """(doc_id, lang, num_tokens): rows of each language until its token budget is met, in order of arrival.

    The state of a language is one number.
    """

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for batch in batches:
            batch = batch.sort_values("doc_id")
            before = used + batch.num_tokens.cumsum() - batch.num_tokens
            kept = batch[before < budget]
            used += int(kept.num_tokens.sum())
            yield kept[["doc_id", "lang", "num_tokens"]]
        state.update((used,))

    rows = stream.select("doc_id", "lang", F.octet_length(tx.prefixed(F.col("text"))).cast("long").alias("num_tokens"))
    return rows.groupBy("lang").applyInPandasWithState(admit, "doc_id long, lang string, num_tokens long", "used long", "append", GroupStateTimeout.NoTimeout)
