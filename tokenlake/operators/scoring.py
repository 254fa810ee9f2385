"""Plug-in scorers: a neural byte model behind the same signal columns as the n-gram tables.

A scorer gets fixed-length windows of byte identifiers that overlap by all but ``stride`` places and returns, for each
window, the signals of its last ``stride`` places (all places of a document's first window). Context never crosses
documents, so results do not depend on how rows are batched. Signals are in nats unless the scorer says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tokenlake.session import ship_package

SIGNALS = ("surprisal", "entropy", "space_nll", "eos_nll")


class Scorer(Protocol):
    context: int
    stride: int

    def score(self, windows: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
        """For each window an array of each of ``SIGNALS``, as long as the window."""


def strided(ids: np.ndarray, context: int, stride: int) -> list[tuple[int, int, int]]:
    """(start, stop, first new place) of the windows that cover a document, each place new in exactly one."""
    out, done = [], 0
    while done < len(ids):
        stop = min(len(ids), context if not done else done + stride)
        out.append((max(0, stop - context), stop, done))
        done = stop
    return out


def score_documents(tokens: DataFrame, scorer: Scorer, batch: int = 32) -> DataFrame:
    """(doc_id, surprisal, entropy, space_nll, eos_nll): arrays along ``input_ids`` of each document."""
    ship_package(tokens.sparkSession)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            columns: dict[str, list] = {s: [] for s in SIGNALS}
            for ids in frame.input_ids:
                ids = np.asarray([] if ids is None else ids, dtype=np.int64)
                out = {s: np.zeros(len(ids)) for s in SIGNALS}
                cuts = strided(ids, scorer.context, scorer.stride)
                for at in range(0, len(cuts), batch):
                    part = cuts[at : at + batch]
                    for (start, stop, new), found in zip(part, scorer.score([ids[a:b] for a, b, _ in part]), strict=True):
                        for s in SIGNALS:
                            out[s][new:stop] = found[s][new - start : stop - start]
                for s in SIGNALS:
                    columns[s].append(out[s])
            yield pd.DataFrame({"doc_id": frame.doc_id, **columns})

    schema = f"doc_id {kind}, " + ", ".join(f"{s} array<double>" for s in SIGNALS)
    return tokens.select("doc_id", "input_ids").mapInPandas(run, schema)
