"""Operators held against plain loops that share none of their code."""

import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tokenlake.llm import media, sharding, textbuf, toxicity


def test_toxicity_features_and_scores_follow_plain_loops(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7)))
    rows = [(i, " ".join([word() for _ in range(20)] + ["Zorg" + word()] * (i % 3 == 0))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxicity_score for r in toxicity.score(docs, model).collect()}
    weights = dict(zip(model["buckets"].tolist(), model["weights"].tolist(), strict=True))

    def bucket(gram):
        value = 0
        for c in gram:
            value = (value * 0x9E3779B97F4A7C15 + int(textbuf.FOLDED[ord(c)]) + 1) % 2**64
        mixed = (value ^ (value >> 29)) * 0xD6E8FEB86659FD93 % 2**64
        return mixed >> (64 - toxicity.BITS)

    for i, text in rows[:60]:
        present = {bucket(text[a : a + n]) for n in toxicity.SIZES for a in range(len(text) - n + 1)}
        total = model["bias"] + sum(weights.get(b, 0.0) for b in present)
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, total))))) < 1e-9


def test_shards_follow_a_plain_descent(spark):
    def draw(key, name, weight):
        first = xxhash.xxh64_intdigest(key.encode(), 42)
        bits = xxhash.xxh64_intdigest(name.encode(), first) >> 11
        return -math.log((bits + 1.0) / (2**53 + 1)) / weight

    def place(key, leaves):
        for level in ("region", "rack", "shard"):
            weights = {}
            for x in leaves:
                weights[getattr(x, level)] = weights.get(getattr(x, level), 0.0) + x.weight
            best = min(weights, key=lambda c: (draw(key, f"{level}:{c}", weights[c]), c)) if len(weights) > 1 else next(iter(weights))
            leaves = [x for x in leaves if getattr(x, level) == best]
        return leaves[0]

    tree = [leaf._replace(weight=1.0 + leaf.shard / 4) for leaf in sharding.grow(sharding.base_tree(8))]
    df = spark.range(400).withColumnRenamed("id", "doc_id")
    for r in sharding.descend(df, F.col("doc_id"), tree).collect():
        leaf = place(str(r.doc_id), tree)
        assert (leaf.region, leaf.rack, leaf.shard) == (r.region, r.rack, r.shard)


def test_media_feature_follows_the_cosine_sum():
    rng = np.random.default_rng(5)
    samples = rng.integers(0, 256, (48, 96)).astype(np.uint8)
    rows = [samples[i * 48 // 32 : max((i + 1) * 48 // 32, i * 48 // 32 + 1)].mean(0) for i in range(32)]
    grid = np.array([[row[j * 96 // 32 : (j + 1) * 96 // 32].mean() for j in range(32)] for row in rows])
    low = []
    for u in range(8):
        for v in range(8):
            low.append(sum(grid[x, y] * math.cos((2 * x + 1) * u * math.pi / 64) * math.cos((2 * y + 1) * v * math.pi / 64) for x in range(32) for y in range(32)))
    low = np.round(low[1:], 6)
    want = [0, *(int(x > np.median(low)) for x in low)]
    assert np.unpackbits(np.frombuffer(media.feature(samples), np.uint8)).tolist() == want
