import random
import re
from itertools import combinations

import pytest

from tokenlake.llm import decontaminate


@pytest.mark.parametrize("n", range(5, 14))
def test_masks_are_complete(n):
    placed = [(a, m) for m in decontaminate.LONG_MASKS for a in range(n - len(m) + 1)] if n == 13 else decontaminate.masks_for(n, decontaminate.may_differ(n))
    read = [{a + o for o, bit in enumerate(m) if bit == "1"} for a, m in placed]
    assert all(max(r) < n and len(r) >= 4 for r in read)
    assert all(any(not r & set(gone) for r in read) for gone in combinations(range(n), decontaminate.may_differ(n)))


def brute(rows, items):
    words = lambda t: [w for w in re.split(r"[^a-z]+", t.lower()) if w]
    found = set()
    for d, t in rows:
        dw = words(t)
        for i, b in items:
            bw = words(b)
            n = min(len(bw), 13)
            for shift in range(-len(bw), len(dw) + 1):
                same = [0 <= shift + k < len(dw) and dw[shift + k] == w for k, w in enumerate(bw)]
                if any(10 * sum(same[a : a + n]) >= 8 * n for a in range(len(bw) - n + 1)):
                    found.add((d, i))
    return found


def test_every_overlap_within_tolerance_is_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(5 + i % 12))) for i in range(48)]
    rows = []
    for d in range(250):
        part = items[d % 48][1].split()
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = word()
        rows.append((d, " ".join([*(word() for _ in range(rng.randrange(4))), *part[rng.randrange(2) :]])))
    fifth = items[11][1].split() + [word() for _ in range(44)]  # every fifth word replaced
    items.append((99, " ".join(fifth)))
    rows += [(900 + k, " ".join(word() if i % 5 == k else w for i, w in enumerate(fifth))) for k in range(5)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(docs, benchmark).collect()
    expected = brute(rows, items)
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(expected) > 100
    assert sorted(decontaminate.overlaps(docs, benchmark, broadcast=0).collect()) == sorted(got)
    assert {(900 + k, 99) for k in range(5)} <= expected


def test_repeated_and_null_ids_and_long_texts(spark):
    text = lambda n, c: " ".join(f"{c}{i}w" for i in range(n))
    items = [(1, text(20, "a")), (1, text(8, "b")), (1, text(8, "b")), (None, text(13, "c")), (2, "too few words"), (3, None)]
    rows = [(1, text(20, "a")), (1, text(8, "b")), (2, text(8, "b") + " " + text(13, "c")), (None, text(13, "c")), (3, text(30_000, "z") + " " + text(13, "c")), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, item long, doc_words string")
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, seed int")
    for broadcast in (decontaminate.BROADCAST_SEEDS, 0):
        got = {(r.doc_id, r.item_id): (r.matched_words, r.doc_start) for r in decontaminate.overlaps(docs, benchmark, broadcast=broadcast).collect()}
        assert got == {(1, 1): (13, 0), (2, 1): (8, 0), (2, None): (13, 8), (None, None): (13, 0), (3, None): (13, 30_000)}
