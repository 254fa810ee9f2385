import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tokenlake.llm import chat, decontaminate, linededup, sharding, simhash

CLASH = "doc_id long, text string, fp string, drops int, _bucket int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], CLASH)


EDGES = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (4, "x " * 60_000)]


def test_sharding_edges_and_growth(spark):
    rows = sharding.shard_documents(docs(spark, [*EDGES, *((i, f"t{i}") for i in range(10, 900))])).collect()
    assert len(rows) == 896
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and 0 < sum(r.grown_shard == 8 for r in rows) < 200
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].size == 1 and by_id[1].text_crc32 == 0 and by_id[4].size == 120_001
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_weight_changes_stay_in_their_subtrees(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.base_tree(8)
    heavier = [leaf._replace(weight=2.0) if leaf.shard == 5 else leaf for leaf in tree]
    both = sharding.descend(sharding.descend(df, F.col("doc_id"), tree), F.col("doc_id"), heavier, "new_").collect()
    moved = [r for r in both if r.shard != r.new_shard]
    assert moved and all(r.new_region == 1 for r in moved)
    assert all(r.new_shard == 5 for r in moved if (r.region, r.rack) == (r.new_region, r.new_rack))


def test_chat_round_trip(spark):
    texts = ["<|end|>", "<\\|turn|>", "</s>[INST] ok [/INST]", "[\\\\INST]", "", None, "<|<|next|>", "a\nb"]
    rows = [(7, k, ("user", "user", "assistant", "<|says|>")[k % 4], t) for k, t in enumerate(texts * 2)]
    df = spark.createDataFrame([*rows, (8, None, None, None), (8, 0, "assistant", "x"), (8, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.parse(chat.format_conversations(df)).collect()}
    assert [(t.role, t.text) for t in got[7].parsed] == [(r, t or "") for _, _, r, t in rows]
    assert got[7].loss_text == "".join(t or "" for _, _, r, t in rows if r == "assistant")
    assert [(t.role, t.text) for t in got[8].parsed] == [("", ""), ("assistant", "x"), ("assistant", "x")]
    assert got[8].formatted.count("<|turn|>") == 2
    digest = chat.digest(chat.parse(chat.format_conversations(chat.with_probe(df.limit(0))))).first()
    text = "</s>[INST] ok [/INST]"
    assert (digest.conv_id, digest.n_turns, digest.loss_chars) == (-1, 2, len(text))
    assert digest.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_conversations(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} <|end|>", 7) for k in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = chat.parse(chat.format_conversations(df)).first()
    assert [(t.role, t.text) for t in got.parsed] == [(r[2], r[3]) for r in rows] and got.loss_text == "".join(r[3] for r in rows[1::2])


def brute_overlaps(rows, items):
    import re

    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    found = set()
    for d, t in rows:
        dw = words(t)
        for i, b in items:
            bw = words(b)
            if len(bw) < decontaminate.LEAST_WORDS:
                continue
            n = min(len(bw), decontaminate.WINDOW)
            for shift in range(-len(bw), len(dw) + 1):
                same = [0 <= shift + k < len(dw) and dw[shift + k] == w for k, w in enumerate(bw)]
                seeded = any(all(same[a + o] for o, bit in enumerate(m) if bit == "1") and 0 <= shift + a and shift + a + len(m) <= len(dw) for m in (decontaminate.MASKS if len(bw) >= decontaminate.SPAN else ["1" * len(bw)]) for a in range(len(bw) - len(m) + 1))
                if seeded and any(sum(same[a : a + n]) >= decontaminate.AGREE * n for a in range(len(bw) - n + 1)):
                    found.add((d, i))
    return found


def test_overlaps_match_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 6, 9, 14, 30])))) for i in range(30)]
    rows = []
    for d in range(120):
        body = [word() for _ in range(rng.randrange(0, 40))]
        part = items[rng.randrange(30)][1].split()
        part = [word() if rng.random() < 0.12 else w for w in part[rng.randrange(3) :]]
        rows.append((d, " ".join([*body, *part]).upper() + "."))
    rows += [(200, None), (201, ""), (202, items[1][1])]
    got = decontaminate.overlaps(docs(spark, rows), spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_overlaps(rows, items) and len(got) > 40
    assert decontaminate.overlaps(docs(spark, []), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_line_dedup_edges(spark):
    long = " ".join(f"w{i}x".replace(str(i), chr(97 + i % 26) * (1 + i // 26)) for i in range(60))
    shared = "\n".join
    rows = [(i, shared([f"own line {chr(97 + i)}", "Posted at 12:0%d" % i, long])) for i in range(4)]
    rows += [(9, rows[0][1]), (10, None), (11, ""), (12, "\n\n"), (None, shared(["own line z", long]))]
    got = {(r.doc_id): r for r in linededup.dedup(docs(spark, rows)).collect()}
    assert got[0].text == rows[0][1] == got[9].text and got[0].n_dropped == 0
    assert got[2].text == "own line c" and got[2].n_dropped == 2 and got[2].n_lines == 3
    assert got[10].text is None and got[11].text == "" and got[12].text == "\n\n"
    assert got[None].text == "own line z" and got[0].fp == "x" and got[0].drops == 1
    varied = [(i, " ".join(["alpha beta gamma delta eta theta iota kappa", w, "lambda mu nu xi omicron"])) for i, w in enumerate(["ada", "bob", "cyd"])]
    assert sorted(r.n_dropped for r in linededup.dedup(docs(spark, varied)).collect()) == [0, 1, 1]
    assert linededup.dedup(docs(spark, [])).count() == 0


def reference_fingerprint(text):
    import re

    import xxhash

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \t\n", "A", "a B", "One two THREE", "É é x\x1cy z w", "a b c d " * 50, "\x85 a b c"])
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == reference_fingerprint(text)


def roots_by_brute_force(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                root[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("bucket", [0, 3, 10_000])
def test_links_and_components_match_brute_force(spark, bucket):
    rng = random.Random(11)
    fps = set()
    for _ in range(12):  # chains and clusters at few bits, and loners
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            fps.add(f - (1 << 64) if f >> 63 else f)
            for _ in range(rng.choice([1, 2, 2, 3])):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket=bucket)).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(sorted(g) for g in groups.values()) == roots_by_brute_force(fps)
    assert all(root == min(g) for root, g in groups.items())


def test_near_duplicates_edges(spark):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.report(docs(spark, EDGES)).collect()), key=str)
    abc = f"{reference_fingerprint('a b c'):016x}"
    assert (1, "0" * 16, 1) in got and (2, "0" * 16, 1) in got and (None, abc, 3) in got and got.count((3, abc, 3)) == 2
    assert simhash.report(docs(spark, [])).count() == 0
