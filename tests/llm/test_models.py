import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tokenlake.llm import html, media, pieces, quality, registry, textbuf, toxicity

MODEL = registry.PIECE_MODEL


def labelled(spark, n=400):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7)))
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        text = [word() for _ in range(rng.randrange(20, 60))]
        if bad:
            text[rng.randrange(len(text))] = "zorg" + word()
        rows.append((i, " ".join(text), 5))
        labels.append((i, int(bad), int(bad)))
    rows += [(n, None, 5), (n + 1, "", 5), (n + 2, "zorgab " * 20_000, 5), (n + 2, "zorgab " * 20_000, 5), (None, "zorgab", 5)]
    labels += [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxicity_score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows_and_edges(spark):
    docs, labels = labelled(spark)
    rows = toxicity.classify(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null and doc_id is not null").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == docs.count() and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    none = toxicity.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_quality_edges(spark):
    docs, labels = labelled(spark)
    rows = quality.classify(docs, labels).collect()
    by_id = {r.doc_id: r.score for r in rows}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert by_id[400] == by_id[401] and {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_quality_counts_match_a_loop():
    texts = ["", None, "ab", "a a a b b", "xé\U0001f600y", "one one two " * 3]
    (first, counts), = quality._counts(pa.array(texts, pa.string()))
    assert first == 0 and counts[:, :-1].sum(1).tolist() == [max(0, len(t or "") - 2) for t in texts]
    repeats = lambda t: sum(a == b for a, b in zip(t.split(), t.split()[1:], strict=False))
    assert counts[:, -1].tolist() == [repeats(t or "") for t in texts]


def test_votes_are_exact():
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    model = {"vectors": unit(rng.standard_normal((60, 8))), "y": rng.integers(0, 2, 60).astype(float), "w": np.ones(60), "share": 0.5}
    x = unit(rng.standard_normal((20, 8)))
    for row, score in zip(x, quality.vote(x, model), strict=True):
        near = sorted(((float(v @ row), y) for v, y in zip(model["vectors"], model["y"], strict=True)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(s, 0) for s, _ in near]
        assert abs(score - sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight)) < 1e-9


def test_ties_go_to_the_first():
    near = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2]], np.float32)
    assert quality.nearest(near, 3).tolist() == [[0, 1, 2], [0, 1, 2]] and quality.nearest(near, 5).tolist() == [[0, 1, 2, 3, 4]] * 2


def test_held_out_accuracy(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7)))
    rows = [(i, " ".join([word() for _ in range(40)]) if i % 4 else "#|".join([word() for _ in range(40)]), None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, *_ in rows], "doc_id long, quality int")
    held = [r for r in quality.classify(docs, labels).collect() if r.held_out]
    assert len(held) > 50 and all(r.predicted == int(r.doc_id % 4 > 0) for r in held)


def test_pieces_of_long_texts_hold_each_window_once():
    texts = ["abc", None, "d" * 25, "é\U0001f600" * 9, ""]
    for chars in (4, 7, 100):
        seen = []
        for points, ends, rows in textbuf.pieces(pa.array(texts, pa.string()), 2, chars):
            for k, row in enumerate(rows):
                part = points[ends[k] : ends[k + 1]]
                seen += [(int(row), tuple(part[i : i + 3])) for i in range(len(part) - 2)]
        want = [(r, tuple(map(ord, t[i : i + 3]))) for r, t in enumerate(texts) if t for i in range(len(t) - 2)]
        assert sorted(seen) == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 40_000])
def test_png_round_trip(n):
    text = bytes(random.Random(n).choices(b"abc \n\xff", k=n))
    png = media.encode(media.payload(text))
    body = media.decode(png).tobytes()
    assert body == text + b"\xff" * (len(body) - n) and len(body) % 576 == 0 and 0 <= len(body) - n <= 576 and len(body)
    for at in (3, 20, len(png) // 2, len(png) - 6):
        with pytest.raises(ValueError):
            media.decode(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        media.decode(png[:-12])


def test_all_filters_are_undone():
    rng = np.random.default_rng(4)
    want = rng.integers(0, 256, (12, 9)).astype(np.uint8)
    raw = np.zeros((12, 10), np.uint8)
    for i, kind in enumerate([0, 1, 2, 3, 4, 2, 2, 1, 4, 3, 0, 2]):
        above = want[i - 1].astype(int) if i else np.zeros(9, int)
        left = np.concatenate([[0], want[i, :-1]]).astype(int)
        corner = np.concatenate([[0], above[:-1]]).astype(int)
        base = left + above - corner
        paeth = [min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2] for p, a, b, c in zip(base, left, above, corner, strict=True)]
        guess = [0, left, above, (left + above) // 2, np.array(paeth)][kind]
        raw[i, 0], raw[i, 1:] = kind, (want[i].astype(int) - guess) % 256
    assert (media.unfilter(raw) == want).all()


def test_media_columns(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "é" * 300_000, "c"), (3, "é" * 300_000, "c")], "doc_id long, text string, media string")
    rows = media.from_media(media.to_media(docs)).collect()
    assert [r.doc_id for r in rows] == [1, 2, 3, 3] and rows[2] == rows[3] and rows[0][1:] == rows[1][1:]
    body = media.payload(("é" * 300_000).encode())
    assert rows[2].payload_sha256 == hashlib.sha256(body).hexdigest() and rows[2].tail_crc32 == zlib.crc32(body[-32:]) and rows[2].n_bytes == 600_000
    assert media.from_media(media.to_media(docs.limit(0))).count() == 0


PAGE = """<html><head><title>T</title><style>p{{}}</style><script>var x="</p>";</script></head><body>
<nav><ul><li><a href="/">Home page of ours</a></li></ul></nav><div class="ad">Buy &amp; sell</div>
<div class="post-{0} entry"><h1>Head {0}</h1><p><b>Fish &amp; chips<br>for  two<p>It<i>al</i>ic &lt;b&gt; text{0}</p>
<form>Sign up</form><div class="comments">First!</div></div><footer>&copy; us</footer></body>"""


def test_html_consensus(spark):
    rows = [(i, "https://u@H.example:80/x", PAGE.format(i)) for i in range(3)] + [(9, None, None), (10, "http://h2/", ""), (11, "http://h3/", "plain <b>text"), (12, "http://h.example/", "<body><p>only this</p>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, path int")
    got = {r.page_id: r for r in html.main_text(df).collect()}
    assert got[2].text == "Head 2 Fish & chips for two Italic <b> text2" and got[2].n_chars == len(got[2].text)
    assert got[9].text == "" and got[10].text == "" and got[12].text == "only this"
    assert html.winners(df).where("host = 'h.example'").first().path.endswith("/div.entry.post-#")
    assert html.main_text(df.limit(0)).count() == 0


def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model, library = pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [None, "", " ", "  a  b ", "Hello world, hello 12.50!", "tab\tnew\nline\r\n", "中文 \U0001f600 é", "x" * 3000, "aaaa aaaa", "Hello world, hello 12.50!"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    for most in (0, 3, 1000):
        rows = pieces.decode(pieces.encode(df, model, most), model).collect()
        assert rows == pieces.round_trip(df, model, most).collect()
        for r in rows:
            assert r.text is None and r.ids is None or (r.ids == library.encode(r.text) and r.decoded == r.text)
    assert pieces.encode(df.limit(0), model, 10).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(df.withColumnRenamed("score", "ids"), model)
    broken = spark.createDataFrame([([i],) for i in model.byte_ids[192:194]] + [([],), (None,), (library.encode("a é"),)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(broken, model).collect()] == ["\ufffd", "\ufffd", "", None, "a é"]


@pytest.mark.parametrize("alone", ["", "\n0", "xyz01\t"])
def test_words_are_what_a_pattern_finds(alone):
    import re

    rng = random.Random(9)
    texts = [None, "", " ", *("".join(rng.choices(" ▁aéxyz01\n\t\U0001f600", k=rng.randrange(1, 30))) for _ in range(60))]
    escaped = "".join(map(re.escape, alone))
    pattern = f"[{escaped}]| +[^ {escaped}]*|[^ {escaped}]+" if alone else " +[^ ]*|[^ ]+"
    words, ends = pieces.split_words(pa.array(texts, pa.string()), alone)
    want = [re.findall(pattern, " " + t.replace("▁", " ")) if t else [] for t in texts]
    assert words.to_pylist() == [w for ws in want for w in ws] and np.diff(ends).tolist() == [len(ws) for ws in want]


def test_unigram_fold_is_viterbi(spark):
    rng = random.Random(6)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(2, 5))) for _ in range(14)} | {"a", "▁"})
    scores = {p: -rng.random() * 5 for p in names}
    model = pieces.Model(b"", ("<unk>", *names), (0.0, *(scores[p] for p in names)), (False, *(True for _ in names)), (), 0, True, 4, "")
    words = [" " + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    got = {r.word: r.ids for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    floor = min(scores.values()) - pieces.UNKNOWN_PENALTY

    def best(w):
        table = [(0.0, [])]
        for e in range(1, len(w) + 1):
            options = [(table[a][0] + scores.get(w[a:e], floor), table[a][1] + [w[a:e]]) for a in range(max(0, e - 4), e) if w[a:e] in scores or e - a == 1]
            table.append(max(options))
        return table[-1][0]

    for w in set(words):
        total = sum(scores[model.pieces[i]] if i else floor for i in got[w])
        assert abs(total - best(w.replace(" ", "▁"))) < 1e-9


def test_words_outside_the_dictionary_take_the_lattice(monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    model, library = pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(12)
    texts = [None, "", " ", "x" * 3000, "中文 \U0001f600 é" * 40, "  tab\tnew\n", "the " * 300]
    texts += [" ".join("".join(rng.choices("etaoinshrdlu中é1$", k=rng.randrange(1, 90))) for _ in range(30)) for _ in range(20)]
    want = [library.encode(t) if t else [] for t in texts]
    none = pieces.Dictionary(pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for long, chars in ((64, 1 << 17), (0, 50), (10**6, 1000)):  # heap and rounds, in one block and many
        monkeypatch.setattr(pieces, "LONG_WORD", long, raising=False)
        monkeypatch.setattr(pieces, "LATTICE_CHARS", chars, raising=False)
        ids, ends = pieces._encoder(model._replace(proto=b""), none)(pa.array(texts, pa.string()))  # no model for the library
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == want


@pytest.mark.parametrize("unigram", [True, False])
def test_both_lattices_agree(spark, unigram):
    rng = random.Random(16)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))) for _ in range(30)} | {"a", "b", "▁"})
    scores = [float(-rng.randrange(12)) for _ in names]  # with ties
    model = pieces.Model(b"", ("<unk>", *names), (0.0, *scores), (False, *(True for _ in names)), (), 0, unigram, 4, "")
    words = sorted({" " * rng.randrange(2) + "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14))) for _ in range(200)})
    want = {r.word: r.ids for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    ids, sizes = pieces._lattice_ids(pa.array(words, pa.large_string()), model, pieces._lookup(model))
    ends = np.cumsum([0, *sizes])
    assert {w: ids[a:b].tolist() for w, a, b in zip(words, ends, ends[1:], strict=False)} == want
