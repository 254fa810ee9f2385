import random
from collections import Counter

from pyspark.sql import functions as F

from tokenlake.functions import alphabet
from tokenlake.functions import text as tx
from tokenlake.operators import counting, encoders, evaluation, incremental, merges, ngrams, ordered, spans, stats, subsets, vocabulary


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_packing_replaces_the_next_first_token(spark):
    docs = frame(spark, [(1, [1, 2, 3]), (2, [4, 5, 6, 7]), (3, [8]), (4, [9, 10, 11, 12])], "doc_id long, input_ids array<int>")
    got = {r.sequence: r.input_ids for r in subsets.packed_sequences(docs, 4, eod=0).collect()}
    assert got == {0: [1, 2, 3, 0], 1: [5, 6, 7, 0], 2: [9, 10, 11, 12]}


def test_running_total_matches_a_loop(spark):
    rows = [(i, random.Random(i).randrange(9), "ab"[i % 2]) for i in range(300)]
    got = ordered.running_total(frame(spark, rows, "k long, v long, g string"), F.col("v"), "k", "t", by=("g",), buckets=7).collect()
    seen = Counter()
    for k, v, g in rows:
        seen[g] += v
        assert next(r.t for r in got if r.k == k) == seen[g]


def test_quota_overshoots_by_one_row(spark):
    docs = frame(spark, [(i, "en", " abcd") for i in range(10)], "doc_id long, lang string, text string")
    ids = lambda shift: sorted(r.doc_id for r in subsets.language_quota(docs, ["en"], 12, shift).collect())
    assert ids(0) == [0, 1, 2] and ids(1) == [2, 3, 4]


def test_locate(spark):
    offsets = frame(spark, [(1, 0, 3), (2, 3, 3), (3, 3, 9)], "doc_id long, first_pos long, end_pos long")
    got = ordered.locate(frame(spark, [(0,), (2,), (3,), (8,), (9,)], "position long"), offsets, width=2).collect()
    assert sorted((r.position, r.doc_id) for r in got) == [(0, 1), (2, 1), (3, 3), (8, 3)]


def loop_spans(signal, byte, start, tau=None):
    n = len(signal)
    mask = [not ((i and signal[i] < signal[i - 1]) or (tau is not None and signal[i] < tau)) for i in range(n)] + [False]
    flips = [i for i in range(n) if mask[i] != mask[i + 1]]
    out = []
    for s, e in zip(flips[::2], flips[1::2], strict=False):
        if not start[s] and s and byte[s - 1] == 32:
            s -= 1
        if start[e]:
            e -= 1
        if s >= e:
            continue
        a = s
        for m in range(s + 1, e + 1):
            if start[m]:
                out.append((a, m - 1))
                a = m
        if e > a:
            out.append((a, e))
    return out


def test_spans_match_a_loop(spark):
    rng = random.Random(5)
    rows, want = [], []
    for doc in range(40):
        n = rng.randrange(1, 25)
        signal = [float(rng.randrange(6)) for _ in range(n)]
        byte = [rng.choice([32, 97, 98]) for _ in range(n)]
        start = [i == 0 or rng.random() < 0.25 for i in range(n)]
        rows += [(doc, i, byte[i], start[i], signal[i]) for i in range(n)]
        want += [(doc, a, b) for a, b in loop_spans(signal, byte, start, 2.0)]
    got = spans.find_spans(frame(spark, rows, "doc_id long, pos int, byte int, is_start boolean, signal double"), 2.0)
    assert sorted((r.doc_id, r.start, r.stop) for r in got.collect()) == sorted(want)


def test_net_counts_are_clamped(spark):
    deltas = [-1, 1, 1, -1, -1, -1, 1]
    got = spans.net_counts(frame(spark, [("a", i, d) for i, d in enumerate(deltas)], "segment string, i int, delta int"), ["i"]).first()
    count = 0
    for d in deltas:
        count = max(0, count + d)
    assert got.n == count


def test_run_collapses_or_not(spark):
    ids = lambda x, collapse: spark.range(1).select(F.array(*map(F.lit, x)).alias("i")).select(merges.merged(F.col("i"), 7, 7, 9, collapse).alias("r")).first().r
    for k, whole, greedy in ((2, [9], [9]), (3, [9], [9, 7]), (4, [9], [9, 9])):
        assert ids([7] * k, True) == whole == merges.join_pair([7] * k, 7, 7, 9, True)
        assert ids([7] * k, False) == greedy == merges.join_pair([7] * k, 7, 7, 9, False)


def test_merge_loops_agree(spark):
    docs = frame(spark, [(i, "low lower lowest newer newest wide wider aaaa aa") for i in range(8)], "doc_id long, text string")
    words = tx.dictionary(docs)
    local = merges.train(words, alphabet.SIZE + 10, threshold=2)
    assert local == merges.train(words, alphabet.SIZE + 10, threshold=2, driver_words=0)
    assert [m.rank for m in local] == list(range(10))


def test_merges_stop_when_none_is_frequent(spark):
    words = tx.dictionary(frame(spark, [(1, "ab")], "doc_id long, text string"))
    assert merges.train(words, alphabet.SIZE + 10, threshold=2) == []


def test_encoders():
    vocab = ["a", "##a", "aa", "th", "##e", "the", "##th"]
    piece = encoders.wordpiece(vocab)
    assert len(piece("a" * 100)) == 99 and piece("a" * 101) == ["<unk>"] and piece("ab") == ["<unk>"] and piece("thea") == ["the", "##a"]
    assert encoders.bpe([("a", "a"), ("aa", "b")])("aaab") == ["aa", "a", "b"]
    assert encoders.longest_suffix(vocab)("xthe") == ["##th", "##e"]
    assert encoders.longest_substring(vocab)("thex") == ["the"]
    assert encoders.unigram({"a": -1.0, "aa": -1.5, "b": -1.0})("aabx") == ["aa", "b", "<unk>"]
    assert encoders.word_level(["aa"])("aa") == ["aa"]


def test_encode_documents_and_ids(spark):
    docs = frame(spark, [(1, "the the"), (2, None)], "doc_id long, text string")
    got = encoders.encode_documents(docs, encoders.wordpiece([" ", "##t", "##h", "##e", " the"])).collect()
    assert [(r.doc_id, r.tokens, r.num_tokens) for r in got] == [(1, [" the", " the"], 2)]
    words = encoders.encode_words(frame(spark, [("ab", 1)], "pretoken string, n long"), encoders.wordpiece(["a", "##b"]))
    ids = encoders.with_ids(words, alphabet.vocab_frame(spark, ["a", "##b"]), 9).first().ids
    assert ids == [0, 1]


def test_entropy_is_the_dense_sum(spark):
    import math

    docs = frame(spark, [(1, "abcabc"), (2, "abab ca")], "doc_id long, text string")
    rows = ngrams.probabilities(ngrams.counts(docs, [1, 2, 3])).collect()
    p1 = {r.word: r.p for r in rows if r.order == 1}
    assert abs(sum(p1.values()) - 1) < 1e-12
    for r in (r for r in rows if r.order == 2):
        mine = {x.word: x.p for x in rows if x.order == 2 and x.context == r.context}
        dense = [mine.get(w, r.gamma * q) for w, q in p1.items()]
        assert abs(sum(dense) - 1) < 1e-9 and abs(r.entropy + sum(p * math.log2(p) for p in dense)) < 1e-9


def test_threshold_events_of_a_word(spark):
    got = list(incremental.visit([97, 98], [2.0, 1.0], [True, False]))
    assert got == [(1, 0, "##62", 1), (0, 0, "6162", 1), (0, 2, "##62", -1)]
    rows = [(1, 0, 97, True, 2.0), (1, 1, 98, False, 1.0), (2, 0, 97, True, 2.0), (2, 1, 98, False, 1.0)]
    found = incremental.vocabulary(frame(spark, rows, "doc_id long, pos int, byte int, is_start boolean, signal double"), 1, 10).collect()
    assert [(r.token, r.n) for r in found] == [("6162", 2)]


def test_statistics(spark):
    rows = frame(spark, [("a", 3, [1]), ("b", 1, [1, 2])], "pretoken string, n long, ids array<int>")
    got = stats.tokenizer_statistics(rows, "x", unknown_id=2).first()
    assert (got.fertility, got.proportion_continued, got.total_words, got.total_subwords, got.unique_tokens, got.num_unk) == (1.25, 0.25, 4, 5, 2, 1)
    bpb = stats.bits_per_byte(frame(spark, [(0.6931471805599453, 8, 16)], "loss double, num_tokens int, num_bytes int")).first()
    assert abs(bpb.bpb_mean - 0.5) < 1e-9


def test_evaluation(spark):
    rows = frame(spark, [("x", ["ab", "c"], ["a", "bc"]), ("x", ["ab", "c"], ["ab", "c"])], "o string, g array<string>, p array<string>")
    f1 = evaluation.boundary_f1(evaluation.boundary_counts(rows, "g", "p"), "o")
    assert abs(f1.first().f1 - 0.5) < 1e-12 and abs(evaluation.macro_f1(f1).first().macro_f1 - 0.5) < 1e-12
    assert evaluation.difference_rate(rows, "g", "p").first().rate == 0.5
    assert abs(evaluation.pearson_p(0.5, 10) - 0.14111328125) < 1e-6


def test_vocabularies(spark):
    tokens = frame(spark, [("en", "a", 5), ("en", "b", 3), ("fr", "a", 9), ("fr", "c", 1)], "lang string, token string, n long")
    known = frame(spark, [("z",)], "token string")
    got = vocabulary.round_robin(tokens, known, 3, ["en", "fr"]).orderBy("place").collect()
    assert [r.token for r in got] == ["a", "b", "c"]
    assert vocabulary.budget(100, 0.5, 770) == 0
    assert counting.top(tokens, 1, "n", "token").first().n == 9
    assert vocabulary.overlap_percent(tokens.where("lang = 'en'"), tokens.where("lang = 'fr'")).first().overlap == 50
