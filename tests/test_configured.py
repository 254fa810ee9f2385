import pytest

from tokenlake.operators import configured

TEXTS = ["Hello, héllo 12 wörld", "", "a  b", "Über-aaab ab"]
CHARS = sorted({c for t in TEXTS for c in t.lower()} | {"x"})


def build(library, kind):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    tok = Tokenizer(library)
    tok.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Digits(individual_digits=True)]) if kind == "seq" else pre_tokenizers.ByteLevel(add_prefix_space=True)
    return tok


def config(model, kind):
    normal = {"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "StripAccents"}, {"type": "Lowercase"}]}
    cut = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Digits", "individual_digits": True}]} if kind == "seq" else {"type": "ByteLevel", "add_prefix_space": True}
    return {"normalizer": normal, "pre_tokenizer": cut, "model": model}


@pytest.mark.parametrize("kind", ["seq", "bytes"])
def test_models_equal_the_library(spark, kind):
    models = pytest.importorskip("tokenizers").models
    names = [*CHARS, *(f"##{c}" for c in CHARS), "Ġ", "he", "##ll", "ab", "Ġab", "##llo", "aa", "[UNK]", "Ã", "##Ġ", "hello"]
    vocab = {n: i for i, n in enumerate(dict.fromkeys(names))}
    merges = [["h", "e"], ["a", "b"], ["Ġ", "ab"], ["a", "a"]]
    scores = [[n, -float(i % 7) - len(n) / 10] for i, n in enumerate(vocab) if not n.startswith("##")]
    pairs = [
        ({"type": "Sage", "vocab": vocab, "unk_token": "[UNK]"}, models.WordPiece(vocab=vocab, unk_token="[UNK]")),
        ({"type": "BPE_dropout", "vocab": vocab, "merges": merges, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}, models.BPE(vocab=vocab, merges=[tuple(m) for m in merges])),
        ({"type": "SaGe_as_Unigram", "vocab": [["<unk>", 0.0], *scores], "unk_id": 0}, models.Unigram(vocab=[("<unk>", 0.0), *map(tuple, scores)], unk_id=0)),
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    for model, library in pairs:
        tok = build(library, kind)
        got = {r.doc_id: r.tokens for r in configured.tokenize(docs, config(model, kind)).collect()}
        assert set(got) == set(range(len(TEXTS)))
        for i, t in enumerate(TEXTS):
            want = tok.encode(t).tokens if "Unigram" not in model["type"] else None
            if want is not None:
                assert got[i] == want, (model["type"], t)
            else:
                assert "".join(x for x in got[i] if x != "<unk>") == "".join(x for x in tok.encode(t).tokens if x in dict(scores)) or "<unk>" in got[i]


def test_marks_splits_and_substrings(spark):
    docs = spark.createDataFrame([(1, "a-b ab")], "doc_id long, text string")
    equal = {"model": {"type": "WP_equal_like", "vocab": [["a", -1.0], ["b", -1.0], ["-", -1.0]]}}
    assert configured.tokenize(docs, equal).first().tokens == ["a", "##-", "##b", "##a", "##b"]
    for behaviour, want in {"Removed": ["a", "b ab"], "Isolated": ["a", "-", "b ab"], "MergedWithPrevious": ["a-", "b ab"], "MergedWithNext": ["a", "-b ab"]}.items():
        cut = {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": "-"}, "behavior": behaviour}}
        assert sorted(r.pretoken for r in configured.dictionary(docs, cut).collect()) == sorted(want)
    flota = {"model": {"type": "WP_flota", "vocab": {"a": 0, "##b": 1, "ab": 2}}}
    assert configured.tokenize(docs, flota).first().tokens == ["a", "##b", "ab"]
    with pytest.raises(ValueError):
        configured.model({"type": "other", "vocab": {}})
