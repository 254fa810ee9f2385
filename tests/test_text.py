from pyspark.sql import functions as F

from tokenlake.functions import alphabet, normalise
from tokenlake.functions import text as tx


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_alphabet():
    assert alphabet.BYTE_ID[ord("!")] == 2 and alphabet.SPACE_ID == 222 and alphabet.NEWLINE_ID == 200
    assert alphabet.SIZE == 258 and len(alphabet.threshold_vocab()) == 699 and len(alphabet.span_vocab()) == 770
    assert alphabet.to_bytes(alphabet.to_chars(bytes(range(256)))) == bytes(range(256))


def test_pretokens(spark):
    assert one(spark, tx.pretokens(F.lit("a　　b"))) == [" a", "　", "　", "b"]
    assert one(spark, tx.pretokens(F.lit(" x"))) == [" ", " ", "x"]
    assert one(spark, tx.pretokens(F.lit(""))) == []
    assert one(spark, tx.pretokens(F.lit("I'm  here 12!"))) == [" I", "'m", " ", " here", " 12", "!"]


def test_bytes_round_trip(spark):
    for text in ("", " a", "é€\U0001f600\n", "x" * 1000):
        ids = one(spark, tx.byte_ids(F.lit(text)))
        want = text if text == "" or text.startswith(" ") else " " + text
        assert ids == [alphabet.BYTE_ID[b] for b in want.encode()]
        assert one(spark, tx.decode_ids(tx.byte_ids(F.lit(text)))) == want
        assert len(one(spark, tx.boundary_flags(F.lit(text)))) == len(want.encode())


def test_byte_rows_of_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "ab")], "doc_id long, text string")
    assert [(r.doc_id, r.pos, r.byte, r.is_start) for r in tx.byte_rows(docs, "doc_id").orderBy("pos").collect()] == [(3, 0, 32, True), (3, 1, 97, False), (3, 2, 98, False)]


def test_normalisers(spark):
    assert one(spark, normalise.normalise(F.lit("Été"), "StripAccents")) == "Ete"
    assert one(spark, normalise.chain(F.lit("  ÀB  "), "Lowercase", "Strip", "NFD")) == "àb"
    assert one(spark, normalise.normalise(F.lit("你a B\u0000"), "Bert")) == " 你 a b"
    assert one(spark, normalise.normalise(F.lit("a​b\u0007"), "Nmt")) == "a b"


def test_pre_tokenizers(spark):
    text = F.lit("Hey, you2 there")
    assert one(spark, normalise.pre_tokenize(text, "Whitespace")) == ["Hey", ",", "you2", "there"]
    assert one(spark, normalise.pre_tokenize(text, "Digits")) == ["Hey, you", "2", " there"]
    assert one(spark, normalise.pre_tokenize(text, "Metaspace")) == ["▁Hey,", "▁you2", "▁there"]
    assert one(spark, normalise.pre_tokenize(text, "CharDelimiterSplit", delimiter="e")) == ["H", "y, you2 th", "r"]
    assert one(spark, normalise.pre_tokenize(F.lit("ab!c"), "Punctuation")) == ["ab", "!", "c"]
