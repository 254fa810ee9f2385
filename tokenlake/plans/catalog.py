"""All registered queries of the engine's own operators, with their DuckDB equivalents.

Every query runs over whole tables. Doubles are rounded to six digits; counts are BIGINT; ties are broken in full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions import alphabet, normalise
from tokenlake.functions import text as tx
from tokenlake.operators import bytearrays, configured, counting, encoders, evaluation, incremental, merges, ngrams, ordered, spans, stats, subsets, vocabulary
from tokenlake.plans import oracles
from tokenlake.session import ship_package
from tokenlake.sources.io import materialise, read_table

_QUERIES: dict = {}
LANGUAGES = ["en", "fr", "de", "es"]
#: Common pairs and endings that the encoder queries' vocabulary holds besides what the corpus gives.
PIECES = ["th", "he", "in", "er", "an", "re", "nd", "on", "en", "at", "the", "and", "ing", "ion", "tion", "ent", "for", "le", "de", "es", "ou"]
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FREQUENT_WORDS = 400
SIXES = 6


def query(function):
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracles.SQL.items() if name in _QUERIES}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return read_table(spark, sf_dir, "documents")


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def _round(c, name: str):
    return F.round(c, SIXES).alias(name)


def _words(docs: DataFrame, *by: str) -> DataFrame:
    """(by, pretoken, n): what lies between white space in the lower-cased texts."""
    word = F.explode(normalise.pre_tokenize(F.lower("text"), "WhitespaceSplit")).alias("pretoken")
    return docs.select(*by, word).groupBy(*by, "pretoken").agg(F.count(F.lit(1)).alias("n"))


def _vocabulary(words: DataFrame) -> list[str]:
    """Pieces that the corpus gives: every character, its most frequent words of 2 to 12 characters, and ``PIECES``."""
    chars = [r.c for r in words.select(F.explode(F.split("pretoken", "")).alias("c")).distinct().collect()]  # an alphabet
    often = words.where(F.length("pretoken").between(2, 12)).groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(FREQUENT_WORDS)
    return [*dict.fromkeys([*chars, *PIECES, *(r.pretoken for r in often.collect())])]


@query
def pretoken_topk(spark, sf_dir):
    return counting.top(tx.dictionary(_docs(spark, sf_dir)), 50, "n", "pretoken")


@query
def pretoken_count_by_lang(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.groupBy("lang").agg(F.sum(F.size(tx.pretokens(F.col("text")))).alias("n_pretokens"))


@query
def pretoken_boundaries_sum(spark, sf_dir):
    flags = tx.boundary_flags(F.col("text"))
    rows = _docs(spark, sf_dir).select("lang", "text", flags.alias("flags"))
    starts = F.aggregate("flags", F.lit(0), lambda a, x: a + x.cast("int"))
    return rows.groupBy("lang").agg(F.sum(F.size("flags")).alias("n_bytes"), F.sum(starts).alias("n_starts"))


@query
def byte_unigrams(spark, sf_dir):
    return counting.byte_unigrams(tx.dictionary(_docs(spark, sf_dir)))


@query
def byte_unigrams_by_lang(spark, sf_dir):
    return counting.byte_unigrams(tx.dictionary(_docs(spark, sf_dir), "lang"), "lang")


@query
def byte_pairs_topk(spark, sf_dir):
    return counting.top(counting.adjacent_pairs(tx.dictionary(_docs(spark, sf_dir))), 100, "n", "left", "right")


@query
def byte_pair_scores(spark, sf_dir):
    words = tx.dictionary(_docs(spark, sf_dir))
    scored = counting.pair_scores(counting.adjacent_pairs(words), counting.byte_unigrams(words))
    return scored.select("left", "right", "n", F.round(F.col("score") * 1e6, SIXES).alias("score_ppm"))


@query
def byte_encode_roundtrip(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("lang", tx.prefixed(F.col("text")).alias("t"), tx.byte_ids(F.col("text")).alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy("lang").agg(F.sum(F.size("ids")).alias("num_tokens"), F.sum(total).alias("id_sum"), F.sum((tx.decode_ids(F.col("ids")) == F.col("t")).cast("long")).alias("same"))


def _byte_encoded(docs: DataFrame, *by: str) -> DataFrame:
    """Each pre-token encoded alone, behind a forced space."""
    words = tx.dictionary(docs, *by)
    return words.withColumn("ids", tx.byte_ids(F.col("pretoken")))


@query
def bytelevel_fertility_by_lang(spark, sf_dir):
    found = stats.fertility(stats.split_histogram(_byte_encoded(_docs(spark, sf_dir), "lang"), ("lang",)), ("lang",))
    return found.select("lang", _round(F.col("fertility"), "fertility"), _round(F.col("proportion_continued"), "proportion_continued"), *_long("total_split_words", "total_words", "total_subwords"))


@query
def tokenizer_statistics_bytelevel(spark, sf_dir):
    out = stats.tokenizer_statistics(_byte_encoded(_docs(spark, sf_dir), "lang"), "bytelevel", by=("lang",))
    return out.select("lang", "tokenizer_name", _round(F.col("fertility"), "fertility"), *_long("total_words", "total_tokens", "total_subwords", "unique_tokens", "num_unk"), _round(F.col("renyi_efficiency"), "renyi_efficiency"))


@query
def split_length_histogram(spark, sf_dir):
    return stats.split_histogram(_byte_encoded(_docs(spark, sf_dir))).select(*_long("length", "n"))


@query
def renyi_by_lang(spark, sf_dir):
    counts = counting.byte_unigrams(tx.dictionary(_docs(spark, sf_dir), "lang"), "lang")
    return stats.renyi_efficiency(counts, ("lang",)).select("lang", _round(F.col("renyi_efficiency"), "renyi_efficiency"))


@query
def renyi_words_by_source(spark, sf_dir):
    return stats.renyi_efficiency(tx.dictionary(_docs(spark, sf_dir), "source"), ("source",)).select("source", _round(F.col("renyi_efficiency"), "renyi_efficiency"))


@query
def whitespace_fertility(spark, sf_dir):
    found = stats.whitespace_fertility(_docs(spark, sf_dir), F.size(tx.pretokens(F.col("text"))), ("lang",))
    return found.select("lang", _round(F.col("fertility"), "fertility"))


def _quota(spark, sf_dir, shift):
    return subsets.language_quota(_docs(spark, sf_dir), ["en", "fr", "es"], 100_000, shift).select("doc_id", "lang", "num_tokens")


@query
def lang_quota_subset(spark, sf_dir):
    return _quota(spark, sf_dir, 0)


@query
def lang_quota_subset_shift1(spark, sf_dir):
    return _quota(spark, sf_dir, 1)


@query
def lang_quota_totals(spark, sf_dir):
    return _quota(spark, sf_dir, 0).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("num_tokens").alias("tokens"))


@query
def row_page_shift2(spark, sf_dir):
    return ordered.page(_docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id", 50, 2)


@query
def ordinal_split_counts(spark, sf_dir):
    rows = ordered.split_at(_docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id", 150)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query
def first_hundredth(spark, sf_dir):
    return ordered.head_share(_docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")


@query
def mod_shard(spark, sf_dir):
    return ordered.mod_shard(_docs(spark, sf_dir).select("doc_id"), "doc_id", 8, 3)


def _offsets(spark, sf_dir):
    return ordered.doc_offsets(_docs(spark, sf_dir).select("doc_id", subsets.byte_length(F.col("text")).alias("len")), F.col("len"))


@query
def doc_offsets(spark, sf_dir):
    return _offsets(spark, sf_dir).select("doc_id", "first_pos", "end_pos")


@query
def asof_doc_lookup(spark, sf_dir):
    at = spark.range(0, 200).select((F.col("id") * 1009).alias("position"))
    return ordered.locate(at, _offsets(spark, sf_dir)).select("position", "doc_id", (F.col("position") - F.col("first_pos")).alias("pos_in_doc"))


@query
def packed_sequences_checksum(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", tx.byte_ids(F.col("text")).alias("input_ids"))
    parts = subsets.packed_slices(docs, 2049)
    total = lambda value: F.aggregate(F.transform("part", value), F.lit(0).cast("long"), lambda a, x: a + x)
    sums = parts.select("sequence", total(lambda t: t).alias("s"), total(lambda t, i: t * (i + 1 + F.col("slot"))).alias("w"), total(lambda t: (t == alphabet.EOS_ID).cast("int")).alias("e"))
    return sums.groupBy("sequence").agg(F.sum("s").alias("token_sum"), F.sum("w").alias("weighted"), F.sum("e").alias("n_eod"))


@query
def ngram_counts_o1_o3(spark, sf_dir):
    table = ngrams.counts(_docs(spark, sf_dir), [1, 2, 3])
    return table.groupBy("order").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), F.sum(F.col("n") * F.col("n")).cast("long").alias("squares"))


@query
def ngram_topk_o5(spark, sf_dir):
    table = ngrams.counts(_docs(spark, sf_dir), [5]).withColumn("gram", F.array_join(F.concat("context", F.array("word")), " "))
    return table.orderBy(F.desc("n"), "gram").limit(30).select("gram", "n")


@query
def ngram_merge_partials(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    parts = [ngrams.counts(docs.where(F.col("doc_id") % 2 == k), [2]) for k in (0, 1)]
    return ngrams.merge(*parts).agg(F.count(F.lit(1)).alias("types"), F.sum("n").cast("long").alias("tokens"), F.max("n").alias("most"))


def _ngram_scores(docs, *orders):
    return ngrams.probabilities(materialise(ngrams.counts(docs, list(orders)), "ngrams"))


@query
def bigram_surprisal(spark, sf_dir):
    two = _ngram_scores(_docs(spark, sf_dir), 1, 2).where(F.col("order") == 2)
    return two.select(F.get("context", F.lit(0)).alias("before"), F.col("word"), "n", F.round(-F.log2("p"), SIXES).alias("surprisal"))


@query
def bigram_entropy(spark, sf_dir):
    scores = _ngram_scores(_docs(spark, sf_dir), 1, 2)
    return scores.where(F.col("order") == 2).select(F.get("context", F.lit(0)).alias("before"), F.round("entropy", SIXES).alias("entropy")).distinct()


@query
def space_nll(spark, sf_dir):
    scores = _ngram_scores(_docs(spark, sf_dir), 1, 2)
    return ngrams.byte_probability(scores, 2, 32).select(F.get("context", F.lit(0)).alias("before"), F.round("nll", SIXES).alias("nll"))


@query
def backoff_scores_by_lang(spark, sf_dir):
    """One half of the documents scored with the other half's table: what it has not seen backs off."""
    docs = _docs(spark, sf_dir)
    scores = materialise(_ngram_scores(docs.where(F.col("doc_id") % 2 == 0), 1, 2, 3), "scores")
    rows = ngrams.score_corpus(docs.where(F.col("doc_id") % 2 == 1), scores, 3).join(docs.select("doc_id", "lang"), "doc_id")
    unseen = F.sum((F.col("surprisal") == float("inf")).cast("long"))
    means = (F.round(F.avg(F.when(F.col(c) < float("inf"), F.col(c))), SIXES).alias(c) for c in ("surprisal", "entropy", "space_nll", "eos_nll"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_bytes"), unseen.alias("n_unseen"), *means)


@query
def bits_per_byte_by_lang(spark, sf_dir):
    """Mean bits a byte of each document by trigrams of the corpus, as mean and deviation over the documents of a language."""
    docs = _docs(spark, sf_dir)
    scores = materialise(_ngram_scores(docs, 1, 2, 3), "scores")
    rows = ngrams.score_corpus(docs, scores, 3).groupBy("doc_id").agg((F.avg("surprisal") * F.log(F.lit(2.0))).alias("loss"), F.count(F.lit(1)).alias("num_tokens"))
    rows = rows.withColumn("num_bytes", F.col("num_tokens")).join(docs.select("doc_id", "lang"), "doc_id")
    return stats.bits_per_byte(rows, by=("lang",)).select("lang", *(_round(F.col(c), c) for c in ("bpb_mean", "bpb_std", "perplexity_mean", "perplexity_std")))


@query
def fivegram_surprisal_by_lang(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    scores = materialise(ngrams.probabilities(materialise(ngrams.counts(docs, [1, 2, 3, 4, 5]), "ngrams")), "scores")
    rows = ngrams.score_corpus(docs, scores, 5).join(docs.select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_bytes"), F.round(F.avg("surprisal"), SIXES).alias("surprisal"), F.round(F.avg("entropy"), SIXES).alias("entropy"))


def _signal(docs: DataFrame) -> DataFrame:
    """Documents as byte arrays with a signal that needs no logarithm: how often a byte follows its predecessor, rarer is higher."""
    pairs = ngrams.counts(docs, [2]).where(F.col("word") < 256).select(F.get("context", F.lit(0)).alias("before"), "word", "n")
    table = np.zeros((257, 256))
    for r in pairs.collect():  # at most 257 x 256 rows
        table[r.before, r.word] = r.n
    table = np.where(table > 0, np.floor(table.sum(1, keepdims=True) * 1000 / np.maximum(table, 1)), 0.0)
    arrays = bytearrays.by_document(docs, "doc_id", "lang")
    return bytearrays.with_signal(arrays, lambda data: table[np.concatenate([[256], data[:-1]]) if len(data) else data, data])


@query
def signal_percentile(spark, sf_dir):
    rows = _signal(_docs(spark, sf_dir)).select(F.explode("signal").alias("v")).where("v <> 0")
    found = tuple(round(spans.percentile(rows, p), SIXES) for p in (0.3, 0.9))
    return spark.createDataFrame([found], "p30 double, p90 double")


def _spans(spark, sf_dir, threshold):
    rows = _signal(_docs(spark, sf_dir))
    return spans.find_in_arrays(rows, spans.signal_percentile(rows, threshold) if threshold else None)


def _span_summary(found):
    size = F.col("stop") - F.col("start") + 1
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(size).alias("covered"), F.sum(F.col("start") * size).alias("weighted"), F.sum(F.col("token_start").cast("long")).alias("n_token_starts"))


@query
def spans_monotonic(spark, sf_dir):
    return _span_summary(_spans(spark, sf_dir, None))


@query
def spans_combined(spark, sf_dir):
    return _span_summary(_spans(spark, sf_dir, 30))


@query
def span_length_hist(spark, sf_dir):
    found = _spans(spark, sf_dir, None)
    return found.groupBy((F.col("stop") - F.col("start") + 1).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def _span_counts(spark, sf_dir):
    return _spans(spark, sf_dir, None).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


def _known(spark):
    """Single bytes, at word starts and inside."""
    hexes = spark.range(256).select(F.lpad(F.hex("id"), 2, "0").alias("h"))
    return hexes.select(F.explode(F.array("h", F.concat(F.lit("##"), F.col("h")))).alias("token"))


@query
def span_vocab_topk(spark, sf_dir):
    counts = _span_counts(spark, sf_dir).groupBy("token").agg(F.sum("n").alias("n"))
    return vocabulary.by_frequency(counts, _known(spark), 200)


@query
def span_vocab_by_lang(spark, sf_dir):
    counts = _span_counts(spark, sf_dir)
    return counts.groupBy("lang").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("spans"), F.max("n").alias("most"))


@query
def span_vocab_round_robin(spark, sf_dir):
    return vocabulary.round_robin(_span_counts(spark, sf_dir), _known(spark), 100, LANGUAGES).select(F.col("place").cast("long").alias("place"), "token")


@query
def segment_net_counts(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("segment"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("delta"), "event_id")
    return spans.net_counts(rows, ["event_id"]).select("segment", *_long("n"))


@query
def bpe_merges_k(spark, sf_dir):
    words = tx.dictionary(_docs(spark, sf_dir))
    found = [tuple(m) for m in merges.train(words, alphabet.SIZE + 30)]
    return spark.createDataFrame(found, "rank int, left int, right int, joined int, num_merges long")


@query
def mutual_information_merges(spark, sf_dir):
    found = merges.train(tx.dictionary(_docs(spark, sf_dir)), alphabet.SIZE + 8, 200, measure=merges.MUTUAL_INFORMATION)
    return spark.createDataFrame([tuple(m) for m in found], "rank int, left int, right int, joined int, num_merges long")


@query
def bpe_vocab_after_k(spark, sf_dir):
    names = merges.tokens(merges.train(tx.dictionary(_docs(spark, sf_dir)), alphabet.SIZE + 200))
    return alphabet.vocab_frame(spark, names)


@query
def bpe_first_merges(spark, sf_dir):
    """The first three merges by Spark rounds alone."""
    found = merges.train(tx.dictionary(_docs(spark, sf_dir)), alphabet.SIZE + 3, driver_words=0)
    names = merges.tokens(found)
    rows = [(m.rank, alphabet.to_bytes(names[m.joined]).hex().upper(), m.num_merges) for m in found]
    return spark.createDataFrame(rows, "rank long, joined_hex string, num_merges long")


@query
def threshold_vocab(spark, sf_dir):
    return incremental.vocabulary(_signal(_docs(spark, sf_dir)), 5, 500)


def _encoded(spark, sf_dir, build, *by):
    """All words of the texts, encoded by what ``build`` makes of the corpus's vocabulary, marked for continuations too."""
    words = materialise(_words(_docs(spark, sf_dir), *by), "words")
    names = _vocabulary(words)
    return encoders.encode_words(words, build([*names, *("##" + n for n in names)]))


def _encode_stats(rows):
    tokens = F.size("tokens")
    return rows.groupBy("lang").agg(F.sum("n").alias("words"), F.sum(tokens * F.col("n")).cast("long").alias("tokens"), F.sum(F.when(tokens > 1, F.col("n")).otherwise(0)).alias("split_words"), F.count(F.lit(1)).alias("types"))


@query
def wordpiece_encode_stats(spark, sf_dir):
    return _encode_stats(_encoded(spark, sf_dir, encoders.wordpiece, "lang"))


@query
def suffix_encode_stats(spark, sf_dir):
    return _encode_stats(_encoded(spark, sf_dir, encoders.longest_suffix, "lang"))


@query
def flota_encode_stats(spark, sf_dir):
    return _encode_stats(_encoded(spark, sf_dir, encoders.longest_substring, "lang"))


@query
def wordlevel_encode_stats(spark, sf_dir):
    rows = _encoded(spark, sf_dir, encoders.word_level, "lang")
    known = F.get("tokens", F.lit(0)) != "<unk>"
    return rows.groupBy("lang").agg(F.sum("n").alias("words"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known_words"))


@query
def unigram_encode_stats(spark, sf_dir):
    scores = {p: -float(i + 1) for i, p in enumerate([*PIECES, *LETTERS])}
    return _encode_stats(_encoded(spark, sf_dir, lambda _: encoders.unigram(scores), "lang"))


@query
def configured_encode_stats(spark, sf_dir):
    """A tokenizer from one configuration: the corpus's vocabulary, greedy, behind normalisers and pre-tokenizers in sequence."""
    docs = _docs(spark, sf_dir)
    names = _vocabulary(_words(docs))
    steps = [{"type": "WhitespaceSplit"}, {"type": "Digits", "individual_digits": False}]
    config = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "Replace", "pattern": {"String": "%%%"}, "content": ""}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps},
        "model": {"type": "Greedy_BPE", "vocab": {n: i for i, n in enumerate([*names, *("##" + n for n in names)])}, "unk_token": "<unk>"},
    }
    return _encode_stats(configured.encode_dictionary(materialise(configured.dictionary(docs, config, "lang"), "pieces"), config))


@query
def segmentation_diff(spark, sf_dir):
    one = _encoded(spark, sf_dir, encoders.wordpiece).withColumnRenamed("tokens", "one")
    names = _vocabulary(one.select("pretoken", "n"))
    both = encoders.encode_words(one, encoders.longest_suffix([*names, *("##" + n for n in names)])).withColumnRenamed("tokens", "other")
    return evaluation.difference_rate(both, "one", "other").select(_round(F.col("rate"), "rate"))


def _cuts(word, *ends):
    """A rule segmentation: the word's head, and its first matching ending."""
    pattern = f"^(.+?)({'|'.join(ends)})?$"
    return F.filter(F.array(F.regexp_extract(word, pattern, 1), F.regexp_extract(word, pattern, 2)), lambda x: x != "")


@query
def boundary_f1_by_source(spark, sf_dir):
    """A greedy encoder's cuts against a rule's, over all words."""
    words = _encoded(spark, sf_dir, encoders.wordpiece, "source")
    found = F.when(F.length("pretoken") <= encoders.LONGEST_WORD, F.transform("tokens", lambda t: F.regexp_replace(t, "^##(?=.)", ""))).otherwise(F.array("pretoken"))
    words = words.withColumn("gold", _cuts(F.col("pretoken"), "tion", "ing", "es")).withColumn("predicted", found)
    return evaluation.boundary_f1(evaluation.boundary_counts(words, "gold", "predicted"), "source").select("source", _round(F.col("f1"), "f1"))


def _lexical(spark, sf_dir):
    """Documents as stimuli: quality for lexicality, mean pre-token bytes for reading time, toxicity for accuracy."""
    docs = _docs(spark, sf_dir).join(read_table(spark, sf_dir, "labels"), "doc_id")
    n = F.size(tx.pretokens(F.col("text")))
    rows = docs.select("doc_id", "text", F.when(F.col("quality") == 1, "W").otherwise("N").alias("lexicality"), F.col("n_chars").cast("double").alias("rt"), F.col("toxic").cast("double").alias("accuracy"), n.alias("n_tokens"))
    return evaluation.lexical_measures(rows, "text", F.col("n_tokens")).withColumn("num_splits", F.col("num_splits").cast("double"))


@query
def chunkability_stats(spark, sf_dir):
    return evaluation.category_stats(_lexical(spark, sf_dir), "chunkability", "lexicality").select("lexicality", _round(F.col("mean"), "mean"), _round(F.col("std"), "std"))


def _corr(spark, sf_dir):
    return evaluation.correlations(_lexical(spark, sf_dir), ("lexicality",), ("num_splits", "chunkability"), ("rt", "accuracy"))


@query
def chunkability_corr(spark, sf_dir):
    names = [f"{x}_{y}" for x in ("num_splits", "chunkability") for y in ("rt", "accuracy")]
    return _corr(spark, sf_dir).select("lexicality", *(_round(F.col(c), c) for c in names))


@query
def cog_score(spark, sf_dir):
    scored = evaluation.cognitive_score(_corr(spark, sf_dir), ["num_splits_rt", "num_splits_accuracy", "chunkability_rt", "chunkability_accuracy"])
    return scored.select("lexicality", _round(F.col("score"), "score"))


def _lang_vocab(docs, lang, k=2000):
    return counting.top(tx.dictionary(docs.where(F.col("lang") == lang)), k, "n", "pretoken").select(F.col("pretoken").alias("token"))


@query
def vocab_overlap(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return vocabulary.overlap_percent(_lang_vocab(docs, "en"), _lang_vocab(docs, "fr")).select(_round(F.col("overlap"), "overlap"))


@query
def vocab_length_hist(spark, sf_dir):
    return vocabulary.length_histogram(_lang_vocab(_docs(spark, sf_dir), "en")).select(*_long("length", "n"))


@query
def anti_join_todo(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    names = lambda c: c.select(F.col("source").alias("tokenizer_name")).distinct()
    return vocabulary.todo(names(docs), names(docs.where(F.col("n_chars") > 10_000)))


@query
def name_canonicalise(spark, sf_dir):
    raw = _docs(spark, sf_dir).select(F.concat(F.col("lang"), F.lit("_byte-span_"), F.col("source").substr(4, 2).cast("int") * 1000).alias("raw")).distinct()
    return raw.select("raw", vocabulary.canonical_name(F.col("raw")).alias("name"))


@query
def jsonl_explode(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return events.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


@query
def turns_list_explode(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    listed = rows.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))).alias("line"))
    back = listed.select("conv_id", F.inline(F.from_json("line", "array<struct<turn:bigint,role:string,text:string>>")))
    return back.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), F.sum("turn").alias("turn_sum"))


@query
def text_normalise(spark, sf_dir):
    text = normalise.chain(F.col("text"), "StripAccents", "Lowercase", ("Replace", {"pattern": "%%%", "content": ""}), "Strip")
    return _docs(spark, sf_dir).select("doc_id", F.md5(text).alias("digest"), F.length(text).cast("long").alias("n"))


@query
def pre_tokenizers(spark, sf_dir):
    kinds = ("WhitespaceSplit", "Digits", "Metaspace")
    rows = _docs(spark, sf_dir)
    return rows.groupBy("lang").agg(*(F.sum(F.size(normalise.pre_tokenize(F.col("text"), k))).alias(f"n_{k.lower()}") for k in kinds))


@query
def embedding_window_sum(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings")
    starts = F.sequence(F.lit(0), F.size("embedding") - 8, F.lit(4))
    windows = rows.select("vec_id", "embedding", F.explode(starts).alias("start"))
    total = F.aggregate(F.slice("embedding", F.col("start") + 1, 8), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return windows.groupBy(F.col("start").cast("long").alias("start")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 3).alias("window_sum"))
