"""DuckDB SQL of the registered queries."""

from __future__ import annotations

#: Prefixed text; pre-tokens (the pattern has no look-ahead there, so a mark is set before a last blank); bytes.
_PRE = r"""
texts AS (SELECT doc_id, lang, source, CASE WHEN text = '' OR starts_with(text, ' ') THEN text ELSE ' ' || text END AS t FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, lang, source, regexp_extract_all(regexp_replace(t, '([\s\x0b\x{85}\p{Z}])([^\s\x0b\x{85}\p{Z}])', chr(1) || '\1\2', 'g'),
  '''s|''t|''re|''ve|''m|''ll|''d|\x01? ?\p{L}+|\x01? ?\p{N}+|\x01? ?[^\s\x0b\x{85}\p{Z}\p{L}\p{N}\x01]+|\x01[\s\x0b\x{85}\p{Z}]|[\s\x0b\x{85}\p{Z}]+') AS ps FROM texts),
pre AS (SELECT doc_id, lang, source, replace(unnest(ps), chr(1), '') AS pretoken, unnest(range(len(ps))) AS k FROM pieces)
"""
_WORDS = _PRE + """,
words AS (SELECT lang, source, pretoken, count(*) AS n FROM pre GROUP BY ALL),
raw AS (SELECT lang, source, pretoken, n, hex(encode(pretoken)) AS h FROM words),
bytes AS (SELECT lang, source, n, h, unnest(range(length(h) // 2)) AS i FROM raw),
uni AS (SELECT lang, source, n, h, i, ('0x' || substr(h, 2 * i + 1, 2))::INT AS byte FROM bytes)
"""
#: One row a byte of the corpus: document, position, byte, start of a pre-token.
_ROWS = _PRE + """,
lens AS (SELECT doc_id, lang, k, pretoken, strlen(pretoken) AS n FROM pre),
hexed AS (SELECT doc_id, lang, hex(encode(t)) AS h FROM texts),
starts AS (SELECT doc_id, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM lens),
places AS (SELECT doc_id, lang, h, unnest(range(length(h) // 2)) AS pos FROM hexed),
brow AS (SELECT p.doc_id, p.lang, p.pos, ('0x' || substr(h, 2 * p.pos::INT + 1, 2))::INT AS byte, s.pos IS NOT NULL AS is_start
  FROM places p LEFT JOIN starts s ON p.doc_id = s.doc_id AND p.pos = s.pos)
"""
_SIGNAL = _ROWS + """,
prev AS (SELECT *, lag(byte, 1, 256) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM brow),
freq AS (SELECT before, byte, count(*) AS n, sum(count(*)) OVER (PARTITION BY before) AS total FROM prev GROUP BY before, byte),
sig AS (SELECT p.doc_id, p.lang, p.pos, p.byte, p.is_start, p.before, floor(f.total * 1000 / f.n)::DOUBLE AS signal FROM prev p JOIN freq f ON p.before = f.before AND p.byte = f.byte)
"""


def _spans(low: str) -> str:
    return _SIGNAL + f""",
tau AS (SELECT quantile_cont(signal, 0.3) AS v FROM sig WHERE signal <> 0),
m1 AS (SELECT sig.*, NOT (coalesce(signal - lag(signal) OVER w < 0, false) OR {low}) AS mask, sum(is_start::INT) OVER w AS pretoken, lag(byte) OVER w AS prior FROM sig, tau WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
m2 AS (SELECT *, mask <> lead(mask, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) AS flip FROM m1),
flips AS (SELECT *, row_number() OVER w AS k, lead(pos) OVER w AS stop, lead(is_start) OVER w AS stop_is_start FROM m2 WHERE flip WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
raw_spans AS (SELECT doc_id, pos - CASE WHEN NOT is_start AND prior = 32 THEN 1 ELSE 0 END AS a, stop - CASE WHEN stop_is_start THEN 1 ELSE 0 END AS b FROM flips WHERE k % 2 = 1 AND stop IS NOT NULL),
cut AS (SELECT s.doc_id, s.a, s.b, m.pretoken, min(m.pos) AS start, max(m.pos) AS stop, arg_min(m.is_start, m.pos) AS token_start
  FROM raw_spans s JOIN m2 m ON m.doc_id = s.doc_id AND m.pos BETWEEN s.a AND s.b WHERE s.a < s.b GROUP BY s.doc_id, s.a, s.b, m.pretoken),
found AS (SELECT doc_id, start, stop, token_start FROM cut WHERE stop < b OR stop > start)
"""


_TOKENS = _spans("false") + """,
named AS (SELECT x.lang, CASE WHEN token_start THEN '' ELSE '##' END || substr(h, (2 * start + 1)::INT, (2 * (stop - start + 1))::INT) AS token FROM found JOIN hexed x USING (doc_id)),
counts AS (SELECT lang, token, count(*) AS n FROM named GROUP BY ALL)
"""
_SUMMARY = "SELECT doc_id, count(*) AS n_spans, sum(stop - start + 1)::BIGINT AS covered, sum(start * (stop - start + 1))::BIGINT AS weighted, sum(token_start::INT)::BIGINT AS n_token_starts FROM found GROUP BY doc_id"
_QUOTA = """
len AS (SELECT doc_id, lang, strlen(CASE WHEN text = '' OR starts_with(text, ' ') THEN text ELSE ' ' || text END) AS num_tokens FROM documents WHERE lang IN ('en', 'fr', 'es')),
run AS (SELECT *, sum(num_tokens) OVER (PARTITION BY lang ORDER BY doc_id) AS after FROM len)
"""
_OFFSETS = """
len AS (SELECT doc_id, strlen(CASE WHEN text = '' OR starts_with(text, ' ') THEN text ELSE ' ' || text END) AS n FROM documents),
off AS (SELECT doc_id, n, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS first_pos, (sum(n) OVER (ORDER BY doc_id))::BIGINT AS end_pos FROM len)
"""


def _grams(order: int) -> str:
    """Padded symbols of each document as (doc_id, i, s)."""
    return f"""
hexed AS (SELECT doc_id, hex(encode(CASE WHEN text = '' OR starts_with(text, ' ') THEN text ELSE ' ' || text END)) AS h FROM documents),
sym AS (SELECT doc_id, list_transform(range({order - 1}), lambda x: 256) || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT) || list_transform(range({order - 1}), lambda x: 257) AS s FROM hexed),
flat AS (SELECT doc_id, unnest(s) AS w, unnest(range(len(s))) AS i FROM sym),
seq AS (SELECT doc_id, i, w{"".join(f", lag(w, {k}) OVER o AS w{k}" for k in range(1, max(order, 2)))} FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY i))
"""


_BIGRAMS = _grams(2) + """,
c1 AS (SELECT w, count(*) AS n FROM seq GROUP BY w), q1 AS (SELECT w, n / sum(n) OVER () AS q FROM c1),
h1 AS (SELECT sum(-q * log2(q)) AS h FROM q1),
c2 AS (SELECT w1 AS before, w AS word, count(*) AS n FROM seq WHERE i >= 1 GROUP BY ALL),
t2 AS (SELECT before, word, n, sum(n) OVER o AS total, count(*) OVER o AS types, q FROM c2 JOIN q1 ON q1.w = c2.word WINDOW o AS (PARTITION BY before)),
p2 AS (SELECT *, 0.75 * types / total AS gamma, greatest(n - 0.75, 0) / total + 0.75 * types / total * q AS p FROM t2)
"""


def _scored(train: str, test: str) -> str:
    """Interpolated trigram scores of the bytes of some documents by the counts of others, as (doc_id, surprisal, entropy, space, stop)."""
    back = "coalesce(p3.p, coalesce(g3.g, 1) * coalesce(p2.p, coalesce(g2.g, 1) * coalesce(p1.p, 0)))"
    fixed = lambda w: back.replace("p3.", f"x{w}.").replace("p2.", f"y{w}.").replace("p1.", f"z{w}.")
    joins = lambda w: f"LEFT JOIN p3 x{w} ON x{w}.b = k.b AND x{w}.a = k.a AND x{w}.w = {w} LEFT JOIN p2 y{w} ON y{w}.a = k.a AND y{w}.w = {w} LEFT JOIN p1 z{w} ON z{w}.w = {w}"
    return _grams(3) + f""",
tr AS (SELECT * FROM seq WHERE {train}), te AS (SELECT doc_id, w2 AS b, w1 AS a, w FROM seq WHERE {test} AND i >= 2 AND w < 256),
p1 AS (SELECT w, n / sum(n) OVER () AS p FROM (SELECT w, count(*) AS n FROM tr GROUP BY w)), h1 AS (SELECT sum(-p * log2(p)) AS h FROM p1),
c2 AS (SELECT w1 AS a, w, count(*) AS n FROM tr WHERE i >= 1 GROUP BY ALL), g2 AS (SELECT a, sum(n) AS total, 0.75 * count(*) / sum(n) AS g FROM c2 GROUP BY a),
p2 AS (SELECT c2.a, c2.w, greatest(n - 0.75, 0) / total + g * p1.p AS p FROM c2 JOIN g2 USING (a) JOIN p1 ON p1.w = c2.w),
d2 AS (SELECT g2.a, p1.w, coalesce(p2.p, g2.g * p1.p) AS p FROM g2 CROSS JOIN p1 LEFT JOIN p2 ON p2.a = g2.a AND p2.w = p1.w), h2 AS (SELECT a, sum(-p * log2(p)) AS h FROM d2 GROUP BY a),
c3 AS (SELECT w2 AS b, w1 AS a, w, count(*) AS n FROM tr WHERE i >= 2 GROUP BY ALL), g3 AS (SELECT b, a, sum(n) AS total, 0.75 * count(*) / sum(n) AS g FROM c3 GROUP BY b, a),
p3 AS (SELECT c3.b, c3.a, c3.w, greatest(n - 0.75, 0) / total + g * p2.p AS p FROM c3 JOIN g3 USING (b, a) JOIN p2 ON p2.a = c3.a AND p2.w = c3.w),
d3 AS (SELECT g3.b, g3.a, d2.w, coalesce(p3.p, g3.g * d2.p) AS p FROM g3 JOIN d2 USING (a) LEFT JOIN p3 ON p3.b = g3.b AND p3.a = g3.a AND p3.w = d2.w), h3 AS (SELECT b, a, sum(-p * log2(p)) AS h FROM d3 GROUP BY b, a),
k AS (SELECT DISTINCT b, a, w FROM te),
s AS (SELECT k.b, k.a, k.w, {back} AS p, {fixed(32)} AS sp, {fixed(257)} AS ep, coalesce(h3.h, h2.h, h1.h) AS entropy
  FROM k LEFT JOIN p3 ON p3.b = k.b AND p3.a = k.a AND p3.w = k.w LEFT JOIN g3 ON g3.b = k.b AND g3.a = k.a LEFT JOIN p2 ON p2.a = k.a AND p2.w = k.w LEFT JOIN g2 ON g2.a = k.a LEFT JOIN p1 ON p1.w = k.w
  {joins(32)} {joins(257)} LEFT JOIN h3 ON h3.b = k.b AND h3.a = k.a LEFT JOIN h2 ON h2.a = k.a CROSS JOIN h1),
scored AS (SELECT doc_id, CASE WHEN p > 0 THEN -log2(p) END AS surprisal, entropy, -log2(sp) AS space_nll, -log2(ep) AS eos_nll FROM te JOIN s ON te.b = s.b AND te.a = s.a AND te.w = s.w)
"""


_PIECES = ["th", "he", "in", "er", "an", "re", "nd", "on", "en", "at", "the", "and", "ing", "ion", "tion", "ent", "for", "le", "de", "es", "ou"]


def _encode(word: str = r"unnest(regexp_extract_all(lower(text), '[^\s\x0b\x{85}\p{Z}]+'))") -> str:
    """Words by language and source, the vocabulary, and in ``inside`` every piece of it inside a distinct word (start, length)."""
    split = r"unnest(regexp_extract_all(lower(text), '[^\s\x0b\x{85}\p{Z}]+'))"
    return f"""
every AS (SELECT {split} AS w FROM documents), base AS MATERIALIZED (SELECT lang, source, {word} AS w FROM documents),
counted AS MATERIALIZED (SELECT lang, w, count(*) AS n FROM base GROUP BY ALL), types AS MATERIALIZED (SELECT DISTINCT w FROM base),
vocab AS MATERIALIZED (SELECT unnest({_PIECES!r}) AS v UNION SELECT unnest(regexp_extract_all(w, '(?s).')) FROM (SELECT DISTINCT w FROM every)
  UNION (SELECT w FROM (SELECT w, count(*) AS n FROM every GROUP BY w) WHERE length(w) BETWEEN 2 AND 12 ORDER BY n DESC, w LIMIT 400)),
places AS (SELECT w, unnest(range(length(w))) AS a FROM types), subs AS MATERIALIZED (SELECT w, a, unnest(range(1, least(14, length(w) - a) + 1)) AS l FROM places), known AS MATERIALIZED (SELECT v FROM vocab UNION SELECT '##' || v FROM vocab),
inside AS MATERIALIZED (SELECT w, a::INT AS a, l::INT AS l FROM subs WHERE CASE WHEN a > 0 THEN '##' ELSE '' END || substr(w, (a + 1)::INT, l::INT) IN (SELECT v FROM known)),
heads AS MATERIALIZED (SELECT w, a, max(l) AS l FROM inside GROUP BY w, a), tails AS MATERIALIZED (SELECT w, a + l AS e, max(l) AS l FROM inside GROUP BY w, a + l)
"""


#: Greedy walks from the front and from the back, and longest pieces first.
_FRONT = """,
front AS (SELECT w, 0 AS a, 0 AS k, ''::VARCHAR AS cuts FROM types UNION ALL
  SELECT f.w, f.a + h.l, f.k + 1, CASE WHEN f.a + h.l < length(f.w) THEN f.cuts || ',' || (f.a + h.l) ELSE f.cuts END FROM front f JOIN heads h ON h.w = f.w AND h.a = f.a),
greedy AS (SELECT w, CASE WHEN length(w) > 100 THEN 1 ELSE k END AS tokens, CASE WHEN length(w) > 100 THEN 'unknown' ELSE cuts END AS cuts FROM front WHERE a = length(w))
"""
_BACK = """,
back AS (SELECT w, length(w)::INT AS e, 0 AS k, ''::VARCHAR AS cuts FROM types UNION ALL
  SELECT b.w, b.e - t.l, b.k + 1, CASE WHEN b.e - t.l > 0 THEN ',' || (b.e - t.l) || b.cuts ELSE b.cuts END FROM back b JOIN tails t ON t.w = b.w AND t.e = b.e),
peeled AS (SELECT w, k AS tokens, cuts FROM back WHERE e = 0)
"""
_LONGEST = """,
taken AS (SELECT w, w AS mask, 0 AS k FROM types UNION ALL
  SELECT w, substr(mask, 1, p.a) || repeat(chr(1), p.l) || substr(mask, p.a + p.l + 1) AS mask, k + 1 FROM (
    SELECT t.w, t.mask, t.k, arg_max({'a': i.a, 'l': i.l}, (i.l, -i.a)) AS p FROM taken t JOIN inside i ON i.w = t.w WHERE NOT contains(substr(t.mask, i.a + 1, i.l), chr(1)) GROUP BY t.w, t.mask, t.k)),
covered AS (SELECT w, max(k) AS tokens FROM taken GROUP BY w)
"""
_BEST = """,
score AS (SELECT v, -(row_number() OVER ())::DOUBLE AS s FROM (SELECT unnest(PIECES || list_transform(range(26), lambda i: chr((97 + i)::INT))) AS v)),
edges AS (SELECT w, a, (a + l)::INT AS e, s FROM subs JOIN score ON v = substr(w, (a + 1)::INT, l::INT)),
paths AS (SELECT w, 0 AS e, [0.0::DOUBLE] AS sc, [0] AS ct FROM types UNION ALL
  SELECT p.w, p.e + 1, list_append(any_value(sc), coalesce(max(sc[x.a + 1] + x.s), any_value(sc[p.e + 1]) - 57)), list_append(any_value(ct), coalesce(arg_max(ct[x.a + 1] + 1, (sc[x.a + 1] + x.s, -x.a)), any_value(ct[p.e + 1]) + 1))
  FROM paths p LEFT JOIN edges x ON x.w = p.w AND x.e = p.e + 1 WHERE p.e < length(p.w) GROUP BY p.w, p.e),
viterbi AS (SELECT w, ct[-1] AS tokens FROM paths WHERE e = length(w))
""".replace("PIECES", repr(_PIECES))


def _encode_summary(walk: str, done: str, **how: str) -> str:
    return f"WITH RECURSIVE {_encode(**how)}{walk} SELECT lang, sum(n)::BIGINT AS words, sum(tokens * n)::BIGINT AS tokens, coalesce(sum(n) FILTER (tokens > 1), 0)::BIGINT AS split_words, count(*) AS types FROM counted JOIN {done} USING (w) GROUP BY lang"


_ID = "CASE WHEN byte BETWEEN 33 AND 126 THEN byte - 31 WHEN byte BETWEEN 161 AND 172 THEN byte - 65 WHEN byte >= 174 THEN byte - 66 WHEN byte <= 32 THEN 190 + byte WHEN byte BETWEEN 127 AND 160 THEN 96 + byte ELSE 257 END"


def _merges(rounds: int, threshold: int, information: bool = False) -> str:
    """Merge rounds, each a few CTEs, over words written as ``<id><id>``; a run of one identifier becomes one."""
    out = _WORDS + f""",
w0 AS MATERIALIZED (SELECT string_agg('<' || {_ID} || '>', '' ORDER BY i) AS s, any_value(n) AS n FROM (SELECT h, i, byte, sum(n) AS n FROM uni GROUP BY ALL) GROUP BY h)"""
    for k in range(rounds):
        last = f"x{k} AS MATERIALIZED (SELECT p[i] AS l, p[i + 1] AS r, n FROM (SELECT p, n, unnest(range(1, len(p))) AS i FROM (SELECT regexp_extract_all(s, '<(\\d+)>', 1)::INT[] AS p, n FROM w{k} WHERE contains(s, '><'))))"
        score = "n::DOUBLE"
        joins = ""
        if information:
            last += f", u{k} AS MATERIALIZED (SELECT u, sum(n)::DOUBLE AS c FROM (SELECT unnest(regexp_extract_all(s, '<(\\d+)>', 1)::INT[]) AS u, n FROM w{k}) GROUP BY u)"
            score, joins = "n::DOUBLE / (a.c * b.c)", f" JOIN u{k} a ON a.u = l JOIN u{k} b ON b.u = r"
        out += f""",
{last},
b{k} AS MATERIALIZED (SELECT {k} AS rank, l, r, {258 + k} AS joined, n AS num_merges FROM (SELECT l, r, sum(n)::BIGINT AS n FROM x{k} GROUP BY l, r){joins} WHERE n >= {threshold} ORDER BY {score} DESC, r * {259 + k} + l LIMIT 1),
w{k + 1} AS MATERIALIZED (SELECT CASE WHEN l = r THEN regexp_replace(s, '(<' || l || '>)(<' || l || '>)+', '<' || joined || '>', 'g') ELSE replace(s, '<' || l || '><' || r || '>', '<' || joined || '>') END AS s, n FROM w{k}, b{k})"""
    return out


def _merge_rows(rounds: int) -> str:
    return " UNION ALL ".join(f'SELECT rank, l AS "left", r AS "right", joined, num_merges FROM b{k}' for k in range(rounds))


def _merge_names(rounds: int) -> str:
    """Hex of what each of the first merges joins."""
    out = f", t0 AS (SELECT id, upper(lpad(to_hex(byte), 2, '0')) AS h FROM (SELECT byte, {_ID} AS id FROM (SELECT unnest(range(256)) AS byte)))"
    for k in range(rounds):
        out += f", t{k + 1} AS (SELECT * FROM t{k} UNION ALL SELECT joined, a.h || c.h FROM b{k} JOIN t{k} a ON a.id = l JOIN t{k} c ON c.id = r)"
    rows = " UNION ALL ".join(f"SELECT rank, joined, num_merges FROM b{k}" for k in range(rounds))
    return out + f" SELECT rank::BIGINT AS rank, h AS joined_hex, num_merges FROM ({rows}) JOIN t{rounds} ON id = joined"


_CORR = r"""
lex AS (SELECT CASE WHEN quality = 1 THEN 'W' ELSE 'N' END AS lexicality, n_chars::DOUBLE AS rt, toxic::DOUBLE AS accuracy, c.n - 1.0::DOUBLE AS num_splits, CASE WHEN length(text) > 0 THEN 1 - c.n::DOUBLE / length(text) END AS chunkability
  FROM documents d JOIN labels USING (doc_id) JOIN (SELECT doc_id, count(*) AS n FROM pre GROUP BY doc_id) c USING (doc_id)),
found AS (SELECT lexicality, corr(num_splits, rt) AS num_splits_rt, corr(num_splits, accuracy) AS num_splits_accuracy, corr(chunkability, rt) AS chunkability_rt, corr(chunkability, accuracy) AS chunkability_accuracy FROM lex GROUP BY lexicality)
"""


def _top_vocab(lang: str) -> str:
    return f"(SELECT pretoken AS token, count(*) AS n FROM pre WHERE lang = '{lang}' GROUP BY 1 ORDER BY n DESC, token LIMIT 2000)"


_ENC = _PRE + ", enc AS (SELECT lang, pretoken, count(*) AS n, strlen(CASE WHEN starts_with(pretoken, ' ') THEN pretoken ELSE ' ' || pretoken END) AS length FROM pre GROUP BY lang, pretoken)"
_RENYI = "(log2(sum(n::DOUBLE ** 2.5)) - 2.5 * log2(sum(n))) / -1.5 / log2(count(*))"

SQL: dict[str, str] = {
    "pretoken_topk": f"WITH {_PRE} SELECT pretoken, count(*) AS n FROM pre GROUP BY 1 ORDER BY n DESC, pretoken LIMIT 50",
    "pretoken_count_by_lang": f"WITH {_PRE} SELECT lang, count(*) AS n_pretokens FROM pre GROUP BY 1",
    "pretoken_boundaries_sum": f"WITH {_PRE} SELECT lang, sum(strlen(pretoken))::BIGINT AS n_bytes, count(*) AS n_starts FROM pre GROUP BY 1",
    "byte_unigrams": f"WITH {_WORDS} SELECT byte, sum(n)::BIGINT AS n FROM uni GROUP BY 1",
    "byte_unigrams_by_lang": f"WITH {_WORDS} SELECT lang, byte, sum(n)::BIGINT AS n FROM uni GROUP BY 1, 2",
    "byte_pairs_topk": f"WITH {_WORDS} SELECT byte AS \"left\", ('0x' || substr(h, 2 * i + 3, 2))::INT AS \"right\", sum(n)::BIGINT AS n FROM uni WHERE 2 * i + 2 < length(h) GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 100",
    "byte_pair_scores": f"WITH {_WORDS}, one AS (SELECT byte, sum(n) AS n FROM uni GROUP BY 1), two AS (SELECT byte AS l, ('0x' || substr(h, 2 * i + 3, 2))::INT AS r, sum(n) AS n FROM uni WHERE 2 * i + 2 < length(h) GROUP BY 1, 2) SELECT l AS \"left\", r AS \"right\", two.n::BIGINT AS n, round(two.n::DOUBLE / (a.n::DOUBLE * b.n::DOUBLE) * 1e6, 6) AS score_ppm FROM two JOIN one a ON a.byte = l JOIN one b ON b.byte = r",
    "byte_encode_roundtrip": f"WITH {_WORDS}, docs AS (SELECT lang, count(*) AS same FROM documents GROUP BY 1) SELECT lang, sum(n)::BIGINT AS num_tokens, sum(n * CASE WHEN byte BETWEEN 33 AND 126 THEN byte - 31 WHEN byte BETWEEN 161 AND 172 THEN byte - 65 WHEN byte >= 174 THEN byte - 66 WHEN byte <= 32 THEN 190 + byte WHEN byte BETWEEN 127 AND 160 THEN 96 + byte ELSE 257 END)::BIGINT AS id_sum, any_value(same) AS same FROM uni JOIN docs USING (lang) GROUP BY lang",
    "bytelevel_fertility_by_lang": f"WITH {_ENC} SELECT lang, round(sum(length * n) / sum(n), 6) AS fertility, round(coalesce(sum(n) FILTER (length <> 1), 0) / sum(n), 6) AS proportion_continued, coalesce(sum(n) FILTER (length <> 1), 0)::BIGINT AS total_split_words, sum(n)::BIGINT AS total_words, sum(length * n)::BIGINT AS total_subwords FROM enc GROUP BY 1",
    "tokenizer_statistics_bytelevel": f"WITH {_ENC}, eb AS (SELECT lang, n, hex(encode(CASE WHEN starts_with(pretoken, ' ') THEN pretoken ELSE ' ' || pretoken END)) AS h FROM enc), ei AS (SELECT lang, n, h, unnest(range(length(h) // 2)) AS i FROM eb), ty AS (SELECT lang, substr(h, 2 * i + 1, 2) AS b, sum(n) AS n FROM ei GROUP BY 1, 2), rn AS (SELECT lang, count(*) AS unique_tokens, {_RENYI} AS r FROM ty GROUP BY 1) SELECT lang, 'bytelevel' AS tokenizer_name, round(sum(length * n) / sum(n), 6) AS fertility, sum(n)::BIGINT AS total_words, sum(strlen(pretoken) * n)::BIGINT AS total_tokens, sum(length * n)::BIGINT AS total_subwords, any_value(unique_tokens) AS unique_tokens, 0::BIGINT AS num_unk, round(any_value(r), 6) AS renyi_efficiency FROM enc JOIN rn USING (lang) GROUP BY lang",
    "split_length_histogram": f"WITH {_ENC} SELECT length::BIGINT AS length, sum(n)::BIGINT AS n FROM enc GROUP BY 1",
    "renyi_by_lang": f"WITH {_WORDS}, c AS (SELECT lang, byte, sum(n) AS n FROM uni GROUP BY 1, 2) SELECT lang, round({_RENYI}, 6) AS renyi_efficiency FROM c GROUP BY 1",
    "renyi_words_by_source": f"WITH {_PRE}, c AS (SELECT source, pretoken, count(*) AS n FROM pre GROUP BY 1, 2) SELECT source, round({_RENYI}, 6) AS renyi_efficiency FROM c GROUP BY 1",
    "whitespace_fertility": f"WITH {_PRE}, t AS (SELECT lang, count(*) AS t FROM pre GROUP BY 1), w AS (SELECT lang, sum(len(regexp_extract_all(text, '[^\\s\\x0b]+'))) AS w FROM documents GROUP BY 1) SELECT lang, round(t / w, 6) AS fertility FROM t JOIN w USING (lang)",
    "lang_quota_subset": f"WITH {_QUOTA} SELECT doc_id, lang, num_tokens FROM run WHERE after - num_tokens < 100000 AND after >= 0",
    "lang_quota_subset_shift1": f"WITH {_QUOTA} SELECT doc_id, lang, num_tokens FROM run WHERE after - num_tokens < 200000 AND after >= 100000",
    "lang_quota_totals": f"WITH {_QUOTA} SELECT lang, count(*) AS n_docs, sum(num_tokens)::BIGINT AS tokens FROM run WHERE after - num_tokens < 100000 GROUP BY 1",
    "row_page_shift2": "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100",
    "ordinal_split_counts": "WITH o AS (SELECT n_chars, row_number() OVER (ORDER BY doc_id) AS k FROM documents) SELECT CASE WHEN k <= 150 THEN 'train' ELSE 'validation' END AS split, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM o GROUP BY 1",
    "first_hundredth": "WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, n_chars FROM o WHERE k <= n // 100",
    "mod_shard": "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id FROM o WHERE k % 8 = 3 AND k // 8 < n // 8",
    "doc_offsets": f"WITH {_OFFSETS} SELECT doc_id, first_pos, end_pos FROM off",
    "asof_doc_lookup": f"WITH {_OFFSETS}, p AS (SELECT i * 1009 AS position FROM range(200) r(i)) SELECT position, doc_id, (position - first_pos)::BIGINT AS pos_in_doc FROM p ASOF JOIN (SELECT * FROM off WHERE n > 0) o ON p.position >= o.first_pos WHERE position < (SELECT max(end_pos) FROM off)",
    "packed_sequences_checksum": f"WITH {_ROWS}, g AS (SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS place, count(*) OVER () AS total, CASE WHEN byte BETWEEN 33 AND 126 THEN byte - 31 WHEN byte BETWEEN 161 AND 172 THEN byte - 65 WHEN byte >= 174 THEN byte - 66 WHEN byte <= 32 THEN 190 + byte WHEN byte BETWEEN 127 AND 160 THEN 96 + byte ELSE 257 END AS id FROM brow), s AS (SELECT place // 2049 AS sequence, place % 2049 AS slot, CASE WHEN pos = 0 AND place > 0 AND place % 2049 <> 0 THEN 1 ELSE id END AS token FROM g WHERE place < total // 2049 * 2049) SELECT sequence, sum(token)::BIGINT AS token_sum, sum(token * (slot + 1))::BIGINT AS weighted, count(*) FILTER (token = 1) AS n_eod FROM s GROUP BY 1",
    "ngram_counts_o1_o3": f"WITH {_grams(3)}, c AS (SELECT 1 AS \"order\", count(*) AS n FROM seq GROUP BY w UNION ALL SELECT 2, count(*) FROM seq WHERE i >= 1 GROUP BY w, w1 UNION ALL SELECT 3, count(*) FROM seq WHERE i >= 2 GROUP BY w, w1, w2) SELECT \"order\", count(*) AS types, sum(n)::BIGINT AS tokens, sum(n * n)::BIGINT AS squares FROM c GROUP BY 1",
    "ngram_topk_o5": f"WITH {_grams(5)} SELECT concat_ws(' ', w4, w3, w2, w1, w) AS gram, count(*) AS n FROM seq WHERE i >= 4 GROUP BY 1 ORDER BY n DESC, gram LIMIT 30",
    "ngram_merge_partials": f"WITH {_grams(2)}, c AS (SELECT w1, w, count(*) AS n FROM seq WHERE i >= 1 GROUP BY 1, 2) SELECT count(*) AS types, sum(n)::BIGINT AS tokens, max(n) AS most FROM c",
    "bigram_surprisal": f"WITH {_BIGRAMS} SELECT before, word, n, round(-log2(p), 6) AS surprisal FROM p2",
    "bigram_entropy": f"WITH {_BIGRAMS}, g AS (SELECT before, any_value(gamma) AS gamma FROM p2 GROUP BY 1), dense AS (SELECT g.before, q1.w, coalesce(p2.p, g.gamma * q1.q) AS p FROM g CROSS JOIN q1 LEFT JOIN p2 ON p2.before = g.before AND p2.word = q1.w) SELECT before, round(sum(-p * log2(p)), 6) AS entropy FROM dense GROUP BY 1",
    "space_nll": f"WITH {_BIGRAMS}, g AS (SELECT before, any_value(gamma) AS gamma FROM p2 GROUP BY 1) SELECT g.before, round(-log2(coalesce(p2.p, g.gamma * q1.q)), 6) AS nll FROM g JOIN q1 ON q1.w = 32 LEFT JOIN p2 ON p2.before = g.before AND p2.word = 32",
    "backoff_scores_by_lang": f"WITH {_scored('doc_id % 2 = 0', 'doc_id % 2 = 1')} SELECT lang, count(*) AS n_bytes, count(*) FILTER (surprisal IS NULL) AS n_unseen, round(avg(surprisal), 6) AS surprisal, round(avg(entropy), 6) AS entropy, round(avg(space_nll), 6) AS space_nll, round(avg(eos_nll), 6) AS eos_nll FROM scored JOIN documents USING (doc_id) GROUP BY lang",
    "bits_per_byte_by_lang": f"WITH {_scored('true', 'true')}, b AS (SELECT doc_id, avg(surprisal) AS bpb FROM scored GROUP BY doc_id) SELECT lang, round(avg(bpb), 6) AS bpb_mean, round(stddev_pop(bpb), 6) AS bpb_std, round(avg(exp(bpb * ln(2))), 6) AS perplexity_mean, round(stddev_pop(exp(bpb * ln(2))), 6) AS perplexity_std FROM b JOIN documents USING (doc_id) GROUP BY lang",
    "signal_percentile": f"WITH {_SIGNAL} SELECT round(quantile_cont(signal, 0.3), 6) AS p30, round(quantile_cont(signal, 0.9), 6) AS p90 FROM sig WHERE signal <> 0",
    "spans_monotonic": f"WITH {_spans('false')} {_SUMMARY}",
    "spans_combined": f"WITH {_spans('signal < tau.v')} {_SUMMARY}",
    "span_length_hist": f"WITH {_spans('false')} SELECT (stop - start + 1)::BIGINT AS length, count(*) AS n FROM found GROUP BY 1",
    "span_vocab_topk": f"WITH {_TOKENS} SELECT token, sum(n)::BIGINT AS n FROM counts WHERE length(replace(token, '##', '')) > 2 GROUP BY 1 ORDER BY n DESC, token LIMIT 200",
    "span_vocab_by_lang": f"WITH {_TOKENS} SELECT lang, count(*) AS types, sum(n)::BIGINT AS spans, max(n) AS most FROM counts GROUP BY 1",
    "span_vocab_round_robin": f"WITH {_TOKENS}, t AS (SELECT token, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS turn, list_position(['en', 'fr', 'de', 'es'], lang) AS seat FROM counts WHERE length(replace(token, '##', '')) > 2), f AS (SELECT token, min((turn, seat)) AS pos FROM t WHERE turn <= 100 GROUP BY 1) SELECT row_number() OVER (ORDER BY pos) - 1 AS place, token FROM f ORDER BY pos LIMIT 100",
    "segment_net_counts": "WITH s AS (SELECT user_id, event_id, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events) SELECT user_id AS segment, (arg_max(s, event_id) - least(min(s), 0))::BIGINT AS n FROM s GROUP BY 1",
    "bpe_merges_k": f"WITH {_merges(30, 20)} {_merge_rows(30)}",
    "bpe_first_merges": f"WITH {_merges(3, 20)}{_merge_names(3)}",
    "mutual_information_merges": f"WITH {_merges(8, 200, True)} {_merge_rows(8)}",
    "wordpiece_encode_stats": _encode_summary(_FRONT, "greedy"),
    "suffix_encode_stats": _encode_summary(_BACK, "peeled"),
    "flota_encode_stats": _encode_summary(_LONGEST, "covered"),
    "unigram_encode_stats": _encode_summary(_BEST, "viterbi"),
    "configured_encode_stats": _encode_summary(_FRONT, "greedy", word=r"unnest(flatten(list_transform(regexp_extract_all(lower(replace(text, '%%%', '')), '[^\s\x0b\x{85}\p{Z}]+'), lambda x: regexp_extract_all(x, '\p{N}+|\P{N}+'))))"),
    "segmentation_diff": f"WITH RECURSIVE {_encode()}{_FRONT}{_BACK} SELECT round(avg((g.cuts <> p.cuts)::INT), 6) AS rate FROM greedy g JOIN peeled p USING (w)",
    "wordlevel_encode_stats": f"WITH {_encode()} SELECT lang, sum(n)::BIGINT AS words, coalesce(sum(n) FILTER (w IN (SELECT v FROM vocab UNION ALL SELECT '##' || v FROM vocab)), 0)::BIGINT AS known_words FROM counted GROUP BY 1",
    "boundary_f1_by_source": f"WITH RECURSIVE {_encode()}{_FRONT}, words AS (SELECT DISTINCT source, w FROM base), cut AS (SELECT source, w, length(regexp_extract(w, '(?s)^(.+?)(tion|ing|es)?$', 1)) AS g, length(w) AS n, CASE WHEN length(w) > 100 THEN [] ELSE list_filter(string_split(cuts, ','), lambda c: c <> '')::INT[] END AS p FROM words JOIN greedy USING (w)), s AS (SELECT source, sum((g < n AND list_contains(p, g::INT))::INT) AS tp, sum(len(p) - (g < n AND list_contains(p, g::INT))::INT) AS fp, sum((g < n AND NOT list_contains(p, g::INT))::INT) AS fn FROM cut GROUP BY 1) SELECT source, round(tp / (tp + 0.5 * (fp + fn)), 6) AS f1 FROM s",
    "chunkability_stats": f"WITH {_PRE}, {_CORR} SELECT lexicality, round(avg(chunkability), 6) AS mean, round(stddev_pop(chunkability), 6) AS std FROM lex GROUP BY 1",
    "chunkability_corr": f"WITH {_PRE}, {_CORR} SELECT lexicality, round(num_splits_rt, 6) AS num_splits_rt, round(num_splits_accuracy, 6) AS num_splits_accuracy, round(chunkability_rt, 6) AS chunkability_rt, round(chunkability_accuracy, 6) AS chunkability_accuracy FROM found",
    "cog_score": f"WITH {_PRE}, {_CORR} SELECT lexicality, round((abs(num_splits_rt) + abs(num_splits_accuracy) + abs(chunkability_rt) + abs(chunkability_accuracy)) / 4, 6) AS score FROM found",
    "vocab_overlap": f"WITH {_PRE} SELECT round((SELECT count(*) FROM (SELECT token FROM {_top_vocab('en')} INTERSECT SELECT token FROM {_top_vocab('fr')})) / (SELECT count(*) FROM {_top_vocab('en')}) * 100, 6) AS overlap",
    "vocab_length_hist": f"WITH {_PRE} SELECT i AS length, count(token) AS n FROM range(1, 20) r(i) LEFT JOIN {_top_vocab('en')} v ON length(regexp_replace(v.token, '^##', '')) = i GROUP BY 1",
    "anti_join_todo": "SELECT DISTINCT source AS tokenizer_name FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars > 10000)",
    "name_canonicalise": "SELECT DISTINCT lang || '_byte-span_' || (substr(source, 4, 2)::INT * 1000) AS raw, upper(lang[1]) || lang[2:] || ' Byte Span ' || substr(source, 4, 2)::INT || 'k' AS name FROM documents",
    "jsonl_explode": "WITH k AS (SELECT props, unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n, count(DISTINCT json_extract_string(props, '$.\"' || key || '\"')) AS n_values FROM k GROUP BY 1",
    "turns_list_explode": "SELECT role, count(*) AS n, sum(length(text))::BIGINT AS n_chars, sum(turn)::BIGINT AS turn_sum FROM conversations GROUP BY 1",
    "text_normalise": r"SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n FROM (SELECT doc_id, regexp_replace(replace(lower(strip_accents(text)), '%%%', ''), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS t FROM documents)",
    "pre_tokenizers": r"SELECT lang, sum(len(regexp_extract_all(text, '[^\s\x0b\x{85}\p{Z}]+')))::BIGINT AS n_whitespacesplit, sum(len(regexp_extract_all(text, '\p{N}+|\P{N}+')))::BIGINT AS n_digits, sum(len(regexp_extract_all('▁' || replace(text, ' ', '▁'), '▁[^▁]*')))::BIGINT AS n_metaspace FROM documents GROUP BY 1",
    "embedding_window_sum": "WITH w AS (SELECT embedding, unnest(range(0, len(embedding) - 7, 4)) AS start FROM embeddings) SELECT start, count(*) AS n, round(sum(list_sum(list_transform(embedding[start + 1 : start + 8], lambda x: x::DOUBLE))), 3) AS window_sum FROM w GROUP BY 1",
}
