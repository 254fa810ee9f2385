"""DuckDB SQL of the training-data queries that SQL can express."""

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), seen AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
    length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS text_n,
    length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS role_n
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_n + CASE WHEN before IS NULL OR before <> role THEN 24 + role_n ELSE 8 END)::BIGINT AS formatted_chars
FROM seen GROUP BY conv_id
"""

#: Without seeds: two texts that agree in four of five words of a window share some run of words (of two, three or four,
#: by the item's length); every alignment with such a run is scored in full.
DECONTAMINATION = r"""
WITH items AS (
  SELECT row_number() OVER () AS i, item_id, w, CASE WHEN len(w) < 10 THEN 2 WHEN len(w) < 13 THEN 3 ELSE 4 END AS g, least(len(w), 13) AS win
  FROM (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 5
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS dw FROM documents
), item_at AS (SELECT i, g, w, unnest(range(len(w) - g + 1)) AS pos FROM items),
item_runs AS (SELECT i, g, pos, w[pos + 1 : pos + g] AS run FROM item_at),
doc_at AS (SELECT r, g, dw, unnest(range(len(dw) - g + 1)) AS pos FROM docs, (SELECT DISTINCT g FROM items)),
doc_runs AS (SELECT r, g, pos, dw[pos + 1 : pos + g] AS run FROM doc_at),
aligned AS (SELECT DISTINCT r, i, d.pos - t.pos AS shift FROM doc_runs d JOIN item_runs t USING (g, run)),
same AS (
  SELECT doc_id, item_id, shift, win, list_transform(range(len(w)), lambda k: CASE WHEN shift + k >= 0 AND coalesce(dw[shift + k + 1] = w[k + 1], false) THEN 1 ELSE 0 END) AS s
  FROM aligned JOIN docs USING (r) JOIN items USING (i)
), windows AS (SELECT *, unnest(range(len(s) - win + 1)) AS k FROM same),
scored AS (SELECT doc_id, item_id, k AS item_start, shift + k AS doc_start, win, list_sum(s[k + 1 : k + win]) AS n FROM windows)
SELECT doc_id, item_id, n::BIGINT AS matched_words, win::BIGINT AS window_words, item_start::BIGINT AS item_start, doc_start::BIGINT AS doc_start
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, doc_start, item_start, win DESC) AS k FROM scored WHERE n >= ceil(win * 0.8)) WHERE k = 1
"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
texts AS (SELECT row_number() OVER () AS t, text, min(coalesce(doc_id, 9223372036854775807)) AS id FROM d WHERE text IS NOT NULL GROUP BY text),
places AS (SELECT t, id, string_split(text, chr(10)) AS ls, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM texts),
lines AS (SELECT t, id, line_no, trim(ls[line_no + 1], ' ') AS line FROM places),
masked AS (SELECT t, id, line_no, regexp_replace(line, '[^ 0-9]*[0-9][^ ]*', '<*>', 'g') AS line FROM lines WHERE line <> ''),
split AS (SELECT *, string_split(line, ' ') AS p FROM masked),
parts AS (SELECT *, len(p) AS n, row_number() OVER w AS k, sum(len(p)) OVER w AS upto FROM split WINDOW w AS (PARTITION BY t ORDER BY line_no)),
opened AS (
  SELECT 6 AS low, 11 AS high, unnest([[0], [1], [2], [3]]) AS o UNION ALL SELECT 12, 1000000000, unnest([[0, 1], [0, 2], [0, 3], [1, 2], [1, 3], [2, 3]])
),
keyed AS (
  SELECT t, id, line_no, line_no AS last, [0] AS kind, p AS key FROM parts WHERE n < 6
  UNION ALL
  SELECT t, id, line_no, line_no AS last, o AS kind,
    p[1:3] || list_transform(range(3, n), lambda i: CASE WHEN list_contains(list_transform(o, lambda q: i >= 3 + (n - 3) * q // 4 AND i < 3 + (n - 3) * (q + 1) // 4), true) THEN NULL ELSE p[i + 1] END) AS key
  FROM parts, opened WHERE n BETWEEN low AND high
  UNION ALL
  SELECT a.t, a.id, a.line_no, b.line_no AS last, [-1] AS kind, ls[a.k : b.k] AS key
  FROM parts a JOIN parts b ON a.t = b.t AND b.k > a.k AND b.upto - a.upto + a.n >= 30 AND b.upto - b.n - a.upto + a.n < 30
  JOIN (SELECT t, list(line ORDER BY k) AS ls FROM parts GROUP BY t) l ON a.t = l.t WHERE a.n < 30
), templates AS (
  SELECT kind, key, min(id) AS keeper FROM keyed GROUP BY kind, key HAVING count(DISTINCT t) >= CASE WHEN len(key) >= 30 OR kind = [-1] THEN 2 ELSE 3 END
), spans AS (
  SELECT DISTINCT k.t, line_no, last FROM keyed k JOIN templates m ON k.kind = m.kind AND k.key = m.key WHERE k.id > m.keeper
), lost AS (
  SELECT text, list(DISTINCT p.line_no) AS drops FROM parts p JOIN spans s ON p.t = s.t AND p.line_no BETWEEN s.line_no AND s.last JOIN texts x ON x.t = p.t GROUP BY text
)
SELECT doc_id,
  CASE WHEN drops IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(len(lines)), lambda i: NOT list_contains(drops, i)), lambda i: lines[i + 1]), chr(10)) END AS text,
  coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(drops), 0)::BIGINT AS n_dropped
FROM d LEFT JOIN lost ON d.text = lost.text
"""
