"""SQL counterparts of the queries that SQL can express, written from the contracts.

Not here: op1 (a trained model), op2 (a keyed permutation), op5 and op10 (a tokenizer's ids), op8
(hashing that reaches a recall) and the pipeline. They are tested against brute force, an
exact round trip or held-out accuracy.
"""

from __future__ import annotations

from . import line_frequency as lf

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: Only A-Z become lower case.
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(_ASCII_LOWER.format("coalesce(text, '')"))} AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3
    THEN list_transform(range(1, len(words) - 1), lambda k: words[k:k+2]) WHEN len(words) > 0
    THEN [words] ELSE [] END) AS shingle FROM w),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b
  ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN least USING (doc_id)"""

_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * (k // 4)}, 5))"
    f"::INT >> {15 - 5 * (k % 4)}) & 31), 1)" for k in range(32))

OP4 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM p),
o AS (SELECT h, payload_bytes, max(page_id) AS first FROM d GROUP BY 1, 2)
SELECT page_id, d.payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN o USING (h, payload_bytes)"""

_LINE_KEY = f"array_to_string({_WORDS.format('lower(line)')}, ' ')"

OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, {_WORDS.format('text')} AS words FROM d),
win AS (
  SELECT doc_id, k, words[k:k+4] AS five FROM (
    SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM w WHERE len(words) >= 5)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(k, k + 5)) AS p FROM (
      SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, five) AS times FROM win)
    WHERE times > 1) GROUP BY 1),
ln AS (
  SELECT doc_id, host, line, {_LINE_KEY} AS key FROM (
    SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)),
full_line AS (SELECT * FROM ln WHERE key <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_line GROUP BY 1),
often AS (
  SELECT host, key FROM (
    SELECT l.host, key, count(DISTINCT md5(text)) AS n FROM full_line l JOIN d USING (doc_id) GROUP BY 1, 2)
  JOIN (SELECT host, count(*) AS size FROM d GROUP BY 1) USING (host)
  WHERE n > {lf.MIN_DOCUMENTS} AND n > size * {lf.MAX_SHARE}::DOUBLE),
gone AS (
  SELECT doc_id, count(*) AS n, sum(len({_WORDS.format('line')}))::BIGINT AS words
  FROM full_line JOIN often USING (host, key) GROUP BY 1),
base AS (
  SELECT doc_id, len(w.words)::BIGINT AS n_words,
    length(array_to_string(w.words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(gone.n, 0)::BIGINT AS n_lines_removed, coalesce(gone.words, 0)::BIGINT AS n_words_removed
  FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
  LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_lines_removed > 0 AND
    (n_words - n_words_removed < {lf.MIN_WORDS}
     OR n_words - n_words_removed < {lf.MIN_LEFT}::DOUBLE * n_words)) AS kept
FROM base"""


def _cell(name: str, value: str | None = None) -> str:
    """The value with its length in bytes in front."""
    value = f"({value or name})::VARCHAR"
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE octet_length(encode({value})) || ':' || {value} END"


_HEAD = " || ".join(_cell(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: The register of CRC-32 after the digits of doc_id, bit by bit, before it is inverted.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(
  range(8 * length(doc_id::VARCHAR)), lambda k: CASE WHEN k % 8 = 0
  THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1))::BIGINT ELSE 0 END)),
  lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))"""
_SIBLINGS = """coalesce(lag(h, 2) OVER run, '') || coalesce(lag(h) OVER run, '') AS low,
  coalesce(lead(h) OVER run, '') || coalesce(lead(h, 2) OVER run, '') AS high"""

OP11 = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, source, sha256({_HEAD} || {_cell("text")}) AS leaf,
    CASE WHEN {_CRC} % 2 = 1 THEN sha256({_HEAD} || {_cell("text", "replace(text, chr(10), '')")})
    END AS tampered FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS n FROM leaf),
up AS (
  SELECT source, 0 AS level, place, n, leaf AS h FROM placed
  UNION ALL
  SELECT source, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM up WHERE n > 1 GROUP BY source, level, place // 3, n),
tops AS (
  SELECT source, h, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place,
    count(*) OVER () AS n FROM up WHERE n = 1),
above AS (
  SELECT 0 AS level, place, n, h FROM tops
  UNION ALL
  SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM above WHERE n > 1 GROUP BY level, place // 3, n),
beside AS (
  SELECT source, level, place, n, {_SIBLINGS} FROM up
  WINDOW run AS (PARTITION BY source, level, place // 3 ORDER BY place)),
beside_above AS (
  SELECT level, place, n, {_SIBLINGS} FROM above
  WINDOW run AS (PARTITION BY level, place // 3 ORDER BY place)),
climb AS (
  SELECT doc_id, place AS spot, source, 0 AS level, place, n, coalesce(tampered, leaf) AS h, '' AS proof
  FROM placed
  UNION ALL
  SELECT doc_id, spot, c.source, level + 1, place // 3, (n + 2) // 3, sha256(low || c.h || high),
    proof || low || high
  FROM climb c JOIN beside b USING (level, place, n)
  WHERE n > 1 AND c.source IS NOT DISTINCT FROM b.source),
climb_above AS (
  SELECT doc_id, spot, c.source, 0 AS level, t.place, t.n, c.h, proof
  FROM climb c JOIN tops t ON c.n = 1 AND c.source IS NOT DISTINCT FROM t.source
  UNION ALL
  SELECT doc_id, spot, source, level + 1, place // 3, (n + 2) // 3, sha256(low || c.h || high),
    proof || low || high
  FROM climb_above c JOIN beside_above b USING (level, place, n) WHERE n > 1)
SELECT p.doc_id, leaf, t.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256,
  c.h AS folded_root, c.h = r.h AS verified
FROM climb_above c JOIN placed p ON c.n = 1 AND p.place = c.spot
  AND p.source IS NOT DISTINCT FROM c.source
JOIN tops t ON t.source IS NOT DISTINCT FROM c.source JOIN above r ON r.n = 1"""


def _pick(k: int) -> str:
    return f"('0x' || substr(md5(pattern), {1 + 4 * k}, 4))::INT"


_ENTRIES = " UNION ALL ".join(
    f"SELECT pattern, '{c}' AS category, DATE '2023-10-01' + ({_pick(k)} % 450) AS since, "
    f"{'true' if a == 'add' else 'false'} AS added FROM names WHERE {_pick(4 + (c == 'spam'))} % 8 < 3"
    for k, (c, a) in enumerate((("adult", "add"), ("adult", "remove"), ("spam", "add"),
                                ("spam", "remove"))))

OP7 = rf"""
WITH cap AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 366)::INT AS day,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host
  FROM pages),
names AS (
  SELECT DISTINCT unnest([host, regexp_replace(host, '^[^.]+\.', '')]) AS pattern FROM cap
  WHERE host IS NOT NULL),
entries AS ({_ENTRIES}),
day_entries AS (SELECT pattern, category, since, bool_and(added) AS added FROM entries GROUP BY 1, 2, 3),
stay AS (
  SELECT *, lead(since, 1, DATE '9999-12-31') OVER (PARTITION BY pattern, category ORDER BY since) AS until
  FROM day_entries),
hit AS (
  SELECT page_id, category, stay.pattern FROM cap JOIN stay
  ON added AND since <= day AND day < until AND (host = pattern OR suffix(host, '.' || pattern))),
verdict AS (
  SELECT page_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
    arg_max(pattern, length(pattern)) AS pattern FROM hit GROUP BY 1)
SELECT cap.page_id, url, day, host, pattern IS NOT NULL AS blocked,
  coalesce(categories, '') AS categories, pattern FROM cap LEFT JOIN verdict USING (page_id)"""

OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, k, substr(h, 1 + 2 * k, 100) AS s FROM (
    SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS k FROM d WHERE length(h) >= 100)),
first AS (SELECT s, min(doc_id) AS doc FROM win GROUP BY 1),
bad AS (
  SELECT win.doc_id, k, row_number() OVER (PARTITION BY win.doc_id ORDER BY k) AS r
  FROM win JOIN first USING (s) WHERE first.doc < win.doc_id),
jump AS (
  SELECT doc_id, k, CASE WHEN lag(k) OVER (PARTITION BY doc_id ORDER BY k) >= k - 50 THEN 0 ELSE 1 END AS new
  FROM bad),
run AS (
  SELECT doc_id, g, min(k) AS a, max(k) + 50 AS b FROM (
    SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM jump) GROUP BY 1, 2),
part AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since,
    lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM run),
cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 1 + 2 * since, 2 * (a - since)), '' ORDER BY a)
    || any_value(substr(h, 1 + 2 * b)) FILTER (WHERE last) AS rest
  FROM part JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

SQL: dict[str, str] = {
    "op3_size_aware_join": OP3, "op4_arc_to_warc": OP4, "op6_line_frequency": OP6,
    "op7_temporal_lists": OP7, "op9_bwt_repeats": OP9, "op11_merkle_descent": OP11,
}
