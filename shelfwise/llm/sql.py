"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from .licenses import LEAST, TEMPLATES
from .mixing import BLOCK_WORDS, MAX_REPEATS, SEED, SHARD_DOCS, SHARD_WORDS, WEIGHTS
from .quality_rules import MAX_HOST_RATE, MAX_PRIOR, MAX_REPEAT_PERCENT, MAX_SYMBOL_PERCENT, MIN_WORDS

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"

QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeats AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
doubled AS (
  SELECT r, len(x) - len(list_distinct(x)) AS n FROM (
    SELECT r, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')) AS x FROM d)),
m AS (
  SELECT d.r, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    doubled.n AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM d JOIN doubled USING (r) LEFT JOIN repeats USING (r)),
f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
hosts AS (
  SELECT source, count(*) AS n,
    count(*) FILTER (base_failed OR 100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars) AS x FROM f GROUP BY source),
sums AS (
  SELECT sum(n) AS n, sum(x) / sum(n) AS mean, count(*) AS hosts, sum(n * (x / n) * (x / n)) / sum(n) AS sq FROM hosts),
prior AS (
  SELECT mean, CASE WHEN sq - mean * mean - mean * (1 - mean) * (hosts - 1) / n > mean * (1 - mean) / {MAX_PRIOR}
    THEN mean * (1 - mean) / (sq - mean * mean - mean * (1 - mean) * (hosts - 1) / n) ELSE {MAX_PRIOR} END AS weight FROM sums),
verdicts AS (
  SELECT source, (x + mean * weight) / (n + weight) > {MAX_HOST_RATE} AS rejected FROM hosts, prior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN verdicts ON f.source IS NOT DISTINCT FROM verdicts.source
"""


def apportion(parties: str, key: str, by: str, value: str, seats: str, out: str) -> str:
    """Sainte-Lague over all quotients that may matter, for a relation with the seats of each key."""
    return f"""
  SELECT * EXCLUDE (party, lo, hi, seats_left, won), lo + won AS {out} FROM (
    SELECT b.*, coalesce(won, 0) AS won FROM ({{bounds}}) b LEFT JOIN (
      SELECT {key}, party, count(*) AS won FROM (
        SELECT {key}, party, seats_left, row_number() OVER (PARTITION BY {key} ORDER BY {value} / (2.0 * k + 1) DESC, party, k) AS rk, {value} AS v
        FROM (SELECT *, unnest(range(lo, hi + 1)) AS k FROM ({{bounds}})))
      WHERE rk <= seats_left AND v > 0 GROUP BY {key}, party) q
    ON b.{key} IS NOT DISTINCT FROM q.{key} AND b.party = q.party)
""".replace("{bounds}", f"""
      SELECT *, {seats} - sum(lo) OVER (PARTITION BY {key}) AS seats_left FROM (
        SELECT *, greatest(0, floor(per * ({seats} - half) + 0.5)::BIGINT - 1) AS lo,
          greatest(greatest(0, floor(per * ({seats} - half) + 0.5)::BIGINT - 1), floor(per * ({seats} + half) + 0.5)::BIGINT + 1) AS hi
        FROM (SELECT *, count(*) OVER (PARTITION BY {key}) / 2.0 AS half,
            CASE WHEN sum({value}) OVER (PARTITION BY {key}) > 0 THEN {value} / sum({value}::DOUBLE) OVER (PARTITION BY {key}) ELSE 0 END AS per,
            row_number() OVER (PARTITION BY {key} ORDER BY {by}) AS party FROM ({parties})))""")


_KEY = f"md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null'))"
_SOURCES = f"""
SELECT *, floor(total / {BLOCK_WORDS})::BIGINT AS blocks, 0 AS one,
  CASE WHEN stopped THEN cap::DOUBLE ELSE
    (total - coalesce(sum(cap) FILTER (stopped) OVER (), 0)) / (sum(weight) OVER () - coalesce(sum(weight) FILTER (stopped) OVER (), 0)) * weight END AS target
FROM (
  SELECT *, cap < (total - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) * weight AS stopped
  FROM (
    SELECT *, {list(WEIGHTS)}[(n - 1) % {len(WEIGHTS)} + 1] AS weight, sum(source_size) OVER () AS total, {MAX_REPEATS} * source_size AS cap
    FROM (SELECT source, sum(size) AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sizes GROUP BY source))
  WINDOW before AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
MIX = f"""
WITH sizes AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
sources AS (
  SELECT *, greatest(ceil(source_size / {SHARD_WORDS}), ceil(n_docs / {SHARD_DOCS}), 1)::BIGINT AS shards
  FROM ({apportion(_SOURCES, "one", "source NULLS LAST", "target", "blocks", "quota")})),
placed AS (
  SELECT sizes.*, source_size, target, quota, {_KEY} AS key, ('0x' || substr({_KEY}, 1, 8))::BIGINT % shards AS shard
  FROM sizes JOIN sources ON sizes.source IS NOT DISTINCT FROM sources.source),
parts AS (SELECT source, quota, shard, sum(size)::BIGINT AS shard_size FROM placed GROUP BY ALL),
quotas AS ({apportion("SELECT * FROM parts", "source", "shard", "shard_size", "quota", "shard_quota")}),
takes AS (
  SELECT source, shard, shard_size, least(shard_quota * {BLOCK_WORDS}, {MAX_REPEATS} * shard_size)::BIGINT AS take FROM quotas),
lined AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM placed),
passed AS (
  SELECT lined.*, take, shard_size, CASE WHEN shard_size > 0 THEN take // shard_size ELSE 0 END AS passes
  FROM lined JOIN takes ON lined.source IS NOT DISTINCT FROM takes.source AND lined.shard = takes.shard)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (passes * size + greatest(0, least(size, take - passes * shard_size - start)))::BIGINT AS taken
FROM passed
"""

_TEMPLATES = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in sorted(TEMPLATES.items()))
_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
LICENSE = rf"""
WITH templates AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(license, body)),
units AS (
  SELECT doc_id, 'line' AS kind, unnest(range(len(u))) AS unit_no, unnest(u) AS unit FROM (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents)
  UNION ALL
  SELECT doc_id, 'paragraph', unnest(range(len(u))), unnest(u) FROM (
    SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n') AS u FROM documents) WHERE len(u) > 1
  UNION ALL
  SELECT doc_id, 'text', 0, text FROM documents WHERE contains(text, chr(10))),
worded AS (SELECT *, list_filter(string_split({_NORMAL.format("unit")}, ' '), lambda x: x <> '') AS w FROM units),
pairs AS (
  SELECT DISTINCT doc_id, kind, unit_no, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS i FROM worded WHERE len(w) > 0)),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, kind, unit_no) AS n FROM pairs),
t_words AS (SELECT license, list_filter(string_split({_NORMAL.format("body")}, ' '), lambda x: x <> '') AS w FROM templates),
t_pairs AS (
  SELECT DISTINCT license, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS i FROM t_words)),
t_sized AS (SELECT *, count(*) OVER (PARTITION BY license) AS m FROM t_pairs),
counted AS (
  SELECT doc_id, kind, unit_no, license, n + m AS total, count(*) AS shared
  FROM sized JOIN t_sized USING (gram) GROUP BY ALL HAVING 2 * count(*) >= {LEAST} * (n + m) - 1e-9),
best AS (
  SELECT doc_id, license, shared, total, count(*) OVER (PARTITION BY doc_id) AS n_matches FROM counted
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared / total DESC, total DESC, license DESC, shared DESC) = 1)
SELECT d.doc_id, license, shared::BIGINT AS shared, total::BIGINT AS total, coalesce(n_matches, 0)::BIGINT AS n_matches
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN best ON d.doc_id IS NOT DISTINCT FROM best.doc_id
"""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

LEXICAL = r"""
WITH low AS (
  SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM low WHERE text IS NOT NULL),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM d) GROUP BY r, t),
totals AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS terms FROM d WHERE len(terms) > 0),
m AS (SELECT r, doc_id, 50 + (50 * len(d.terms) * docs) // totals.terms AS m FROM d, totals WHERE len(d.terms) > 0),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, totals GROUP BY t),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": QUALITY,
    "op5_topk_search": TOPK,
    "op7_ngram_join": JOIN,
    "op8_source_mix": MIX,
    "op9_license_scan": LICENSE,
    "op11_lexical_search": LEXICAL,
}
