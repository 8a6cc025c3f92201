"""The registered query of each operator, over its whole table, and the SQL
that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontaminate, infill, mixing, packing, pii, quality, secrets, tokens, warc
from .licenses import TEMPLATES, licenses
from .near_dedup import near_duplicates
from .sharding import sharded


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = secrets.vocabulary_words(public_tokenizers.path("byte_bpe_50k.json"))
    return secrets.secrets(_table(spark, sf_dir, "documents"), words=words)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.byte_tokens(_table(spark, sf_dir, "documents")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).drop("source")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(_table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_licenses": op2_licenses,
    "op3_pii": op3_pii,
    "op4_tokens": op4_tokens,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_secrets": op7_secrets,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_decontaminate": op10_decontaminate,
    "op11_mixing": op11_mixing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_filter_audit": op13_filter_audit,
}

#: DuckDB.  Words are split on the six ASCII space characters.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' /' || len(w)] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * i >= 75 * (p.n + q.n - i)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
  least(d.doc_id, m) AS component_id, d.doc_id = least(d.doc_id, m) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(
      range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS s
  FROM b WHERE len(w) > 0),
places AS (SELECT doc_id, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS i
  FROM d, (SELECT DISTINCT n FROM windows) l WHERE len(w) >= l.n),
hits AS (SELECT doc_id, i, p.n, item_id FROM places p
  JOIN windows x ON x.n = p.n AND x.s = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
marked AS (SELECT doc_id, count(*) AS n_hit FROM (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (
  SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN names USING (doc_id)
"""


def _licence_sql() -> str:
    """Every run between two bigrams of every template, without bounds that prune
    but the greatest length that can match."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(TEMPLATES))
    words = "list_filter(string_split_regex(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '')"
    grams = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH t AS (SELECT k, name, {words.format(t="text")} AS w FROM (VALUES {values}) v(k, name, text)),
tg AS (SELECT DISTINCT k, name, unnest({grams}) AS g FROM t),
ts AS (SELECT k, name, count(*) AS m FROM tg GROUP BY k, name),
d AS (SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS h, {words.format(t="coalesce(text, '')")} AS w FROM documents),
e AS (SELECT doc_id, h, unnest(range(len(w) - 1)) AS p, unnest({grams}) AS g FROM d WHERE len(w) > 1),
hits AS (SELECT doc_id, h, k, p, g FROM e JOIN tg USING (g)),
runs AS (SELECT a.doc_id, a.h, a.k, a.p AS s, b.p AS e, m, name FROM hits a JOIN ts ON ts.k = a.k
  JOIN hits b ON b.doc_id IS NOT DISTINCT FROM a.doc_id AND b.h = a.h AND b.k = a.k AND b.p >= a.p AND 75 * (b.p - a.p + 1 + m) <= 200 * least(m, b.p - a.p + 1)),
common AS (SELECT r.doc_id, r.h, r.k, r.name, r.m, r.s, r.e, count(DISTINCT c.g) AS c FROM runs r
  JOIN hits c ON c.doc_id IS NOT DISTINCT FROM r.doc_id AND c.h = r.h AND c.k = r.k AND c.p BETWEEN r.s AND r.e GROUP BY ALL),
near AS (SELECT doc_id, k, name, m, max(round(2.0::DOUBLE * c / (e - s + 1 + m), 6)) AS dice FROM common WHERE 200 * c >= 75 * (e - s + 1 + m) GROUP BY ALL),
one AS (SELECT doc_id, count(DISTINCT k) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM near GROUP BY doc_id),
top AS (SELECT doc_id, name, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, m DESC, name) AS r FROM near)
SELECT d.doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, top.name AS license, coalesce(dice, 0.0)::DOUBLE AS dice, coalesce(names, '') AS licenses
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN one ON one.doc_id IS NOT DISTINCT FROM d.doc_id LEFT JOIN top ON top.doc_id IS NOT DISTINCT FROM d.doc_id AND top.r = 1
"""


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM d),
s AS (SELECT source, sum(size)::BIGINT AS n, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
-- of the sources by bound per weight, the first ones are full
o AS (SELECT *, 2 * n AS bound,
  coalesce(sum(2 * n) OVER before, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left,
  1.5::DOUBLE * (sum(n) OVER ())::DOUBLE AS budget
  FROM s WINDOW before AS (ORDER BY n::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT budget - full_before::DOUBLE AS share, w_left::DOUBLE AS w_left FROM o WHERE (budget - full_before::DOUBLE) * w / w_left::DOUBLE <= bound ORDER BY full_before, w_left DESC LIMIT 1),
t AS (SELECT source, n, w, budget, CASE WHEN e.share IS NULL OR e.share * w / e.w_left > bound THEN bound::DOUBLE ELSE e.share * w / e.w_left END AS target
  FROM o LEFT JOIN e ON true),
q AS (SELECT c.*, t.n, t.w, t.target, t.budget, t.source IS NULL AS last,
  ('0x' || substr(sha256(concat_ws(':', '1', coalesce(c.doc_id::VARCHAR, 'null'), size, copy)), 1, 15))::BIGINT AS h
  FROM c JOIN t ON t.source IS NOT DISTINCT FROM c.source),
u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, copy ROWS UNBOUNDED PRECEDING) AS until FROM q),
f AS (SELECT u.*, turn, (turn * n + until)::DOUBLE / w AS finish FROM u, (VALUES (0), (1)) v(turn)),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, last, source, turn, h, doc_id NULLS FIRST, size, copy ROWS UNBOUNDED PRECEDING) AS spent FROM f)
SELECT doc_id, size, any_value(n) AS source_size, any_value(target) AS target,
  coalesce(sum(size) FILTER (spent <= budget), 0)::BIGINT AS taken
FROM m GROUP BY doc_id, source, size, copy
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
k AS (SELECT doc_id, t, n, [('0x' || substr(h, i * 8 + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
    WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substr(t, 1, low) AS prefix, substr(t, low + 1, high - low) AS middle, substr(t, high + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""

#: Every document in every order, step by step.
OP13_SQL = r"""
WITH RECURSIVE letters(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(o) AS (SELECT '' UNION ALL SELECT o || f FROM orders, letters WHERE NOT contains(o, f)),
steps AS (SELECT o, i AS step, l.f, l.b, coalesce((SELECT sum(b) FROM letters p WHERE contains(substr(o, 1, i - 1), p.f)), 0)::INT AS before
  FROM orders, range(1, 6) r(i), letters l WHERE length(o) = 5 AND l.f = substr(o, i, 1)),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
told AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
  + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM d JOIN firsts USING (t) LEFT JOIN told USING (doc_id)),
h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
r AS (SELECT part, o, step, f,
  coalesce(sum(n) FILTER (mask & (before | b) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & b > 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & b > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = b), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & b > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & b > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM h, steps GROUP BY part, o, step, f)
SELECT part, o AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""

ORACLE_SQL: dict[str, str] = {"op1_near_dedup": OP1_SQL, "op2_licenses": _licence_sql(), "op6_warc": OP6_SQL, "op10_decontaminate": OP10_SQL, "op11_mixing": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_filter_audit": OP13_SQL}
