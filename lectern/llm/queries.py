"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, exact_dedup, hard_negatives, license_scan, media, minhash, packing, pii, secret_scan, spelling, suffix_dedup, token_ids, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.page_sketches(_table(spark, sf_dir, "pages"))).withColumnRenamed("image_id", "page_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_minhash, op3_secret_scan, op4_token_ids, op5_bpe, op6_media, op7_suffix_dedup, op8_exact_dedup, op9_packing, op10_license_scan, op11_spelling, op12_hard_negatives, op13_pii)}


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS n FROM documents
), g AS (
  SELECT doc_id, sha256(t) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (n + m - shared)), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept FROM s LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = s.doc_id
"""

#: Kind, pattern, group and least length, as the contract and the further kinds state them.
_KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,255}", 0, 40), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15), ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 26),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 27), ("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.~-]{20,}", 0, 27),
]
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, {no} AS no, '{kind}' AS kind, {least} AS least, unnest(regexp_split_to_array(text, '{p}')) AS gap, unnest(list_concat(regexp_extract_all(text, '{p}', 0), [NULL])) AS hit, unnest(list_concat(regexp_extract_all(text, '{p}', {group}), [NULL])) AS part, generate_subscripts(regexp_split_to_array(text, '{p}'), 1) AS i FROM d"
    for no, (kind, p, group, least) in enumerate(_KINDS)
)

OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({_MATCHES}),
f AS (SELECT doc_id, no, kind, stop - length(hit) AS start, stop FROM (SELECT *, CAST(sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, no ORDER BY i) AS BIGINT) AS stop FROM m) WHERE length(part) >= least)
SELECT d.doc_id, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access, count(*) FILTER (WHERE no = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) FILTER (WHERE no < 3), '')) AS base_sha256, coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""

OP7_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents), w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM b WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s), c AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > m),
k AS (SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS cut FROM c)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM k GROUP BY doc_id, run), g AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
x AS (SELECT g.doc_id, count(*) AS n_spans, CAST(sum(e - a) AS BIGINT) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM g JOIN b USING (doc_id) GROUP BY g.doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN x USING (doc_id)
"""

#: The checksum, byte by byte and bit by bit, of the UTF-8 of letters up to U+00FF, digits, a sign and a colon.
_BYTES = "flatten(list_transform(string_split(k, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))"
_BIT = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"

OP11_SQL = f"""
WITH RECURSIVE bits AS (SELECT b, CAST(b AS BIGINT) AS x, 0 AS i FROM range(256) r(b) UNION ALL SELECT b, {_BIT}, i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(x ORDER BY b) AS t FROM bits WHERE i = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS w FROM documents),
c AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS k, w, count(*) AS n FROM r WHERE length(w) >= 5 GROUP BY doc_id, w),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda s, x: xor(s >> 8, t[CAST(xor(s & 255, x) AS INT) + 1])), 4294967295) AS h FROM c, crc),
e AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v), k AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM x),
near AS (SELECT p.word, q.word AS other, q.n AS m FROM k p JOIN k q ON p.a = q.a AND p.b = q.b AND p.word <> q.word UNION SELECT p.word, q.word, q.n FROM k p JOIN v q ON p.a || p.b = q.word UNION SELECT q.word, p.word, p.n FROM k p JOIN v q ON p.a || p.b = q.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk USING (word) JOIN f last ON last.word = walk.at AND last.form IS NULL
"""

OP12_SQL = """
WITH e AS (SELECT row_number() OVER () AS no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.no, a.vec_id AS anchor_id, b.no AS other, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.no <> b.no),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id NULLS LAST, other) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.no, p.other ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s ON p.no = s.no AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": OP2_SQL, "op3_secret_scan": OP3_SQL, "op7_suffix_dedup": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op11_spelling": OP11_SQL, "op12_hard_negatives": OP12_SQL}
