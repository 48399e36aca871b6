"""The ten operators over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, mixing, pii, resample, secrets, simhash, topk, urlrules
from .common import table

#: The URL rules as (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return resample.resample(table(spark, sf_dir, "documents"), good, share=0.5)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = langid.identify(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("findings")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents")).drop("scores")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    return chat.digest(turns.unionByName(more))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


QUERIES = {f.__name__: f for f in (op1_topk, op2_simhash, op3_quality, op4_langid, op5_urls, op6_decontaminate, op7_secrets, op8_pii, op9_chat, op10_mixing)}

OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), rules(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
)
SELECT page_id, host, path,
  (SELECT r.h || r.p FROM rules r WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) ORDER BY length(r.h || r.p) DESC LIMIT 1) AS rule,
  coalesce((SELECT r.v FROM rules r WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) ORDER BY length(r.h || r.p) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""

_PII_PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("iban", r"[A-Za-z0-9]+"),
    ("ssn", r"[0-9-]+"),
]
_OCTET = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
OP8_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
k AS ({" UNION ALL ".join(f"SELECT doc_id, s, {i} AS kind, '{n}' AS name, regexp_extract_all(s, '{p}') AS m, string_split_regex(s, '{p}') AS g FROM t" for i, (n, p) in enumerate(_PII_PATTERNS))}),
n AS (SELECT doc_id, s, kind, name, m, list_transform(g, lambda z: length(z)) AS gl, list_transform(m, lambda z: length(z)) AS ml FROM k WHERE len(m) > 0),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM n),
p AS (SELECT doc_id, s, kind, name, m[i] AS f, CAST(list_sum(gl[1:i]) + list_sum(ml[1:i]) - ml[i] AS BIGINT) AS st FROM x
  WHERE kind < 4 OR kind = 4 AND regexp_full_match(m[i], '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') OR kind = 5 AND regexp_full_match(m[i], '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')),
d AS (SELECT *, regexp_replace(f, '[^0-9]', '', 'g') AS dg, CASE WHEN kind = 4 THEN list_aggregate(list_transform(string_split(substr(f, 5) || substr(f, 1, 4), ''), lambda c: CASE WHEN c <= '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), 'string_agg', '') END AS num FROM p),
v AS (SELECT * FROM d WHERE CASE kind
  WHEN 1 THEN regexp_full_match(f, '{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}')
  WHEN 2 THEN length(dg) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(dg)[i] AS INTEGER)
    ELSE 2 * CAST(reverse(dg)[i] AS INTEGER) - CASE WHEN CAST(reverse(dg)[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 3 THEN length(dg) BETWEEN 10 AND 15
  WHEN 4 THEN list_reduce(list_transform(string_split(num, ''), lambda c: CAST(c AS BIGINT)), lambda a, b: (a * 10 + b) % 97) = 1
  WHEN 5 THEN regexp_matches(lower(substr(s, greatest(st - 48, 0) + 1, least(st, 48))), 'ssn|social')
  ELSE true END)
SELECT t.doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
  sha256(coalesce(string_agg(name || ':' || st || ':' || (st + length(f)), ',' ORDER BY st, kind) FILTER (kind < 4), '')) AS base_sha256,
  coalesce(string_agg(name || ':' || st || ':' || (st + length(f)), ',' ORDER BY st, kind), '') AS spans
FROM t LEFT JOIN v ON t.doc_id = v.doc_id GROUP BY t.doc_id
"""

OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>|/?SYS>>)', '\1\\\2\3', 'g') AS body FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    CAST(sum(length(role) + length(body) + 12 + 1 + 11) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

OP10_SQL = r"""
WITH z AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat_ws(':', '7', coalesce(CAST(doc_id AS VARCHAR), 'null'))), 1, 12) AS BIGINT) AS h FROM documents
), s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY 1
), s1 AS (SELECT *, 2.0 * source_size AS cap, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s0
), s2 AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t
  FROM s1 WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), s3 AS (SELECT *, least(cap, w * max(t) FILTER (t <= cap / w) OVER ()) AS target FROM s2
), b AS (SELECT CAST(greatest(1, least(64, floor(min(target) FILTER (target > 0) / 100))) AS BIGINT) AS block, sum(target) AS total FROM s3
), seats AS (SELECT source, target / (2 * k + 1) AS q, block, total FROM (SELECT source, target, block, total, unnest(range(0, CAST(ceil(target / block) AS BIGINT) + 30)) AS k FROM s3, b WHERE target > 0)
), quota AS (SELECT source, count(*) AS quota FROM (SELECT * FROM seats QUALIFY row_number() OVER (ORDER BY q DESC, source NULLS LAST) <= round(total / block)) GROUP BY 1
), d AS (SELECT z.*, s3.source_size, s3.target, coalesce(quota, 0) AS quota, block, z.h % greatest(1, CAST(ceil(s3.source_size / 500000.0) AS BIGINT)) AS shard
  FROM z JOIN s3 ON z.source IS NOT DISTINCT FROM s3.source LEFT JOIN quota ON z.source IS NOT DISTINCT FROM quota.source, b
), sh AS (SELECT source, shard, quota, CAST(sum(size) AS BIGINT) AS line FROM d GROUP BY 1, 2, 3
), shq AS (SELECT source, shard, count(*) AS blocks FROM (
    SELECT * FROM (SELECT source, shard, quota, line / (2.0 * unnest(range(0, quota + 1)) + 1) AS q FROM sh WHERE line > 0) QUALIFY row_number() OVER (PARTITION BY source ORDER BY q DESC, shard) <= quota) GROUP BY 1, 2
), e AS (SELECT d.*, line, least(coalesce(blocks, 0) * block, line * 2) AS words, CAST(sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop,
    CAST('0x' || substr(md5(concat_ws(':', 'run7', coalesce(d.source, ''), CAST(d.shard AS VARCHAR))), 1, 12) AS BIGINT) AS draw
  FROM d JOIN sh ON d.source IS NOT DISTINCT FROM sh.source AND d.shard = sh.shard LEFT JOIN shq ON d.source IS NOT DISTINCT FROM shq.source AND d.shard = shq.shard
), f AS (SELECT *, CASE WHEN line > 0 THEN words // line ELSE 0 END AS times, CASE WHEN line > 0 THEN draw % greatest(CAST(ceil(line / CAST(block AS DOUBLE)) AS BIGINT), 1) * block ELSE 0 END AS first FROM e
), g AS (SELECT *, words - times * line AS run FROM f)
SELECT doc_id, size, source_size, target, CAST(times * size
  + greatest(least(stop, first + run) - first, 0) + least(stop, greatest(first + run - line, 0))
  - greatest(least(stop - size, first + run) - first, 0) - least(stop - size, greatest(first + run - line, 0)) AS BIGINT) AS taken FROM g
"""

ORACLE_SQL = {"op1_topk": OP1_SQL, "op5_urls": OP5_SQL, "op8_pii": OP8_SQL, "op9_chat": OP9_SQL, "op10_mixing": OP10_SQL}
