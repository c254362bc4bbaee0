"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshfront.llm import audit, bpe, clustering, langid, media, mixing, packing, pii, simhash, topk, toxicity, url_filter, warc
from meshfront.llm.common import columns


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(columns(_table(spark, sf_dir, "documents"), "doc_id", "text", "source"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def public_tokenizer(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """The tokenizer file, the same vocabulary as ranks, and the pattern of the ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizer())


#: The rules of the contract.
BLOCK, ALLOW = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), BLOCK, ALLOW)


#: A demonstration key; a deployment passes its own secret.
PII_KEY = "pseudonym-demonstration-key"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(columns(_table(spark, sf_dir, "documents"), "doc_id", "text"), PII_KEY)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archive(spark, warc.write_archive(_table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file, _, pattern = public_tokenizer()
    done = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), (file, pattern)), (file, pattern))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def _clustering_sql() -> str:
    """Three rounds written out: assign to the nearest centroid, then floor the means; a centroid without vectors stays."""
    steps = ["""v AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS c, x FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)"""]  # fmt: skip
    for r in range(4):
        far = "list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        steps.append(f"a{r} AS (SELECT id, v.vec_id, v.x, min({{'d': CAST({far} AS BIGINT), 'c': c}}) AS m FROM v, c{r} k GROUP BY id, v.vec_id, v.x)")
        if r < 3:
            steps.append(f"s{r} AS (SELECT m.c AS c, unnest(x) AS x, unnest(range(64)) AS i FROM a{r})")
            steps.append(f"t{r} AS (SELECT c, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM s{r} GROUP BY c, i)")
            steps.append(f"u{r} AS (SELECT c, list(x ORDER BY i) AS x FROM t{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS (SELECT c, coalesce(u.x, k.x) AS x FROM c{r} k LEFT JOIN u{r} u USING (c))")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, m.c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,"
        " CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(c3.x, 'string_agg', ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.c = m.c"
    )


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_media": op3_media,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_topk": op7_topk,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_langid": op10_langid,
    "op11_filter_audit": op11_filter_audit,
    "op12_bpe": op12_bpe,
    "op13_clustering": op13_clustering,
}

ORACLES = {
    "op1_mixing": """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('0' || source, '1') AS skey, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS key FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS INT)] AS w, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
a AS (SELECT *, coalesce(CAST(sum(cap) OVER o AS BIGINT), 0) AS ahead, CAST(sum(w) OVER () AS BIGINT) - coalesce(CAST(sum(w) OVER o AS BIGINT), 0) AS rest
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST(cap AS DOUBLE) / w <= CAST(total - ahead AS DOUBLE) / rest AS is_full FROM a),
t AS (SELECT skey, source_size, total, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
  ELSE CAST(w * (total - coalesce(CAST(sum(cap) FILTER (is_full) OVER () AS BIGINT), 0)) AS DOUBLE) / CAST(sum(w) FILTER (NOT is_full) OVER () AS BIGINT) END AS target FROM f),
c AS (SELECT d.*, source_size, target, total, CAST(greatest(1, floor(target / 1000)) AS BIGINT) AS q,
  coalesce(CAST(sum(size) OVER (PARTITION BY skey ORDER BY key, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM d JOIN t USING (skey)),
e AS (SELECT *, unnest([0, 1, 2]) AS epoch FROM c WHERE size > 0),
p AS (SELECT *, unnest(range((size + q - 1) // q)) AS k FROM e),
n AS (SELECT id, skey, total, target, start + epoch * source_size + k * q AS place, least(q, size - k * q) AS words FROM p),
r AS (SELECT *, coalesce(CAST(sum(words) OVER (ORDER BY CAST(place + words AS DOUBLE) / target, skey, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM n),
g AS (SELECT id, CAST(sum(least(words, total - before)) AS BIGINT) AS taken FROM r WHERE before < total GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM c LEFT JOIN g USING (id)""",
    "op7_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS d FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS first FROM p),
r AS (SELECT *, n >= 1000 AND first IS NOT NULL AND coalesce(page_id < first, TRUE) AS again FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r""",
    "op4_url_filter": """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r (rule, rhost, rpath, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC) AS k FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
    "op11_filter_audit": """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT)
  + 4 * CAST(100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
  + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS INT) AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT substr('ABCDE', CAST(k + 1 AS INT), 1) AS f, CAST(1 << k AS INT) AS bit FROM range(5) t(k)),
p AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
  AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
o AS (SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS gone FROM p, range(1, 6) t(s)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (gone | bit) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & gone = 0) AS removed,
  sum(n) FILTER (mask & bit <> 0 AND mask & gone <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & bit <> 0 AND mask & gone = 0) AS good_lost,
  sum(toxic) FILTER (mask & bit <> 0 AND mask & gone = 0) AS toxic_lost FROM c, o GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM r""",
    "op13_clustering": _clustering_sql(),
}
