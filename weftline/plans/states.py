"""Queries over stored states: scans, caches, archives and ordered listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators.tables import appended, cache_state, diff, numbered, refreshed, upsert, without_keys
from weftline.plans.catalog import K, PAGES_SQL, _calls, _endpoints, analysis_status
from weftline.plans.registry import query
from weftline.sources.tables import table

c = F.col

FILES_SQL = """n AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h FROM documents WHERE source NOT IN ('src1', 'src2')),
 o AS (SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 13 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 17 <> 0
 UNION ALL SELECT source || '/gone' || doc_id, sha256(text) FROM documents WHERE doc_id % 19 = 0)"""


def _scans(spark, d):
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), c("doc_id").cast("string")).alias("path"), "source", "doc_id", "text")
    new = docs.where(~c("source").isin("src1", "src2")).select("path", F.sha2("text", 256).alias("h"))
    changed = F.when(c("doc_id") % 13 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    gone = docs.where("doc_id % 19 = 0").select(F.concat("source", F.lit("/gone"), c("doc_id").cast("string")), F.sha2("text", 256))
    return docs.where("doc_id % 17 <> 0").select("path", changed.alias("h")).union(gone), new


@query(f"""WITH {FILES_SQL} SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN CASE WHEN o.path LIKE 'src1/%' OR o.path LIKE 'src2/%' THEN 'kept' ELSE 'removed' END
 WHEN n.h = o.h THEN 'unchanged' ELSE 'changed' END AS status FROM n FULL JOIN o ON n.path = o.path""")
def scan_missing_roots(spark, d):
    """A scan of which two roots are missing: what was known under them is kept (src1 is no root of src10's files)."""
    old, new = _scans(spark, d)
    return diff(old, new, "path", "h", missing_roots=["src1", "src2"])


@query(f"""WITH {FILES_SQL}, s AS (SELECT path, h, 1 AS scan FROM o WHERE (path NOT LIKE '%gone%' OR path LIKE 'src1/%' OR path LIKE 'src2/%') AND NOT EXISTS (SELECT 1 FROM n WHERE n.path = o.path AND n.h <> o.h)
 UNION ALL SELECT path, h, 2 FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = n.path AND o.h = n.h)) SELECT path, h, scan::INT AS scan FROM s""")
def scan_state(spark, d):
    """The stored files after a scan: unchanged rows as they were, new and changed ones written, removed ones deleted."""
    old, new = _scans(spark, d)
    gone = diff(old, new, "path", "h", missing_roots=["src1", "src2"]).where("status = 'removed'")
    state = upsert(old.withColumn("scan", F.lit(1)), new.withColumn("scan", F.lit(2)), ["path"], digest="h")
    return without_keys(state, gone, ["path"]).select("path", "h", "scan")


@query("""WITH p AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS put, max(ts) FILTER (event_type = 'error') AS cleared FROM events GROUP BY 1 HAVING put IS NOT NULL AND (cleared IS NULL OR cleared < put))
 SELECT p.user_id, epoch_us(put) AS entry, count(e.ts) AS hits, epoch_us(coalesce(max(e.ts), put)) AS last_used FROM p LEFT JOIN events e ON e.user_id = p.user_id AND e.event_type IN ('view', 'click') AND e.ts > put GROUP BY p.user_id, put""")
def cache_log(spark, d):
    """A cache from its log: purchases put an entry, views and clicks touch it, errors clear it."""
    op = F.when(c("event_type") == "purchase", "put").when(c("event_type") == "error", "clear").when(c("event_type").isin("view", "click"), "touch")
    log = table(spark, d, "events").select("user_id", op.alias("op"), F.unix_micros(c("ts").cast("timestamp")).alias("at"))
    return cache_state(log, "user_id", "op", "at")


@query(f"""SELECT count(*) AS calls, coalesce(sum({K}), 0)::BIGINT AS tokens, count(*) FILTER (event_type = 'error') AS failed FROM events WHERE ts >= TIMESTAMP '2024-01-15'""")
def usage_since(spark, d):
    calls = _calls(spark, d).where(c("ts").cast("timestamp_ntz") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(c("provider") == "error").alias("failed"))


@query("""WITH l AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 3), n AS (SELECT event_id, user_id, event_type, ts FROM events WHERE event_id % 10 = 3)
 SELECT event_id AS id, user_id, event_type FROM l UNION ALL SELECT (SELECT max(event_id) FROM l) + row_number() OVER (ORDER BY ts, user_id, event_id), user_id, event_type FROM n""")
def log_append(spark, d):
    """New calls appended to the log, numbered on from its last id in order of time."""
    e = table(spark, d, "events")
    log = e.where("event_id % 10 <> 3").select(c("event_id").alias("id"), "user_id", "event_type")
    return appended(log, e.where("event_id % 10 = 3").select("user_id", "event_type", "ts", "event_id"), "id", ["ts", "user_id", "event_id"])


@query("""SELECT c_nationkey, c_mktsegment, arg_max(c_custkey, c_custkey) AS last FROM customer GROUP BY ALL""")
def full_refresh(spark, d):
    """A refresh where keys repeat: the last row of each key stays."""
    rows = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", c("c_custkey").alias("last"))
    return refreshed(rows.withColumn("seq", c("last")), ["c_nationkey", "c_mktsegment"], "seq").select("c_nationkey", "c_mktsegment", "last")


@query("""SELECT status, count(*) AS n FROM (SELECT source, CASE WHEN bool_or(l.quality = 0) THEN 'stale' WHEN count(l.doc_id) = 0 THEN 'none' WHEN count(l.doc_id) < count(*) THEN 'partial' ELSE 'cached' END AS status
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source) GROUP BY status""")
def status_histogram(spark, d):
    return analysis_status(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT date_trunc('month', o_orderdate) AS version, o_orderpriority AS id, sum(o_custkey) AS h FROM orders GROUP BY ALL),
 k AS (SELECT version, dense_rank() OVER (ORDER BY version) AS k FROM (SELECT DISTINCT version FROM v)), e AS (SELECT k, id, h FROM v JOIN k USING (version))
 SELECT coalesce(n.k, o.k + 1)::BIGINT AS entry, coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN n.h = o.h THEN 'unchanged' ELSE 'changed' END AS status
 FROM e n FULL JOIN e o ON n.id = o.id AND n.k = o.k + 1 WHERE coalesce(n.k, o.k + 1) <= (SELECT max(k) FROM k)""")
def archive_diff(spark, d):
    """Each archived version against the one before it: what was added, changed and removed."""
    v = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("version"), c("o_orderpriority").alias("id")).agg(F.sum("o_custkey").alias("h"))
    k = numbered(v.select("version").distinct(), ["version"]).withColumnRenamed("number", "k")
    e = v.join(k, "version").select("k", "id", "h")
    last = k.agg(F.max("k").alias("last")).scalar()
    old = e.select((c("k") + 1).alias("ko"), c("id").alias("io"), c("h").alias("ho"))
    both = e.join(old, (c("k") == c("ko")) & (c("id") == c("io")), "full")
    status = F.when(c("io").isNull(), "added").when(c("id").isNull(), "removed").when(c("h") == c("ho"), "unchanged").otherwise("changed")
    return both.select(F.coalesce("k", "ko").alias("entry"), F.coalesce("id", "io").alias("id"), status.alias("status")).where(c("entry") <= last)


@query(f"""WITH {PAGES_SQL} SELECT page_id, row_number() OVER (ORDER BY path, method, page_id) AS listed,
 row_number() OVER (ORDER BY lower(path), method, page_id) AS by_path, row_number() OVER (ORDER BY CASE method WHEN 'PUT' THEN 0 WHEN 'GET' THEN 1 ELSE 2 END, lower(path), method, page_id) AS by_config FROM pages2""")
def endpoint_order_modes(spark, d):
    """Places of endpoints in the plain listing, by path, and by a configured order of methods."""
    e = _endpoints(spark, d)
    wanted = F.coalesce(F.nullif(F.array_position(F.array(F.lit("PUT"), F.lit("GET")), c("method")), F.lit(0)), F.lit(3))
    e = numbered(e, ["path", "method", "page_id"]).withColumnRenamed("number", "listed")
    e = numbered(e, [F.lower("path"), c("method"), c("page_id")]).withColumnRenamed("number", "by_path")
    e = numbered(e, [wanted, F.lower("path"), c("method"), c("page_id")]).withColumnRenamed("number", "by_config")
    return e.select("page_id", "listed", "by_path", "by_config")


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3""")
def last_entries(spark, d):
    """The last three entries of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "event_id", "event_type")
