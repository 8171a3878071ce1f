"""Queries that make endpoints of mappings, on keys of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators.endpoints import expanded_endpoints, header_rows, unique_endpoints
from weftline.plans.registry import query
from weftline.sources.tables import node, table

c = F.col


@query("""WITH m AS (SELECT s_suppkey AS seq, 'app.N' || s_nationkey || '#call' || (s_suppkey % 3) || '(int)' AS handler, CASE WHEN s_suppkey % 4 = 0 THEN [''] ELSE ['/api/', 'v' || (s_suppkey % 2)] END AS base,
  CASE WHEN s_suppkey % 5 = 0 THEN [''] ELSE ['n' || s_nationkey || '/{id:[0-9]+}/', '/all'] END AS paths, CASE s_suppkey % 3 WHEN 0 THEN ['ANY'] WHEN 1 THEN ['GET'] ELSE ['GET', 'POST'] END AS http,
  CASE WHEN s_suppkey % 2 = 0 THEN 'text/plain' ELSE 'n' || s_nationkey END AS media FROM supplier),
 x AS (SELECT seq, handler, media, unnest(http) AS http_method, flatten([[regexp_replace(regexp_replace(regexp_replace('/' || b || '/' || p, '/+', '/', 'g'), '\\{([^}:]+):[^}]*\\}', '{\\1}', 'g'), '(.)/$', '\\1') FOR p IN paths] FOR b IN base]) AS every FROM m),
 d AS (SELECT handler, media, http_method, every[1] AS path, array_to_string(every[2:], ',') AS aliases FROM x QUALIFY row_number() OVER (PARTITION BY http_method, every[1], handler ORDER BY seq) = 1),
 i AS (SELECT *, http_method || ' ' || path AS base_id, count(*) OVER (PARTITION BY http_method || ' ' || path) AS n FROM d)
 SELECT CASE WHEN n > 1 THEN base_id || ' @' || regexp_replace(split_part(split_part(handler, '#', 1), '.', -1), '', '') || '.' || split_part(split_part(handler, '#', 2), '(', 1) ELSE base_id END AS id, handler, path, aliases, media FROM i""")
def mapped_endpoints(spark, d):
    """Endpoints of suppliers' mappings: base paths by paths, the first counts; one for each method; ids made unique."""
    s = table(spark, d, "supplier")
    k, nation = c("s_suppkey"), c("s_nationkey").cast("string")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    none = F.lit(None).cast("array<string>")
    mappings = s.select(
        k.alias("seq"),
        text("app.N", nation, "#call", (k % 3).cast("string"), "(int)").alias("handler"),
        F.when(k % 4 != 0, F.array(F.lit("/api/"), text("v", (k % 2).cast("string")))).alias("base_paths"),
        F.when(k % 5 != 0, F.array(text("n", nation, "/{id:[0-9]+}/"), F.lit("/all"))).alias("paths"),
        F.when(k % 3 == 1, F.array(F.lit("get"))).when(k % 3 == 2, F.array(F.lit("GET"), F.lit("post"))).otherwise(none).alias("http_methods"),
        F.when(k % 2 == 0, F.array(F.lit("text/plain"))).alias("own_media"),
        F.array(text("n", nation)).alias("class_media"),
    )
    return unique_endpoints(expanded_endpoints(mappings)).select("id", "handler", "path", F.array_join("aliases", ",").alias("aliases"), F.array_join("media", ",").alias("media"))


@query("""WITH p AS (SELECT c_nationkey AS e, min(c_custkey) AS seq, c_mktsegment AS name FROM customer GROUP BY 1, c_mktsegment),
 r AS (SELECT n_nationkey AS e, 0 AS source, x.seq, x.name, NULL AS code, x.req, x.des FROM nation, (VALUES (0, 'Building', false, ''), (1, 'X-Trace', true, 'trace')) x(seq, name, req, des)
 UNION ALL SELECT e, 1, seq, name, 'arg' || seq, seq % 2 = 0, CASE WHEN seq % 3 = 0 THEN '' ELSE 'from ' || seq END FROM p
 UNION ALL SELECT n_nationkey, 2, 0, 'machinery', NULL, true, NULL FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 2, 1, 'Authorization', NULL, true, NULL FROM nation),
 m AS (SELECT e, lower(name) AS k, min((source, seq)) AS pos, arg_min(name, (source, seq)) AS name, arg_max(code, seq) FILTER (source = 1) AS code, arg_min(req, (source, seq)) OR bool_or(source = 2) AS required, arg_min(des, (source, seq)) FILTER (coalesce(des, '') <> '') AS des FROM r GROUP BY 1, 2)
 SELECT 'nation:' || e AS endpoint, row_number() OVER (PARTITION BY e ORDER BY pos, k)::INT AS number, name, coalesce(code, name) AS code_name, required, coalesce(des, '') AS description FROM m""")
def endpoint_headers(spark, d):
    """The headers of each nation: common ones, then parameters (segments of its customers), then authentication."""
    nations = table(spark, d, "nation")
    endpoint = node("nation", c("n_nationkey")).alias("endpoint")
    first = table(spark, d, "customer").groupBy("c_nationkey", c("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("seq"))
    said = F.when(c("seq") % 3 != 0, F.concat(F.lit("from "), c("seq").cast("string"))).otherwise("")
    params = first.select(node("nation", c("c_nationkey")).alias("endpoint"), "seq", "name", F.concat(F.lit("arg"), c("seq").cast("string")).alias("code_name"), (c("seq") % 2 == 0).alias("required"), said.alias("description"))
    auth = nations.where("n_nationkey % 2 = 0").select(endpoint, F.lit(0).alias("seq"), F.lit("machinery").alias("name")).unionByName(nations.select(endpoint, F.lit(1).alias("seq"), F.lit("Authorization").alias("name")))
    return header_rows(nations.select(endpoint), [("Building", False, ""), ("X-Trace", True, "trace")], params, auth)
