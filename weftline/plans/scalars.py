"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.plans.registry import query
from weftline.sources.tables import table

c = F.col


@query(r"""WITH n AS (SELECT DISTINCT c_mktsegment, lower(substr(c_mktsegment, 1, 1)) || substr(c_mktsegment, 2, 2) || 'My' || c_mktsegment AS name FROM customer),
 w AS (SELECT *, lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS words FROM n)
 SELECT name, upper(substr(name, 1, 1)) || substr(name, 2) AS upper_camel, words AS snake, upper(words) AS upper_snake, replace(words, '_', '-') AS kebab, replace(words, '_', '.') AS dot, lower(name) AS lower, name AS other FROM w""")
def naming_strategies(spark, d):
    seg = c("c_mktsegment")
    name = F.concat(F.lower(seg.substr(1, 1)), seg.substr(2, 2), F.lit("My"), seg)
    n = table(spark, d, "customer").select(name.alias("name")).distinct()
    by = {"upper_camel": "UpperCamelCase", "snake": "SnakeCase", "upper_snake": "UpperSnakeCase", "kebab": "KebabCase", "dot": "LowerDotCase", "lower": "LowerCase", "other": "SomethingElse"}
    return n.select("name", *(T.wire_name(c("name"), v).alias(k) for k, v in by.items()))


@query("""WITH t AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 'MediaType.APPLICATION_JSON_VALUE' WHEN 1 THEN 'TEXT_PLAIN' WHEN 2 THEN 'text/csv' ELSE 'MediaType.WILDCARD' END AS constant FROM pages)
 SELECT page_id, constant, CASE page_id % 4 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'text/csv' ELSE '*/*' END AS media FROM t""")
def media_type(spark, d):
    names = F.array(*map(F.lit, ("MediaType.APPLICATION_JSON_VALUE", "TEXT_PLAIN", "text/csv", "MediaType.WILDCARD")))
    t = table(spark, d, "pages").select("page_id", F.get(names, (c("page_id") % 4).cast("int")).alias("constant"))
    return t.select("page_id", "constant", T.media_type(c("constant")).alias("media"))


@query("""WITH t AS (SELECT doc_id, text, left(text, 359) AS cut, 359 - strpos(reverse(left(text, 359)), chr(10)) AS nl, strpos(left(text, 359), chr(10)) > 0 AS has FROM documents)
 SELECT doc_id, sha256(CASE WHEN length(text) <= 359 THEN text WHEN has AND nl > 359 * 0.6 THEN left(text, nl) || chr(10) || '[cut]' || chr(10) ELSE cut || chr(10) || '[cut]' || chr(10) END) AS digest FROM t""")
def truncated_texts(spark, d):
    """Texts cut to 100 estimated tokens."""
    return table(spark, d, "documents").select("doc_id", F.sha2(T.truncated(c("text"), 100), 256).alias("digest"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3")
def json_replies(spark, d):
    """Objects in replies: fenced, amid chatter with trailing commas, plain, and none at all."""
    props, kind = c("props"), c("event_id") % 4
    reply = F.when(kind == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Here it is: "), F.regexp_replace(props, r"\}$", ", }"), F.lit(" done")))
    reply = reply.when(kind == 2, props).otherwise(F.lit("no object { here"))
    got = table(spark, d, "events").select("event_id", T.lenient_json(reply).alias("v"))
    return got.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("""WITH s AS (SELECT p_partkey, trim(regexp_replace(p_name, '[ /_]+', '-', 'g'), '.-') AS base FROM part),
 n AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY p_partkey) AS k FROM s) SELECT p_partkey, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM n""")
def unique_slugs(spark, d):
    """Slugs with a number from 2 on where one is taken, in order of the key.  The numbers of one slug are dealt in one
    task's sorted stream; a slug that itself ends in such a number may be taken twice."""
    s = table(spark, d, "part").select("p_partkey", T.project_slug(c("p_name")).alias("base"))
    k = F.row_number().over(Window.partitionBy(F.lower("base")).orderBy("p_partkey"))
    return s.withColumn("k", k).select("p_partkey", F.when(c("k") == 1, c("base")).otherwise(F.concat("base", F.lit("-"), c("k").cast("string"))).alias("slug"))


@query("SELECT DISTINCT o_orderdate::DATE AS day, o_orderdate::DATE AS back FROM orders")
def jalali_both_ways(spark, d):
    """Dates to the Solar Hijri calendar and back again."""
    days = table(spark, d, "orders").select(c("o_orderdate").cast("date").alias("day")).distinct()
    part = lambda k: F.element_at(F.split("j", "-"), k).cast("int")
    return days.withColumn("j", T.jalali(c("day"))).select("day", T.gregorian(part(1), part(2), part(3)).alias("back"))
