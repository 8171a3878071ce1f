"""The registered queries of the lineage operators, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import values as V
from weftline.operators import graph
from weftline.operators.resolution import two_smallest
from weftline.operators.tables import best_per_key, diff, numbered
from weftline.plans.registry import query
from weftline.sources.tables import EDGES_SQL, SYMBOLS_SQL, edges, node, symbols, table, tasks

c = F.col


# --- graph -----------------------------------------------------------------------------------------------------------

REACH = "reach AS (SELECT {start} UNION SELECT e.{to} AS node, r.depth + 1 AS depth FROM reach r JOIN edges e ON e.{at} = r.node WHERE r.depth < {depth})"


@query(f"""WITH RECURSIVE {EDGES_SQL}, {REACH.format(start="'supplier:' || s_suppkey AS node, 0 AS depth FROM supplier WHERE s_acctbal < 0", to="src", at="dst", depth=2)}
 SELECT node, min(depth)::INT AS depth FROM reach WHERE node LIKE 'order:%' GROUP BY node""")
def impact(spark, d):
    """Orders that a changed supplier (one in debt) reaches through its parts."""
    changed = table(spark, d, "supplier").where("s_acctbal < 0").select(node("supplier", c("s_suppkey")).alias("node"))
    up = graph.reversed_edges(edges(spark, d).where(c("kind").isin("supplied_by", "contains_part")))
    return graph.distance(changed, up, 2).where(c("node").startswith("order:")).select("node", "depth")


@query(f"""WITH RECURSIVE {EDGES_SQL}, {REACH.format(start="'customer:' || c_custkey AS node, 0 AS depth FROM customer", to="dst", at="src", depth=3)}
 SELECT node, min(depth)::INT AS depth FROM reach GROUP BY node""")
def reach_from_customers(spark, d):
    start = table(spark, d, "customer").select(node("customer", c("c_custkey")).alias("node"))
    return graph.distance(start, edges(spark, d), 3).select("node", "depth")


@query(f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT 'nation:' || n_nationkey AS root, 'nation:' || n_nationkey AS node, 0 AS depth FROM nation
 UNION SELECT r.root, e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.node WHERE r.depth < 8)
 SELECT root, node, min(depth)::INT AS depth, left(sha256(node), 12) AS digest FROM r GROUP BY root, node""")
def controller_graph(spark, d):
    """All entities that hang on each nation, with their depth and a short digest."""
    start = table(spark, d, "nation").select(node("nation", c("n_nationkey")).alias("root"), node("nation", c("n_nationkey")).alias("node"))
    near = graph.distance(start, graph.reversed_edges(edges(spark, d)), 8, key=["root"], also={"digest": F.substring(F.sha2("node", 256), 1, 12)})
    return near.select("root", "node", "depth", "digest")


PARTS_SQL = "edges AS (SELECT p_partkey AS src, p_partkey // 10 AS dst FROM part WHERE p_partkey // 10 > 0)"


def _part_tree(spark, d):
    up = (c("p_partkey") / 10).cast("long")
    return table(spark, d, "part").select(c("p_partkey").alias("src"), F.floor(up).alias("dst")).where("dst > 0")


@query(f"""WITH RECURSIVE {PARTS_SQL}, r AS (SELECT src, src AS dst, 0 AS depth FROM edges UNION SELECT dst, dst, 0 FROM edges
 UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.dst)
 SELECT src, dst, min(depth)::INT AS depth FROM r GROUP BY src, dst""")
def ancestor_closure(spark, d):
    return graph.closure(_part_tree(spark, d)).select("src", "dst", "depth")


@query(f"""WITH RECURSIVE {PARTS_SQL}, r AS (SELECT src, src AS dst, 0 AS depth FROM edges UNION SELECT dst, dst, 0 FROM edges
 UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.dst)
 SELECT dst AS root, count(DISTINCT src) AS n_descendants FROM r WHERE depth > 0 GROUP BY dst""")
def descendant_closure(spark, d):
    below = graph.closure(_part_tree(spark, d)).where("depth > 0")
    return below.groupBy(c("dst").alias("root")).agg(F.count_distinct("src").alias("n_descendants"))


@query(f"""WITH RECURSIVE {PARTS_SQL}, r AS (SELECT src, src AS dst, 0 AS depth FROM edges UNION SELECT dst, dst, 0 FROM edges
 UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.dst)
 SELECT src AS owner, p_type AS member, p_partkey AS defined_by FROM r JOIN part ON dst = p_partkey
 QUALIFY row_number() OVER (PARTITION BY src, p_type ORDER BY depth, p_partkey) = 1""")
def shadowed_members(spark, d):
    """Members (types) that each part has or inherits; the nearest definition hides farther ones."""
    part = table(spark, d, "part").select(c("p_partkey").alias("dst"), c("p_type").alias("member"))
    all_members = graph.closure(_part_tree(spark, d)).join(part, "dst").select(c("src").alias("owner"), "member", c("dst").alias("defined_by"), "depth")
    return best_per_key(all_members, ["owner", "member"], F.struct("depth", "defined_by")).select("owner", "member", "defined_by")


@query(f"WITH {EDGES_SQL}, {SYMBOLS_SQL} SELECT (SELECT count(*) FROM symbols) AS symbols, count(*) AS edges, count(*) FILTER (dst LIKE 'region:%') AS region_edges, count(DISTINCT src) AS sources FROM edges")
def graph_stats(spark, d):
    n = symbols(spark, d).agg(F.count(F.lit(1)).alias("symbols"))
    e = edges(spark, d).select("src", c("dst").startswith("region:").alias("up"))
    each = e.repartition(tasks(table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")), "src").groupBy("src")
    each = each.agg(F.count(F.lit(1)).alias("n"), F.count_if("up").alias("up"))  # a null source is no source, its edges count
    e = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.sum("up"), F.lit(0)).alias("region_edges"), F.count("src").alias("sources"))
    return n.withColumn("one", F.lit(1)).join(e.withColumn("one", F.lit(1)), "one").drop("one")


@query(f"WITH {SYMBOLS_SQL} SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def symbols_by_kind(spark, d):
    return symbols(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES_SQL} SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edges_by_kind(spark, d):
    return edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SYMBOLS_SQL} SELECT qname, name FROM symbols WHERE kind = 'part' AND name ILIKE '%BLUE%' ORDER BY qname LIMIT 20")
def find_symbols(spark, d):
    return symbols(spark, d).where((c("kind") == "part") & c("name").ilike("%BLUE%")).orderBy("qname").limit(20).select("qname", "name")


@query(f"WITH {EDGES_SQL} SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node")
def deps_one_hop(spark, d):
    e = edges(spark, d)
    ends = e.select(c("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


@query(f"WITH {SYMBOLS_SQL} SELECT p.qname, p.name, count(ch.qname) AS n_children FROM symbols p LEFT JOIN symbols ch ON ch.parent = p.qname WHERE p.kind IN ('region', 'nation') GROUP BY ALL")
def children(spark, d):
    s = symbols(spark, d)
    counted = s.groupBy(c("parent").alias("up")).agg(F.count(F.lit(1)).alias("n"))
    top = s.where(c("kind").isin("region", "nation"))
    return top.join(counted, c("qname") == c("up"), "left").select("qname", "name", F.coalesce("n", F.lit(0)).alias("n_children"))


@query(f"""WITH {EDGES_SQL}, {SYMBOLS_SQL} SELECT '{{"src":"' || src || '","dst":"' || dst || '","kind":"' || kind || '"}}' AS line FROM edges
 UNION ALL SELECT '{{"qname":"' || qname || '","kind":"' || kind || '","name":"' || name || '"}}' FROM symbols""")
def symbol_graph_export(spark, d):
    """All edges and symbols as lines of JSON."""
    lines = symbols(spark, d).select(F.to_json(F.struct("qname", "kind", "name")).alias("line"))
    return edges(spark, d).select(F.to_json(F.struct("src", "dst", "kind")).alias("line")).union(lines)


@query(f"""WITH {EDGES_SQL} SELECT '  "' || src || '" -> "' || dst || '" [label="' || kind || '"];' AS line FROM edges WHERE kind <> 'contains_part' AND dst NOT LIKE 'region:%'""")
def symbol_graph_dot(spark, d):
    """The edges for a drawing: without the most common kind and outside targets (regions)."""
    shown = edges(spark, d).where((c("kind") != "contains_part") & ~c("dst").startswith("region:"))
    return shown.select(F.format_string('  "%s" -> "%s" [label="%s"];', "src", "dst", "kind").alias("line"))


# --- names and joins -------------------------------------------------------------------------------------------------


@query("""WITH cand AS (
 SELECT p.p_partkey AS ref, 1 AS stage, q.p_partkey AS target FROM part p JOIN part q ON q.p_name = p.p_name AND q.p_partkey <> p.p_partkey
 UNION ALL SELECT p.p_partkey, 2, q.k FROM part p JOIN (SELECT p_brand, p_type, min(p_partkey) AS k FROM part GROUP BY ALL HAVING count(*) = 1) q ON q.p_brand = p.p_brand AND q.p_type = p.p_type
 UNION ALL SELECT p.p_partkey, 3, q.k FROM part p JOIN (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY p_brand) q USING (p_brand))
 SELECT ref, stage::INT AS stage, target FROM cand QUALIFY row_number() OVER (PARTITION BY ref ORDER BY stage, target) = 1""")
def resolve_names(spark, d):
    """A name by stages: the same full name, the only one of its package and root, the first of its package."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    ref = part.withColumnRenamed("p_partkey", "ref")
    same = two_smallest(part, ["p_name"], "p_partkey").select("p_name", "first", "second")
    only = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("target"), F.count(F.lit(1)).alias("n")).where("n = 1")
    first = part.groupBy("p_brand").agg(F.min("p_partkey").alias("target"))
    other = ref.join(same, "p_name").withColumn("target", F.when(c("first") != c("ref"), c("first")).otherwise(c("second"))).where("target IS NOT NULL")
    stages = [other, ref.join(only, ["p_brand", "p_type"]), ref.join(first, "p_brand")]
    cand = [s.select("ref", F.lit(k).alias("stage"), "target") for k, s in enumerate(stages, 1)]
    return best_per_key(cand[0].union(cand[1]).union(cand[2]), ["ref"], F.struct("stage", "target"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id) GROUP BY event_type")
def const_refs(spark, d):
    known = table(spark, d, "customer").select(c("c_custkey").alias("user_id"))
    return table(spark, d, "events").join(known, "user_id", "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("""WITH a AS (SELECT lower(c_mktsegment) AS k, min(c_mktsegment) AS v FROM customer GROUP BY 1), b AS (SELECT lower(p_type) AS k, min(p_type) AS v FROM part GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS header, coalesce(a.v, b.v) AS value, CASE WHEN a.k IS NULL THEN 'param' ELSE 'config' END AS origin FROM a FULL JOIN b ON a.k = b.k""")
def header_merge(spark, d):
    a = table(spark, d, "customer").groupBy(F.lower("c_mktsegment").alias("k")).agg(F.min("c_mktsegment").alias("v"))
    b = table(spark, d, "part").groupBy(F.lower("p_type").alias("k2")).agg(F.min("p_type").alias("v2"))
    return a.join(b, c("k") == c("k2"), "full").select(F.coalesce("k", "k2").alias("header"), F.coalesce("v", "v2").alias("value"), F.when(c("k").isNull(), "param").otherwise("config").alias("origin"))


@query("""WITH u AS (SELECT o_orderpriority AS code, 1 AS pri, max(o_orderstatus) AS title FROM orders WHERE o_totalprice > 300000 GROUP BY 1
 UNION ALL SELECT o_orderpriority, 2, min(o_orderstatus) FROM orders GROUP BY 1)
 SELECT code, pri::INT AS pri, title FROM u QUALIFY row_number() OVER (PARTITION BY code ORDER BY pri) = 1""")
def error_merge(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_totalprice > 300000").groupBy(c("o_orderpriority").alias("code")).agg(F.lit(1).alias("pri"), F.max("o_orderstatus").alias("title"))
    b = o.groupBy(c("o_orderpriority").alias("code")).agg(F.lit(2).alias("pri"), F.min("o_orderstatus").alias("title"))
    return best_per_key(a.union(b), ["code"], c("pri")).select("code", "title", "pri")


# --- scans, diffs, cache ---------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT doc_id AS path, sha256(text) AS h FROM documents),
 o AS (SELECT doc_id AS path, CASE WHEN doc_id % 13 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT -doc_id - 1, sha256(text) FROM documents WHERE doc_id % 19 = 0)
 SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN n.h = o.h THEN 'unchanged' ELSE 'changed' END AS status FROM n FULL JOIN o ON n.path = o.path""")
def file_scan_diff(spark, d):
    """Today's files against the last scan: some new, some changed, some gone."""
    docs = table(spark, d, "documents").select(c("doc_id").alias("path"), "text")
    new = docs.select("path", F.sha2("text", 256).alias("h"))
    changed = F.when(c("path") % 13 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    old = docs.where("path % 17 <> 0").select("path", changed.alias("h")).union(docs.where("path % 19 = 0").select(-c("path") - 1, F.sha2("text", 256)))
    return diff(old, new, "path", "h")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def missing_source(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(r"SELECT sha256(trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g'))) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def content_hash_groups(spark, d):
    return table(spark, d, "documents").groupBy(T.content_hash(c("text")).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("SELECT lang, count(*) AS n, sum(CASE WHEN length(text) = 0 THEN 0 ELSE trunc(length(text) / 3.6)::BIGINT + 1 END)::BIGINT AS tokens FROM documents GROUP BY lang")
def token_estimate(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(T.estimated_tokens(c("text"))).alias("tokens"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, trunc(length(text) / 3.6)::BIGINT + 1 AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
 r AS (SELECT conv_id, turn, rn, tok, tok AS acc, 1 AS batch FROM t WHERE rn = 1
 UNION ALL SELECT t.conv_id, t.turn, t.rn, t.tok, CASE WHEN r.acc + t.tok > 120 THEN t.tok ELSE r.acc + t.tok END, CASE WHEN r.acc + t.tok > 120 THEN r.batch + 1 ELSE r.batch END FROM r JOIN t ON t.conv_id = r.conv_id AND t.rn = r.rn + 1)
 SELECT conv_id, turn, batch::INT AS batch FROM r""")
def greedy_batches(spark, d):
    """Turns of a conversation into batches of at most 120 tokens, a new one when the next turn does not fit."""
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", T.estimated_tokens(c("text")).alias("tok")).alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("acc"), F.lit(0).alias("batch"), F.array().cast("array<struct<turn:bigint,batch:int>>").alias("out"))

    def step(a, t):
        fresh = (a["batch"] == 0) | (a["acc"] + t["tok"] > 120)
        batch = F.when(fresh, a["batch"] + 1).otherwise(a["batch"])
        return F.struct(F.when(fresh, t["tok"]).otherwise(a["acc"] + t["tok"]).alias("acc"), batch.alias("batch"), F.concat(a["out"], F.array(F.struct(t["turn"].alias("turn"), batch.alias("batch")))).alias("out"))

    packed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return packed.select("conv_id", F.explode(F.aggregate("ts", start, step, lambda a: a["out"])).alias("b")).select("conv_id", "b.turn", "b.batch")


@query("""WITH t AS (SELECT conv_id, turn, greatest(1, trunc(length(text) / 3.6)::BIGINT + 1) AS tok FROM conversations)
 SELECT conv_id, turn, (1000 * tok // sum(tok) OVER (PARTITION BY conv_id))::BIGINT AS share FROM t""")
def token_share(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.greatest(F.lit(1), T.estimated_tokens(c("text"))).alias("tok"))
    total = t.groupBy("conv_id").agg(F.sum("tok").alias("all"))
    return t.join(total, "conv_id").select("conv_id", "turn", F.floor(1000 * c("tok") / c("all")).alias("share"))


K = "coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0)"


def _calls(spark, d):
    e = table(spark, d, "events")
    return e.select(c("event_type").alias("provider"), (c("user_id") % 3).alias("model"), F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)).alias("tokens"), "event_id", "user_id", "ts")


@query(f"SELECT count(*) AS calls, coalesce(sum({K}), 0)::BIGINT AS tokens, count(*) FILTER (event_type = 'error') AS failed FROM events")
def usage_totals(spark, d):
    return _calls(spark, d).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(c("provider") == "error").alias("failed"))


@query(f"SELECT event_type AS provider, user_id % 3 AS model, count(*) AS calls, sum({K})::BIGINT AS tokens FROM events GROUP BY ALL")
def usage_by_model(spark, d):
    return _calls(spark, d).groupBy("provider", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))


@query(f"SELECT event_type AS unit_kind, count(*) AS entries, count(DISTINCT user_id) AS units, coalesce(sum({K}), 0)::BIGINT AS hits FROM events GROUP BY 1")
def cache_stats(spark, d):
    return _calls(spark, d).groupBy(c("provider").alias("unit_kind")).agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("user_id").alias("units"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("hits"))


@query("SELECT event_type AS unit_kind, user_id AS unit_id, max_by(event_id, ts) AS entry FROM events GROUP BY 1, 2")
def cache_latest(spark, d):
    units = _calls(spark, d).select(c("provider").alias("unit_kind"), c("user_id").alias("unit_id"), "ts", c("event_id").alias("entry"))
    return best_per_key(units, ["unit_kind", "unit_id"], c("ts"), last=True).select("unit_kind", "unit_id", "entry")


@query("""SELECT d.lang, count(*) AS units, count(l.doc_id) AS hits, count(*) - count(l.doc_id) AS misses, sum(CASE WHEN l.doc_id IS NULL THEN trunc(length(text) / 3.6)::BIGINT + 1 ELSE 0 END)::BIGINT AS miss_tokens
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""")
def cache_plan(spark, d):
    """What a run would send: units without a stored result, and their tokens."""
    units = table(spark, d, "documents").select("doc_id", "lang", T.estimated_tokens(c("text")).alias("tok"))
    stored = table(spark, d, "labels").select(c("doc_id").alias("stored"))
    return units.join(stored, c("doc_id") == c("stored"), "left").groupBy("lang").agg(F.count(F.lit(1)).alias("units"), F.count("stored").alias("hits"), F.count_if(c("stored").isNull()).alias("misses"), F.sum(F.when(c("stored").isNull(), c("tok")).otherwise(0)).alias("miss_tokens"))


@query("SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 0)")
def cache_prune(spark, d):
    return table(spark, d, "events").join(table(spark, d, "customer").where("c_acctbal > 0").select(c("c_custkey").alias("user_id")), "user_id", "left_anti").select("event_id")


@query("""SELECT source, CASE WHEN bool_or(l.quality = 0) THEN 'stale' WHEN count(l.doc_id) = 0 THEN 'none' WHEN count(l.doc_id) < count(*) THEN 'partial' ELSE 'cached' END AS status
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def analysis_status(spark, d):
    l = table(spark, d, "labels").select(c("doc_id").alias("k"), "quality")  # noqa: E741
    joined = table(spark, d, "documents").select("doc_id", "source").join(l, c("doc_id") == c("k"), "left")
    status = F.when(F.bool_or(c("quality") == 0), "stale").when(F.count("k") == 0, "none").when(F.count("k") < F.count(F.lit(1)), "partial").otherwise("cached")
    return joined.groupBy("source").agg(status.alias("status"))


@query("""WITH o AS (SELECT o_custkey AS id, max(o_totalprice) AS h FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), n AS (SELECT o_custkey AS id, max(o_totalprice) AS h FROM orders GROUP BY 1)
 SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN n.h = o.h THEN 'unchanged' ELSE 'changed' END AS status FROM n FULL JOIN o ON n.id = o.id""")
def changelog_snapshot(spark, d):
    o = table(spark, d, "orders")
    snap = lambda x: x.groupBy(c("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("h"))
    return diff(snap(o.where("o_orderstatus = 'F'")), snap(o), "id", "h")


@query("""SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey)) AS doc_hash FROM lineitem GROUP BY l_orderkey""")
def doc_hash(spark, d):
    line = F.struct("l_linenumber", "l_partkey")
    packed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    return packed.select("l_orderkey", F.sha2(F.array_join(F.transform("x", lambda r: F.concat(r["l_linenumber"].cast("string"), F.lit(":"), r["l_partkey"].cast("string"))), "\n"), 256).alias("doc_hash"))


# --- endpoints and scalars -------------------------------------------------------------------------------------------

PAGES_SQL = r"""pages2 AS (SELECT page_id, ['GET','POST','PUT','DELETE'][page_id % 4 + 1] AS method,
 CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/$', '') END AS path FROM (SELECT page_id, regexp_replace('/' || regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS p FROM pages))"""


def _endpoints(spark, d):
    method = F.element_at(F.array(*map(F.lit, ("GET", "POST", "PUT", "DELETE"))), (c("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", method.alias("method"), T.normalized_path(F.regexp_extract("url", r"^.*?://[^/?#]*([^?#]*)", 1)).alias("path"))


@query(f"WITH {PAGES_SQL} SELECT page_id, method, path FROM pages2")
def normalize_path(spark, d):
    return _endpoints(spark, d)


@query(f"WITH {PAGES_SQL} SELECT page_id, method || ' ' || path || CASE WHEN count(*) OVER (PARTITION BY method, path) > 1 THEN ' @' || page_id ELSE '' END AS id FROM pages2")
def endpoint_unique_ids(spark, d):
    e = _endpoints(spark, d)
    held = e.groupBy("method", "path").agg(F.count(F.lit(1)).alias("held"))
    many = c("held") > 1
    return e.join(held, ["method", "path"]).select("page_id", F.concat("method", F.lit(" "), "path", F.when(many, F.concat(F.lit(" @"), c("page_id").cast("string"))).otherwise("")).alias("id"))


@query(f"WITH {PAGES_SQL} SELECT method, path, min(page_id) AS first FROM pages2 GROUP BY ALL")
def endpoint_dedup(spark, d):
    return best_per_key(_endpoints(spark, d).withColumn("first", c("page_id")), ["method", "path"], c("page_id")).select("method", "path", "first")


@query(f"WITH {PAGES_SQL} SELECT page_id, path FROM pages2 WHERE path LIKE '/en/%' AND path NOT LIKE '%.html'")
def endpoint_select(spark, d):
    return _endpoints(spark, d).where(T.glob(c("path"), "/en/*") & ~T.glob(c("path"), "*.html")).select("page_id", "path")


@query(f"""WITH {PAGES_SQL}, s AS (SELECT page_id, string_split(path[2:], '/') AS seg FROM pages2 WHERE path <> '/'), x AS (SELECT page_id, seg, unnest(range(1, len(seg) + 1)) AS k FROM s)
 SELECT '/' || array_to_string(seg[:k], '/') AS prefix, k::INT AS depth, count(*) AS n FROM x GROUP BY ALL""")
def endpoint_tree(spark, d):
    seg = _endpoints(spark, d).where("path != '/'").select(F.split(F.expr("substring(path, 2)"), "/").alias("seg"))
    each = seg.select(F.posexplode(F.transform("seg", lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice("seg", 1, i + 1), "/")))).alias("k", "prefix"))
    return each.groupBy("prefix", (c("k") + 1).alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugify(spark, d):
    return table(spark, d, "part").select("p_name", T.slug(c("p_name")).alias("slug")).distinct()


@query(r"SELECT DISTINCT p_type, lower(regexp_replace(p_type, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake, upper(regexp_replace(p_type, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS upper_snake FROM part")
def wire_naming(spark, d):
    return table(spark, d, "part").select("p_type", T.wire_name(c("p_type"), "SnakeCase").alias("snake"), T.wire_name(c("p_type"), "UpperSnakeCase").alias("upper_snake")).distinct()


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN true WHEN o_orderpriority LIKE '2%' THEN o_orderstatus = 'F' WHEN o_orderpriority LIKE '3%' AND o_orderstatus = 'F' THEN true
 WHEN o_orderpriority LIKE '3%' AND o_orderstatus = 'O' THEN false WHEN o_orderpriority LIKE '4%' THEN false WHEN o_custkey % 4 = 0 THEN false WHEN o_custkey % 4 = 1 THEN true END AS required FROM orders""")
def required_flag_3valued(spark, d):
    """Whether a member is required: by its annotations, of which the first that says something counts, else by its type."""
    p, status = c("o_orderpriority"), c("o_orderstatus")
    one = lambda name, *args: F.array(F.struct(F.lit("Size").alias("name"), F.create_map().cast("map<string,string>").alias("args")), F.struct(F.lit(name).alias("name"), (F.create_map(*args) if args else F.create_map()).cast("map<string,string>").alias("args")))
    mode = F.when(status == "F", "Schema.RequiredMode.REQUIRED").when(status == "O", "NOT_REQUIRED").otherwise("AUTO")
    annotations = (
        F.when(p.startswith("1"), one("NotBlank")).when(p.startswith("2"), one("JsonProperty", F.lit("required"), (status == "F").cast("string")))
        .when(p.startswith("3"), one("Schema", F.lit("requiredMode"), mode)).when(p.startswith("4"), one("Nullable")).otherwise(one("Max"))
    )
    kind = F.when(c("o_custkey") % 4 == 0, "java.util.Optional").when(c("o_custkey") % 4 <= 2, "int").otherwise("String")
    return table(spark, d, "orders").select("o_orderkey", V.required(annotations, kind, F.when(c("o_custkey") % 4 == 2, 1).otherwise(0)).alias("required"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_lenient(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("""WITH v AS (SELECT event_id, list_extract(['Boolean', 'Int', 'Double', 'String (Date)', 'Map<String, Int>', 'List<Int>', 'Other'], (event_id // 8 % 7 + 1)::INT) AS type,
  CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN '"1,' || event_id || '"' WHEN 3 THEN 'true' WHEN 4 THEN '"' || event_type || '"' WHEN 5 THEN value::VARCHAR WHEN 6 THEN '[' || event_id || ']' ELSE '""' END AS v FROM events),
 n AS (SELECT *, replace(trim(v, '"'), ',', '') AS num FROM v)
 SELECT event_id, type, CASE WHEN v = '""' THEN NULL WHEN type = 'Boolean' THEN CASE WHEN v = 'true' THEN v END WHEN type = 'Int' THEN CASE WHEN regexp_matches(num, '^[0-9]+$') THEN num::BIGINT::VARCHAR END
  WHEN type = 'Double' THEN CASE WHEN try_cast(num AS DOUBLE) = floor(try_cast(num AS DOUBLE)) THEN floor(num::DOUBLE)::BIGINT::VARCHAR ELSE try_cast(num AS DOUBLE)::VARCHAR END
  WHEN type LIKE 'String%' THEN CASE WHEN left(v, 1) NOT IN ('{', '[') THEN '"' || CASE WHEN v = 'true' THEN 'True' ELSE trim(v, '"') END || '"' END WHEN type LIKE 'Map%' THEN CASE WHEN v LIKE '{%' THEN v END
  WHEN type LIKE 'List%' THEN CASE WHEN v LIKE '[%' THEN v END ELSE v END AS example FROM n""")
def coerce_values(spark, d):
    """Given values as examples of the types of their members; what cannot be one is null."""
    k = c("event_id")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    forms = [c("props"), k.cast("string"), text('"1,', k, '"'), F.lit("true"), text('"', c("event_type"), '"'), c("value").cast("string"), text("[", k, "]"), F.lit('""')]
    given = reduce(lambda w, x: w.when(k % 8 == x[0], x[1]), enumerate(forms), F.when(F.lit(False), ""))
    types = F.array(*map(F.lit, ("Boolean", "Int", "Double", "String (Date)", "Map<String, Int>", "List<Int>", "Other")))
    rows = table(spark, d, "events").select("event_id", F.get(types, F.floor(k / 8) % 7).alias("type"), given.alias("v"))
    return rows.select("event_id", "type", V.coerced(c("v"), c("type"), F.lit(None).cast("array<string>")).alias("example"))


@query(r"SELECT doc_id, rule, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'Licensed under [^\n.]+')) AS rule FROM documents) GROUP BY ALL")
def business_rules_extract(spark, d):
    rules = F.explode(F.regexp_extract_all("text", F.lit(r"Licensed under [^\n.]+"), F.lit(0))).alias("rule")
    return table(spark, d, "documents").select("doc_id", rules).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT DISTINCT o_orderdate::DATE AS day, (o_orderdate::DATE - DATE '1921-03-21') + 365 * 1299 + (8 * 1300 + 21) // 33 AS n FROM orders),
 y AS (SELECT *, floor(n / 365.2422)::BIGINT + 1 AS g FROM a),
 z AS (SELECT *, CASE WHEN 365 * (g - 1) + (8 * g + 21) // 33 > n THEN g - 1 WHEN 365 * g + (8 * g + 29) // 33 <= n THEN g + 1 ELSE g END AS yr FROM y),
 w AS (SELECT *, n - 365 * (yr - 1) - (8 * yr + 21) // 33 AS k FROM z)
 SELECT day, printf('%04d-%02d-%02d', yr, CASE WHEN k < 186 THEN k // 31 + 1 ELSE (k - 186) // 30 + 7 END, CASE WHEN k < 186 THEN k % 31 ELSE (k - 186) % 30 END + 1) AS jalali FROM w""")
def jalali_dates(spark, d):
    day = c("o_orderdate").cast("date")
    return table(spark, d, "orders").select(day.alias("day")).distinct().select("day", T.jalali(c("day")).alias("jalali"))


@query("""WITH s AS (SELECT n_nationkey, n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)
 SELECT n_name, row_number() OVER (ORDER BY n_name)::INT AS number, (sum(n + 1) OVER (ORDER BY n_name ROWS UNBOUNDED PRECEDING))::BIGINT AS last_table FROM s""")
def table_numbering(spark, d):
    """Documents (nations) numbered in order, and a running count of their tables."""
    n = table(spark, d, "supplier").groupBy(c("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, d, "nation").join(n, c("n_nationkey") == c("k"), "left")
    return numbered(s.select("n_name", (F.coalesce("n", F.lit(0)) + 1).alias("tables")), ["n_name"], c("tables")).select("n_name", c("number").cast("int"), c("running").alias("last_table"))
