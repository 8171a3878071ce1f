"""Queries that resolve names and members."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.operators.resolution import chain, first_answers, inherited_methods, merged_rows, only_one, resolve
from weftline.operators.tables import best_per_key, listed
from weftline.plans.catalog import PARTS_SQL, _part_tree
from weftline.plans.registry import query
from weftline.sources.tables import node, table

c = F.col
CLOSURE_SQL = """r AS (SELECT src, src AS dst, 0 AS depth FROM edges UNION SELECT dst, dst, 0 FROM edges
 UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.dst), up AS (SELECT src, dst, min(depth) AS depth FROM r GROUP BY ALL)"""


@query("""WITH p AS (SELECT p_partkey AS ref, p_name, p_brand, p_type, p_size FROM part),
 imported AS (SELECT a.ref, 1 AS stage, b.ref AS target FROM p a LEFT JOIN p b ON b.ref = a.ref * 2 AND b.p_size > 10 WHERE a.p_size <= 10),
 package AS (SELECT a.ref, 2 AS stage, min(b.ref) AS target FROM p a JOIN p b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type <> b.p_type GROUP BY a.ref),
 one AS (SELECT p_brand, p_type, min(ref) AS target FROM p GROUP BY ALL HAVING count(*) = 1),
 guess AS (SELECT ref, 3 AS stage, target FROM p JOIN one USING (p_brand, p_type)),
 u AS (SELECT * FROM imported UNION ALL SELECT * FROM package UNION ALL SELECT * FROM guess),
 best AS (SELECT ref, stage, target FROM u QUALIFY row_number() OVER (PARTITION BY ref ORDER BY stage, target NULLS LAST) = 1)
 SELECT p.ref, stage::INT AS stage, target FROM p LEFT JOIN best USING (ref)""")
def resolve_early_exit(spark, d):
    """Explicit imports, then the same package, then the only one of its name.  An import of what is not in the table
    (its target is null) ends the search as well."""
    p = table(spark, d, "part").select(c("p_partkey").alias("ref"), "p_name", "p_brand", "p_type", "p_size")
    inside = p.where("p_size > 10").select(c("ref").alias("target"))
    imported = p.where("p_size <= 10").select("ref", (c("ref") * 2).alias("to")).join(inside, c("to") == c("target"), "left").select("ref", "target")
    # the least key of each type of a package's name: at most one row for each type, not for each pair of parts
    least = p.groupBy("p_name", "p_brand", c("p_type").alias("of_type")).agg(F.min("ref").alias("target"))
    package = p.join(least, ["p_name", "p_brand"]).where("p_type != of_type").groupBy("ref").agg(F.min("target").alias("target"))
    guess = p.join(only_one(p, ["p_brand", "p_type"], "ref"), ["p_brand", "p_type"]).select("ref", "target")
    return resolve(p, [imported, package, guess])


@query(f"""WITH RECURSIVE {PARTS_SQL}, {CLOSURE_SQL},
 calls AS (SELECT DISTINCT l_partkey AS type, p_type AS name, l_linenumber AS argc FROM lineitem JOIN part ON p_partkey = l_partkey)
 SELECT type, argc, dst AS owner, depth::INT AS depth FROM calls JOIN up ON up.src = type JOIN part ON p_partkey = dst AND p_type = name
 WHERE p_size % 6 = argc OR (p_size % 3 = 0 AND argc >= p_size % 6 - 1) QUALIFY row_number() OVER (PARTITION BY type, argc ORDER BY depth, dst) = 1""")
def find_method_arity(spark, d):
    """The nearest method by name and number of arguments on a part or what it derives from."""
    part = table(spark, d, "part")
    name = part.select(c("p_partkey").alias("type"), c("p_type").alias("name"))
    calls = table(spark, d, "lineitem").select(c("l_partkey").alias("type"), c("l_linenumber").alias("argc")).distinct().join(name, "type")
    methods = part.select(c("p_partkey").alias("owner"), c("p_type").alias("name"), (c("p_size") % 6).alias("params"), (c("p_size") % 3 == 0).alias("varargs"))
    found = inherited_methods(calls, graph.closure(_part_tree(spark, d)), methods)
    return best_per_key(found.select("type", "argc", "owner", "depth"), ["type", "argc"], F.struct("depth", "owner")).select("type", "argc", "owner", "depth")


@query(f"""WITH RECURSIVE {PARTS_SQL}, {CLOSURE_SQL}
 SELECT src, string_agg(dst::VARCHAR, '>' ORDER BY depth, dst) AS chain FROM up GROUP BY src""")
def resolve_context(spark, d):
    """The chain of what encloses each part, innermost first."""
    return chain(graph.closure(_part_tree(spark, d))).select("src", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


@query(f"""WITH RECURSIVE {PARTS_SQL}, {CLOSURE_SQL}
 SELECT src AS type, p_brand AS field, dst AS owner FROM up JOIN part ON p_partkey = dst WHERE p_size % 2 = 0 QUALIFY row_number() OVER (PARTITION BY src, p_brand ORDER BY depth, dst) = 1""")
def field_lookup(spark, d):
    """Each field (brand) that a part has or inherits from a part of even size, with its nearest owner."""
    fields = table(spark, d, "part").where("p_size % 2 = 0").select(c("p_partkey").alias("dst"), c("p_brand").alias("field"))
    found = graph.closure(_part_tree(spark, d)).join(fields, "dst").select(c("src").alias("type"), "field", c("dst").alias("owner"), "depth")
    return best_per_key(found, ["type", "field"], F.struct("depth", "owner")).select("type", "field", "owner")


@query("""WITH u AS (SELECT o_orderpriority AS code, 'ok' AS title, '' AS note, 0 AS source, 0 AS seq FROM orders WHERE o_orderpriority LIKE '3%' GROUP BY 1
 UNION ALL SELECT o_orderpriority, CASE WHEN max(o_totalprice) > 400000 THEN max(o_orderstatus) ELSE '' END, min(o_orderstatus), 1, min(o_orderkey) FROM orders WHERE o_totalprice > 300000 GROUP BY 1
 UNION ALL SELECT o_orderpriority, 'any', 'common', 2, min(o_orderkey) FROM orders GROUP BY 1)
 SELECT code, coalesce(min_by(title, (source, seq)) FILTER (title <> ''), '') AS title, coalesce(min_by(note, (source, seq)) FILTER (note <> ''), '') AS note, min(source)::INT AS source FROM u GROUP BY code""")
def error_rows_merge(spark, d):
    """Rows of a code from several sources as one: its place by the first source, each text the first that is not empty."""
    o = table(spark, d, "orders")
    by = lambda rows, title, note, seq: rows.groupBy(c("o_orderpriority").alias("code")).agg(title.alias("title"), note.alias("note"), seq.cast("long").alias("seq"))
    success = by(o.where(c("o_orderpriority").startswith("3")), F.lit("ok"), F.lit(""), F.min(F.lit(0)))
    title = F.when(F.max("o_totalprice") > 400_000, F.max("o_orderstatus")).otherwise("")
    override = by(o.where("o_totalprice > 300000"), title, F.min("o_orderstatus"), F.min("o_orderkey"))
    common = by(o, F.lit("any"), F.lit("common"), F.min("o_orderkey"))
    return merged_rows([success, override, common], "code", ["title", "note"]).select("code", "title", "note", "source")


@query("""WITH f AS (SELECT user_id, event_type, max_by(event_id, ts) AS by_owner FROM events GROUP BY ALL), g AS (SELECT event_type, min(event_id) AS by_name FROM events GROUP BY 1)
 SELECT c_custkey, g.event_type, coalesce(f.by_owner, g.by_name) AS entry, f.by_owner IS NOT NULL AS own FROM customer CROSS JOIN g LEFT JOIN f ON f.user_id = c_custkey AND f.event_type = g.event_type
 WHERE g.event_type = CASE WHEN c_custkey % 2 = 0 THEN 'view' ELSE 'click' END""")
def analysis_fallback(spark, d):
    """A row's analysis by its own key, else by the common one: two left joins, the first answer counts."""
    e = table(spark, d, "events")
    own = e.groupBy(c("user_id").alias("c_custkey"), "event_type").agg(F.max_by("event_id", "ts").alias("by_owner"))
    common = e.groupBy("event_type").agg(F.min("event_id").alias("by_name"))
    rows = table(spark, d, "customer").select("c_custkey", F.when(c("c_custkey") % 2 == 0, "view").otherwise("click").alias("event_type"))
    found = rows.join(own, ["c_custkey", "event_type"], "left").join(common, "event_type")
    return found.select("c_custkey", "event_type", F.coalesce("by_owner", "by_name").alias("entry"), c("by_owner").isNotNull().alias("own"))


@query("""WITH u AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)
 SELECT l_partkey AS part, count(*) AS n, (SELECT string_agg(x::VARCHAR, ',') FROM (SELECT unnest(list_sort(list(l_orderkey))[1:5]) AS x)) AS first FROM u GROUP BY l_partkey""")
def used_by(spark, d):
    """How many orders use each part, and the first five of them."""
    uses = table(spark, d, "lineitem").select(c("l_partkey").alias("part"), "l_orderkey").distinct()
    found = listed(uses, ["part"], "l_orderkey", ["l_orderkey"], 5)
    return found.select("part", "n", F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("first"))


@query("""WITH a AS (SELECT 'part:' || p_partkey || '.' || p_type AS key, p_name AS note FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_brand || '.' || p_type, CASE WHEN count(*) > 1 THEN min(p_name) ELSE '' END FROM part GROUP BY p_brand, p_type),
 r AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem), k AS (SELECT l_partkey, l_linenumber, 'part:' || l_partkey || '.' || p_type AS k1, p_brand || '.' || p_type AS k2 FROM r JOIN part ON p_partkey = l_partkey)
 SELECT l_partkey, l_linenumber, coalesce(nullif(x.note, ''), nullif(y.note, '')) AS note FROM k LEFT JOIN a x ON x.key = k1 LEFT JOIN a y ON y.key = k2""")
def parameter_notes(spark, d):
    """A note for each line's parameter: by the part and its field, else by the brand's field; empty notes do not count."""
    part = table(spark, d, "part")
    dotted = lambda a: F.concat(a, F.lit("."), "p_type")
    own = part.where("p_size % 3 = 0").select(dotted(node("part", c("p_partkey"))).alias("key"), c("p_name").alias("note"))
    brand = part.groupBy("p_brand", "p_type").agg(F.when(F.count(F.lit(1)) > 1, F.min("p_name")).otherwise("").alias("note")).select(dotted(c("p_brand")).alias("key"), "note")
    lines = table(spark, d, "lineitem").select("l_partkey", "l_linenumber").distinct().join(part.select(c("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    rows = lines.select("l_partkey", "l_linenumber", dotted(node("part", c("l_partkey"))).alias("k1"), dotted(c("p_brand")).alias("k2"))
    return first_answers(rows, own.unionByName(brand), ["k1", "k2"], "note").select("l_partkey", "l_linenumber", "note")


@query("""WITH changed AS (SELECT doc_id AS path FROM documents WHERE doc_id % 13 = 0), f AS (SELECT o_orderkey, o_custkey % 1000 AS path FROM orders)
 SELECT path, count(*) AS n, min(o_orderkey) AS first FROM f JOIN changed USING (path) GROUP BY path""")
def changed_symbols(spark, d):
    """The symbols (orders) whose file (a document) has changed, by file."""
    changed = table(spark, d, "documents").where("doc_id % 13 = 0").select(c("doc_id").alias("path"))
    held = table(spark, d, "orders").select("o_orderkey", (c("o_custkey") % 1000).alias("path"))
    return held.join(changed, "path", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
