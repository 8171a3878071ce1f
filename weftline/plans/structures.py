"""Queries over nested, generic and chained structures, on keys of the supplied tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import batches, constants, graph, inheritance, receivers
from weftline.operators.preorder import preorder
from weftline.plans.catalog import PARTS_SQL, _part_tree
from weftline.plans.registry import query
from weftline.plans.resolutions import CLOSURE_SQL
from weftline.sources.tables import node, table

c = F.col


@query("""WITH RECURSIVE e AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, n_nationkey::BIGINT AS seq FROM nation
 UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, s_suppkey FROM supplier
 UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, l_partkey FROM lineitem
 UNION ALL SELECT 'part:' || p_partkey, 'part:' || (p_partkey // 2), p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 0),
 r AS (SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS node, NULL::VARCHAR AS parent, []::BIGINT[] AS path FROM region
 UNION ALL SELECT r.root, e.dst, e.src, list_append(r.path, e.seq) FROM r JOIN e ON e.src = r.node)
 SELECT root, node, arg_min(parent, path) AS parent, row_number() OVER (PARTITION BY root ORDER BY min(path)) AS number FROM r GROUP BY root, node""")
def nested_order(spark, d):
    """What is nested in each region, in the order of a depth-first walk that enters every entity once."""
    t = lambda name: table(spark, d, name)
    row = lambda df, a, b, x, y, seq: df.select(node(a, c(x) if isinstance(x, str) else x).alias("src"), node(b, c(y) if isinstance(y, str) else y).alias("dst"), c(seq).cast("long").alias("seq"))
    edges = [
        row(t("nation"), "region", "nation", "n_regionkey", "n_nationkey", "n_nationkey"),
        row(t("supplier"), "nation", "supplier", "s_nationkey", "s_suppkey", "s_suppkey"),
        row(t("lineitem").select("l_suppkey", "l_partkey").distinct(), "supplier", "part", "l_suppkey", "l_partkey", "l_partkey"),
        row(t("part").where("p_partkey % 3 = 0 AND p_partkey > 0"), "part", "part", "p_partkey", F.expr("p_partkey div 2"), "p_partkey"),
    ]
    return preorder(reduce(DataFrame.unionByName, edges), t("region").select(node("region", c("r_regionkey")).alias("root")))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS t, p_size AS z, 'K' || p_partkey || '_' AS k, 'V' || p_partkey || '_' AS v FROM part),
 refs AS (SELECT t AS child, 1 AS seq, t // 10 AS parent, CASE WHEN z % 7 = 0 THEN []::VARCHAR[] WHEN z % 3 = 0 THEN [k, 'List<' || v || '>'] WHEN z % 3 = 1 THEN [v || '[]', 'Set<' || k || '>'] ELSE ['Brand', k || '[]'] END AS args FROM p WHERE t // 10 > 0
 UNION ALL SELECT t, 2, t // 4, ['List<' || k || '>'] FROM p WHERE z % 5 = 0 AND t // 4 > 0 AND t // 4 <> t // 10),
 r AS (SELECT child, parent AS top, [seq] AS path, len(args) AS n, args[1] AS k, args[2] AS v FROM refs
 UNION ALL SELECT r.child, e.parent, list_append(r.path, e.seq), len(e.args),
  replace(replace(e.args[1], 'K' || r.top || '_', coalesce(r.k, 'K' || r.top || '_')), 'V' || r.top || '_', coalesce(r.v, 'V' || r.top || '_')),
  replace(replace(e.args[2], 'K' || r.top || '_', coalesce(r.k, 'K' || r.top || '_')), 'V' || r.top || '_', coalesce(r.v, 'V' || r.top || '_')) FROM r JOIN refs e ON e.child = r.top)
 SELECT child, top AS ancestor, k, v FROM r WHERE n > 0 OR len(path) = 1 QUALIFY row_number() OVER (PARTITION BY child, top ORDER BY path) = 1""")
def generic_bindings(spark, d):
    """What the two variables of each part's ancestors stand for in the part's own terms; a part derives from one or two
    others, and some put nothing in."""
    p = table(spark, d, "part").select(c("p_partkey").alias("t"), c("p_size").alias("z"))
    name = lambda letter, key: F.concat(F.lit(letter), key.cast("string"), F.lit("_"))
    k, v = name("K", c("t")), name("V", c("t"))
    of = lambda kind, x: F.concat(F.lit(f"{kind}<"), x, F.lit(">"))
    dims = F.lit("[]")
    args = F.when(c("z") % 7 == 0, F.array().cast("array<string>")).when(c("z") % 3 == 0, F.array(k, of("List", v))).when(c("z") % 3 == 1, F.array(F.concat(v, dims), of("Set", k))).otherwise(F.array(F.lit("Brand"), F.concat(k, dims)))
    one = p.select(c("t").alias("child"), F.lit(1).alias("seq"), F.expr("t div 10").alias("parent"), args.alias("args")).where("parent > 0")
    two = p.where("z % 5 = 0 AND t div 4 != t div 10").select(c("t").alias("child"), F.lit(2).alias("seq"), F.expr("t div 4").alias("parent"), F.array(of("List", k)).alias("args")).where("parent > 0")
    found = inheritance.inherited_bindings(one.unionByName(two), p.select(c("t").alias("type"), F.array(k, v).alias("names")))
    bound = lambda letter: F.try_element_at("bindings", name(letter, c("ancestor")))
    return found.select("child", "ancestor", bound("K").alias("k"), bound("V").alias("v"))


@query("""WITH RECURSIVE n AS (SELECT n_nationkey AS k, r_name || '/' || n_name AS value FROM nation JOIN region ON r_regionkey = n_regionkey),
 cust AS (SELECT c_custkey AS k, c_mktsegment || '.' AS text, CASE WHEN c_custkey % 31 = 0 THEN 'self' WHEN c_custkey % 17 = 0 THEN 'none' WHEN c_custkey < 3 THEN 'nation' ELSE 'customer' END AS how, c_nationkey FROM customer),
 v AS (SELECT cust.k, cust.text || n.value AS value, 4 AS depth FROM cust JOIN n ON n.k = c_nationkey WHERE how = 'nation'
 UNION ALL SELECT cust.k, cust.text || v.value, v.depth + 2 FROM v JOIN cust ON how = 'customer' AND cust.k // 3 = v.k WHERE v.depth < 11)
 SELECT 'region:' || r_regionkey AS const, r_name AS value, 0 AS depth FROM region UNION ALL SELECT 'nation:' || k, value, 2 FROM n
 UNION ALL SELECT 'customer:' || cust.k, v.value, v.depth::INT FROM cust LEFT JOIN v USING (k)""")
def constant_values(spark, d):
    """Constants made of literals and of other constants, in waves; circles, unknown names and too deep ones are null."""
    lit = lambda key, pos, text: [key.alias("const"), F.lit(pos).alias("pos"), text.alias("literal"), F.lit(None).cast("string").alias("ref")]
    ref = lambda key, pos, to: [key.alias("const"), F.lit(pos).alias("pos"), F.lit(None).cast("string").alias("literal"), to.alias("ref")]
    r, n, k = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "customer")
    region, nation, customer = node("region", c("r_regionkey")), node("nation", c("n_nationkey")), node("customer", c("c_custkey"))
    to = F.when(c("c_custkey") % 31 == 0, customer).when(c("c_custkey") % 17 == 0, F.lit("nation:none")).when(c("c_custkey") < 3, node("nation", c("c_nationkey"))).otherwise(node("customer", F.expr("c_custkey div 3")))
    parts = [
        r.select(*lit(region, 0, c("r_name"))),
        n.select(*ref(nation, 0, node("region", c("n_regionkey")))), n.select(*lit(nation, 1, F.lit("/"))), n.select(*lit(nation, 2, c("n_name"))),
        k.select(*lit(customer, 0, c("c_mktsegment"))), k.select(*lit(customer, 1, F.lit("."))), k.select(*ref(customer, 2, to)),
    ]
    return constants.expanded(reduce(DataFrame.unionByName, parts))


@query("""WITH p AS (SELECT min(p_partkey) AS const, p_brand AS owner, p_type AS name FROM part GROUP BY ALL),
 t AS (SELECT p_partkey AS k, p_type FROM part),
 refs AS (SELECT o_orderkey AS ref, 'Brand#' || (o_custkey % 25 + 1) AS owner, o_custkey % 25 + 1 AS b, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 29 + 1 END AS q, p_type AS member FROM orders JOIN t ON t.k = o_orderkey % 97),
 a AS (SELECT ref, 1 AS stage, 0 AS seq, const FROM refs JOIN p ON q IS NULL AND p.owner = refs.owner AND p.name = member
 UNION ALL SELECT ref, 2, 1, const FROM refs JOIN p ON q IS NULL AND p.owner = 'Brand#' || (b % 25 + 1) AND p.name = member AND member = 'ECONOMY'
 UNION ALL SELECT ref, 2, 2, const FROM refs JOIN p ON q IS NULL AND p.owner = 'Brand#' || (b * 3 % 25 + 1) AND p.name = member
 UNION ALL SELECT ref, 3, 0, const FROM refs JOIN p ON p.owner = 'Brand#' || q AND q <= 25 AND p.name = member)
 SELECT refs.ref, x.const FROM refs LEFT JOIN (SELECT ref, const FROM a QUALIFY row_number() OVER (PARTITION BY ref ORDER BY stage, seq, const) = 1) x USING (ref)""")
def constant_names(spark, d):
    """The constant that a name means: the owner's own, else the first static import that has it; a qualified one by type."""
    part = table(spark, d, "part")
    consts = part.groupBy(c("p_brand").alias("owner"), c("p_type").alias("name")).agg(F.min("p_partkey").alias("const"))
    brand = lambda x: F.concat(F.lit("Brand#"), x.cast("string"))
    member = part.select(c("p_partkey").alias("k"), c("p_type").alias("member"))
    o = table(spark, d, "orders").select("o_orderkey", (c("o_custkey") % 25 + 1).alias("b"), (c("o_orderkey") % 97).alias("k")).join(member, "k")
    q = F.when(c("o_orderkey") % 3 != 0, F.concat(F.lit("B"), (c("o_orderkey") % 29 + 1).cast("string"), F.lit(".")))
    refs = o.select(c("o_orderkey").alias("ref"), brand(c("b")).alias("owner"), F.concat(F.coalesce(q, F.lit("")), "member").alias("name"))
    b = spark.range(1, 26).withColumnRenamed("id", "b")  # the owners' numbers
    imports = b.select(brand(c("b")).alias("owner"), F.lit(1).alias("seq"), brand(c("b") % 25 + 1).alias("from_type"), F.lit("ECONOMY").alias("member"))
    imports = imports.unionByName(b.select(brand(c("b")).alias("owner"), F.lit(2).alias("seq"), brand(c("b") * 3 % 25 + 1).alias("from_type"), F.lit(None).cast("string").alias("member")))
    types = b.select(brand(c("b")).alias("owner")).crossJoin(F.broadcast(b.select(F.concat(F.lit("B"), c("b").cast("string")).alias("name"), brand(c("b")).alias("type"))))  # 25 by 25
    return constants.constant_refs(refs, consts, imports, types)


CALLS_SQL = """calls AS (SELECT o_orderkey AS call, o_custkey AS type, 'm' || (o_orderkey % 10) AS method, CASE o_orderkey % 7 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['f1', 'f2']
  WHEN 2 THEN ['p1', 'f' || (o_orderkey % 5)] WHEN 3 THEN ['f' || (o_orderkey % 5), 'C1', 'f0'] WHEN 4 THEN ['T' || (o_orderkey % 3), 'C' || (o_orderkey % 4), 'f3'] WHEN 5 THEN ['U', 'f1', 'f2'] ELSE ['super', 'x'] END AS chain FROM orders)"""


@query(f"""WITH RECURSIVE {PARTS_SQL}, {CLOSURE_SQL}, {CALLS_SQL},
 vis AS (SELECT src AS type, 'f' || (p_size % 5) AS name, CASE WHEN p_size % 11 <> 0 THEN p_partkey * 3 // 2 END AS target FROM up JOIN part ON p_partkey = dst WHERE p_size % 2 = 0 QUALIFY row_number() OVER (PARTITION BY src, p_size % 5 ORDER BY depth, dst) = 1),
 kon AS (SELECT p_partkey AS owner, 'C' || (p_size % 4) AS name FROM part WHERE p_size % 3 = 0),
 sco AS (SELECT 'm' || (s_suppkey % 10) AS method, 'p' || (s_suppkey % 4) AS name, s_suppkey AS rank, CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey * 2 END AS target FROM supplier),
 nam AS (SELECT p_partkey AS type, 'T' || (p_size % 3) AS name, p_partkey // 2 AS target FROM part UNION ALL SELECT p_partkey, 'U.f1', p_partkey // 3 FROM part WHERE p_size % 4 = 0),
 cand AS (SELECT call, 0 AS stage, rank, 1 AS used, target FROM calls JOIN sco ON sco.method = calls.method AND sco.name = chain[1]
 UNION ALL SELECT call, 1, 0, 1, target FROM calls JOIN vis ON vis.type = calls.type AND vis.name = chain[1]
 UNION ALL SELECT call, 2, 1, 1, target FROM calls JOIN nam ON nam.type = calls.type AND nam.name = chain[1] WHERE chain[1] SIMILAR TO '[A-Z].*'
 UNION ALL SELECT call, 2, 2, 2, target FROM calls JOIN nam ON nam.type = calls.type AND nam.name = chain[1] || '.' || chain[2] WHERE chain[1] SIMILAR TO '[A-Z].*'),
 head AS (SELECT call, used, target FROM cand QUALIFY row_number() OVER (PARTITION BY call ORDER BY stage, rank, target NULLS FIRST) = 1),
 f AS (SELECT call, chain, used, target AS cur FROM calls JOIN head USING (call) WHERE len(chain) > 0 AND chain[1] <> 'super'
 UNION ALL SELECT f.call, f.chain, f.used + 1, CASE WHEN vis.type IS NOT NULL THEN vis.target WHEN kon.owner IS NOT NULL THEN f.cur END FROM f LEFT JOIN vis ON vis.type = f.cur AND vis.name = f.chain[f.used + 1]
  LEFT JOIN kon ON kon.owner = f.cur AND kon.name = f.chain[f.used + 1] WHERE f.used < len(f.chain) AND f.cur IS NOT NULL),
 done AS (SELECT call, cur FROM f WHERE used = len(chain) OR cur IS NULL)
 SELECT calls.call, CASE WHEN len(chain) = 0 THEN type WHEN chain[1] = 'super' THEN edges.dst ELSE cur END AS receiver FROM calls LEFT JOIN done USING (call) LEFT JOIN edges ON edges.src = type""")
def call_receivers(spark, d):
    """The part that each order's chain of names leads to: names in scope, fields through ancestors, types, then steps."""
    part = table(spark, d, "part")
    k = c("o_orderkey")
    numbered_name = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    chains = [F.array().cast("array<string>"), F.array(F.lit("this"), F.lit("f1"), F.lit("f2")), F.array(F.lit("p1"), numbered_name("f", k % 5)), F.array(numbered_name("f", k % 5), F.lit("C1"), F.lit("f0"))]
    chains += [F.array(numbered_name("T", k % 3), numbered_name("C", k % 4), F.lit("f3")), F.array(F.lit("U"), F.lit("f1"), F.lit("f2")), F.array(F.lit("super"), F.lit("x"))]
    chain = reduce(lambda w, x: w.when(k % 7 == x[0], x[1]), enumerate(chains), F.when(F.lit(False), chains[0]))
    calls = table(spark, d, "orders").select(k.alias("call"), c("o_custkey").alias("type"), numbered_name("m", k % 10).alias("method"), chain.alias("chain"))
    tree = _part_tree(spark, d)
    own = part.where("p_size % 2 = 0").select(c("p_partkey").alias("owner"), numbered_name("f", c("p_size") % 5).alias("name"), F.when(c("p_size") % 11 != 0, F.expr("p_partkey * 3 div 2")).alias("target"))
    fields = receivers.visible_fields(graph.closure(tree), own)
    kept = part.where("p_size % 3 = 0").select(c("p_partkey").alias("owner"), numbered_name("C", c("p_size") % 4).alias("name"))
    scope = table(spark, d, "supplier").select(numbered_name("m", c("s_suppkey") % 10).alias("method"), numbered_name("p", c("s_suppkey") % 4).alias("name"), c("s_suppkey").alias("rank"), F.when(c("s_suppkey") % 13 != 0, c("s_suppkey") * 2).alias("target"))
    names = part.select(c("p_partkey").alias("type"), numbered_name("T", c("p_size") % 3).alias("name"), F.expr("p_partkey div 2").alias("target"))
    names = names.unionByName(part.where("p_size % 4 = 0").select(c("p_partkey").alias("type"), F.lit("U.f1").alias("name"), F.expr("p_partkey div 3").alias("target")))
    supers = tree.select(c("src").alias("type"), F.lit(1).alias("seq"), c("dst").alias("super"))
    return receivers.receiver_types(calls, scope, fields, kept, names, supers)


@query(f"""WITH RECURSIVE {PARTS_SQL}, {CLOSURE_SQL},
 m AS (SELECT p_partkey AS owner, p_type AS name, p_partkey || '#' || p_type || '/' || (p_size % 4) AS target, p_size % 4 AS params, p_size % 3 = 0 AS varargs, p_size % 2 = 0 AS has_body FROM part),
 calls AS (SELECT o_orderkey AS call, o_orderkey % 4 = 0 AS own, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey WHEN o_orderkey % 10 <> 1 THEN o_orderkey % 197 END AS type, o_custkey, p_type AS name, o_orderkey % 5 AS argc FROM orders JOIN part ON p_partkey = o_orderkey % 97),
 sig AS (SELECT DISTINCT own, type, name, argc FROM calls WHERE type IS NOT NULL), argcs AS (SELECT unnest(range(5)) AS argc),
 fit AS (SELECT src AS type, m.name, argc, owner, target, has_body, depth FROM up JOIN m ON owner = dst JOIN argcs ON argc = params OR (varargs AND argc >= params - 1)),
 first AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY type, name, argc ORDER BY depth, owner) = 1),
 imp AS (SELECT c_custkey AS type, 1 AS seq, c_custkey // 3 AS owner FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 2, c_custkey // 7 FROM customer),
 hit AS (SELECT own, type, name, argc, target, false AS impl FROM sig JOIN first USING (type, name, argc)
 UNION ALL SELECT own, sig.type, sig.name, sig.argc, b.target, true FROM sig JOIN first a USING (type, name, argc) JOIN up ON up.dst = a.owner AND up.depth > 0 JOIN first b ON b.type = up.src AND b.name = sig.name AND b.argc = sig.argc AND b.owner = up.src AND b.has_body WHERE NOT a.has_body
 UNION ALL SELECT own, sig.type, sig.name, sig.argc, b.target, true FROM sig ANTI JOIN first USING (type, name, argc) JOIN up ON up.dst = sig.type AND up.depth > 0 JOIN first b ON b.type = up.src AND b.name = sig.name AND b.argc = sig.argc WHERE NOT own
 UNION ALL SELECT own, type, name, argc, target, false FROM (SELECT own, sig.type, sig.name, sig.argc, b.target FROM sig ANTI JOIN first USING (type, name, argc) JOIN imp ON imp.type = sig.type JOIN first b ON b.type = imp.owner AND b.name = sig.name AND b.argc = sig.argc WHERE own
   QUALIFY row_number() OVER (PARTITION BY own, sig.type, sig.name, sig.argc ORDER BY imp.seq) = 1))
 SELECT DISTINCT call, target, impl FROM calls JOIN hit USING (own, type, name, argc)""")
def call_edges(spark, d):
    """The methods that each order's call may run: inherited, implemented below, or statically imported."""
    part = table(spark, d, "part")
    name = part.select(c("p_partkey").alias("k"), c("p_type").alias("name"))
    o = table(spark, d, "orders").withColumn("k", c("o_orderkey") % 97).join(name, "k")
    k = c("o_orderkey")
    calls = o.select(k.alias("call"), c("o_custkey").alias("type"), F.when(k % 10 != 1, k % 197).alias("receiver"), (k % 4 == 0).alias("own"), "name", (k % 5).cast("int").alias("argc"))
    signature = F.concat("p_type", F.lit("/"), (c("p_size") % 4).cast("string"))
    methods = part.select(c("p_partkey").alias("owner"), c("p_type").alias("name"), signature.alias("signature"), (c("p_size") % 4).alias("params"), (c("p_size") % 3 == 0).alias("varargs"), (c("p_size") % 2 == 0).alias("has_body"), F.lit(0).alias("seq"))
    customer = table(spark, d, "customer").select(c("c_custkey").alias("type"))
    none = F.lit(None).cast("string").alias("member")
    imports = customer.where("type % 2 = 0").select("type", F.lit(1).alias("seq"), F.expr("type div 3").alias("owner"), none).unionByName(customer.select("type", F.lit(2).alias("seq"), F.expr("type div 7").alias("owner"), none))
    return receivers.call_targets(calls, graph.closure(_part_tree(spark, d)), methods, imports)


@query("""WITH RECURSIVE t AS (SELECT source, doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE trunc(length(text) / 3.6)::BIGINT + 1 END AS tok, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
 r AS (SELECT source, doc_id, rn, tok AS acc, 1 AS batch FROM t WHERE rn = 1
 UNION ALL SELECT t.source, t.doc_id, t.rn, CASE WHEN r.acc + t.tok > 6000 THEN t.tok ELSE r.acc + t.tok END, CASE WHEN r.acc + t.tok > 6000 THEN r.batch + 1 ELSE r.batch END FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source AND t.rn = r.rn + 1)
 SELECT source, doc_id, batch::INT AS batch FROM r""")
def source_batches(spark, d):
    """The documents of each source, in order of their ids, in batches of at most 6000 tokens; sources may hold very many."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.coalesce(T.estimated_tokens(c("text")), F.lit(0)).alias("tok"))
    return batches.greedy(docs, "source", ["doc_id"], c("tok"), 6000).select("source", "doc_id", "batch")
