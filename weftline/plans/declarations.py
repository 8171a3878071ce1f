"""Queries over declarations of types that the supplied tables stand for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.operators.declarations import all_fields, first_edges, resolve_types, type_edges
from weftline.operators.tables import materialised, numbered, refreshed
from weftline.plans.catalog import PARTS_SQL, _part_tree
from weftline.plans.registry import query
from weftline.plans.resolutions import CLOSURE_SQL
from weftline.sources.tables import table

c = F.col
DECLARED_SQL = """t0 AS (SELECT p_partkey AS k, 'b' || (p_partkey % 7) || CASE WHEN p_partkey % 3 = 0 THEN '.x' ELSE '' END AS pkg, 'T' || p_size AS name FROM part),
 t1 AS (SELECT row_number() OVER (ORDER BY qname) AS i, * FROM (SELECT pkg, name, pkg || '.' || name AS qname FROM t0 QUALIFY row_number() OVER (PARTITION BY pkg || '.' || name ORDER BY k DESC) = 1)),
 n1 AS (SELECT i, pkg, 'N' || (s_suppkey % 4) AS name, qname || '.N' || (s_suppkey % 4) AS qname, qname AS outr, s_suppkey FROM supplier JOIN t1 ON i = s_suppkey + 1),
 types AS (SELECT i, pkg, name, qname, NULL::VARCHAR AS outr FROM t1 UNION ALL SELECT i, pkg, name, qname, outr FROM n1),
 sup AS (SELECT a.qname AS type, b.qname AS super FROM t1 a JOIN t1 b ON b.i = a.i + 7),
 imp AS (SELECT a.i, 1 AS seq, b.qname AS name, false AS wild FROM t1 a JOIN t1 b ON b.i = a.i * 2 UNION ALL SELECT i, 2, 'out.lib.T' || (i % 50 + 1), false FROM t1 WHERE i % 4 = 1
  UNION ALL SELECT a.i, 3, b.pkg, true FROM t1 a JOIN t1 b ON b.i = a.i + 5),
 refs AS (SELECT o_orderkey AS ref, qname AS owner, CASE o_orderkey % 8 WHEN 0 THEN 'T' || (o_orderkey % 53 + 1) WHEN 1 THEN 'N' || (o_orderkey % 5) WHEN 2 THEN 'T' || (o_orderkey % 53 + 1) || '.N' || (o_orderkey % 4)
   WHEN 3 THEN 'b' || (o_orderkey % 7) || '.T' || (o_orderkey % 53 + 1) WHEN 4 THEN 'String' WHEN 5 THEN 'int' WHEN 6 THEN 'x.T' || (o_orderkey % 53 + 1) ELSE 'K' END AS name FROM orders JOIN t1 ON i = o_custkey % 500 + 1
  UNION ALL SELECT -s_suppkey - 1, qname, 'N' || (s_suppkey % 3) FROM n1),
 asks AS (SELECT DISTINCT owner, split_part(refs.name, '.', 1) AS simple, types.i, types.pkg, types.name AS own, outr FROM refs JOIN types ON types.qname = owner),
 chain AS (SELECT qname AS owner, qname AS enc, 0 AS depth FROM types UNION ALL SELECT qname, outr, 1 FROM n1),
 cand AS (SELECT owner, simple, 1 AS stage, depth AS a, 0 AS b, 'project' AS kind, t.qname AS target FROM asks JOIN chain USING (owner) JOIN types t ON t.qname = enc || '.' || simple
  UNION ALL SELECT owner, simple, 1, depth, 1, 'project', t.qname FROM asks JOIN chain USING (owner) JOIN sup ON sup.type = enc JOIN types t ON t.qname = super || '.' || simple
  UNION ALL SELECT owner, simple, 1, depth, 9, 'project', enc FROM asks JOIN chain USING (owner) JOIN types e ON e.qname = enc AND e.name = simple
  UNION ALL SELECT owner, simple, 2, seq, 0, CASE WHEN t.qname IS NULL THEN 'external' ELSE 'project' END, t.qname FROM asks JOIN imp ON imp.i = asks.i AND NOT wild AND split_part(imp.name, '.', -1) = simple LEFT JOIN types t ON t.qname = imp.name
  UNION ALL SELECT owner, simple, 3, 0, 0, 'project', t.qname FROM asks JOIN types t ON t.qname = asks.pkg || '.' || simple
  UNION ALL SELECT owner, simple, 4, seq, 0, 'project', t.qname FROM asks JOIN imp ON imp.i = asks.i AND wild JOIN types t ON t.qname = imp.name || '.' || simple
  UNION ALL SELECT owner, simple, 5, 0, 0, 'builtin', NULL FROM asks WHERE simple = 'String'
  UNION ALL SELECT owner, simple, 6, x.a, 0, 'guessed', x.q FROM asks JOIN (SELECT name, 1 AS a, NULL AS p, min(qname) AS q FROM types GROUP BY name HAVING count(*) = 1
     UNION ALL SELECT name, 2, regexp_replace(qname, '\\.[^.]*$', ''), min(qname) FROM types GROUP BY ALL HAVING count(*) = 1
     UNION ALL SELECT name, 3, split_part(qname, '.', 1), min(qname) FROM types GROUP BY ALL HAVING count(*) = 1) x ON x.name = simple AND (x.a = 1 OR x.a = 2 AND x.p = asks.pkg OR x.a = 3 AND x.p = split_part(asks.pkg, '.', 1))),
 meant AS (SELECT owner, simple, kind, target FROM cand QUALIFY row_number() OVER (PARTITION BY owner, simple ORDER BY stage, a, b, target) = 1),
 looked AS (SELECT ref, r.owner, r.name, coalesce(kind, 'external') AS kind, target FROM refs r LEFT JOIN meant m ON m.owner = r.owner AND m.simple = split_part(r.name, '.', 1)),
 means AS (SELECT ref, name, CASE WHEN name = 'int' THEN 'builtin' WHEN name = 'K' THEN 'typevar' WHEN e.qname IS NOT NULL THEN 'project' WHEN NOT contains(l.name, '.') THEN kind
    WHEN kind IN ('project', 'guessed') THEN CASE WHEN n.qname IS NULL THEN 'external' ELSE 'project' END WHEN s.q IS NULL THEN 'external' ELSE 'project' END AS kind,
   CASE WHEN name IN ('int', 'K') THEN NULL WHEN e.qname IS NOT NULL THEN e.qname WHEN NOT contains(l.name, '.') THEN target WHEN kind IN ('project', 'guessed') THEN n.qname ELSE s.q END AS target
  FROM looked l LEFT JOIN (SELECT qname FROM types) e ON e.qname = l.name LEFT JOIN (SELECT qname FROM types) n ON n.qname = target || substring(l.name, length(split_part(l.name, '.', 1)) + 1)
  LEFT JOIN (SELECT DISTINCT l.name AS of_name, min(t.qname) AS q FROM (SELECT DISTINCT name FROM refs) l JOIN types t ON t.qname LIKE '%.' || l.name GROUP BY 1) s ON s.of_name = l.name)"""


def _declared(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Types, imports, supertypes, references and builtins, made of keys."""
    text = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    part = table(spark, d, "part")
    package = F.concat(text("b", c("p_partkey") % 7), F.when(c("p_partkey") % 3 == 0, ".x").otherwise(""))
    rows = part.select("p_partkey", package.alias("package"), text("T", c("p_size")).alias("name")).withColumn("qname", F.concat("package", F.lit("."), "name"))
    top = numbered(refreshed(rows, ["qname"], "p_partkey").select("qname", "package", "name"), ["qname"]).withColumnRenamed("number", "i")
    top = materialised(top)
    suppliers = table(spark, d, "supplier").select((c("s_suppkey") + 1).alias("i"), "s_suppkey")
    nested = suppliers.join(top.select("i", "package", c("qname").alias("outer")), "i").withColumn("name", text("N", c("s_suppkey") % 4)).withColumn("qname", F.concat("outer", F.lit("."), "name"))
    none = F.array().cast("array<string>").alias("params")
    file = c("i").cast("string").alias("file")
    types = top.select("qname", "name", "package", F.lit(None).cast("string").alias("outer"), file, none).unionByName(nested.select("qname", "name", "package", "outer", file, none))
    other = lambda by, *columns: top.select("i", c("qname").alias("of")).withColumn("j", by).join(top.select(c("i").alias("j"), *columns), "j")
    supers = other(c("i") + 7, c("qname").alias("super")).select(c("of").alias("type"), F.lit(0).alias("seq"), "super")
    imported = lambda df, seq, name, wild: df.select(file, F.lit(seq).alias("seq"), name.alias("name"), F.lit(False).alias("static"), F.lit(wild).alias("wildcard"))
    imports = [
        imported(other(c("i") * 2, c("qname").alias("to")), 1, c("to"), False),
        imported(top.where("i % 4 = 1"), 2, text("out.lib.T", c("i") % 50 + 1), False),
        imported(other(c("i") + 5, c("package").alias("to")), 3, c("to"), True),
    ]
    k = c("o_orderkey")
    t = text("T", k % 53 + 1)
    kinds = [t, text("N", k % 5), F.concat(t, F.lit(".N"), (k % 4).cast("string")), F.concat(text("b", k % 7), F.lit("."), t), F.lit("String"), F.lit("int"), F.concat(F.lit("x."), t), F.lit("K")]
    name = reduce(lambda w, x: w.when(k % 8 == x[0], x[1]), enumerate(kinds), F.when(F.lit(False), t))
    owners = top.select("i", c("qname").alias("owner"))
    refs = table(spark, d, "orders").withColumn("i", c("o_custkey") % 500 + 1).join(owners, "i").select(k.alias("ref"), "owner", name.alias("name"), F.array(F.lit("K")).alias("params"))
    refs = refs.unionByName(nested.select((-c("s_suppkey") - 1).alias("ref"), c("qname").alias("owner"), text("N", c("s_suppkey") % 3).alias("name"), F.array(F.lit("K")).alias("params")))
    builtins = spark.range(1).select(F.lit("String").alias("simple"))
    return types, reduce(DataFrame.unionByName, imports), supers, materialised(refs), builtins


@query(f"WITH {DECLARED_SQL} SELECT ref, kind, target FROM means")
def type_names(spark, d):
    """What each reference to a type means: nested types, imports, the package, wildcards, builtins, and guesses."""
    types, imports, supers, refs, builtins = _declared(spark, d)
    return resolve_types(refs, types, imports, supers, builtins)


@query(f"""WITH {DECLARED_SQL}, e AS (SELECT 'o' || (ref % 200) AS src, CASE WHEN kind = 'external' THEN 'ext:' || split_part(name, '.', -1) ELSE target END AS dst, 'returns' AS kind, ref AS seq, CASE WHEN kind = 'guessed' THEN true END AS guessed
  FROM means WHERE ref >= 0 AND kind IN ('project', 'guessed', 'external'))
 SELECT src, dst, kind, seq, guessed FROM e QUALIFY row_number() OVER (PARTITION BY src, dst, kind ORDER BY seq) = 1""")
def reference_edges(spark, d):
    """Edges of references to types, each once; of several the first says whether its target is a guess."""
    types, imports, supers, refs, builtins = _declared(spark, d)
    refs = refs.where("ref >= 0")
    uses = refs.select("ref", F.concat(F.lit("o"), (c("ref") % 200).cast("string")).alias("src"), F.lit("returns").alias("kind"), c("ref").alias("seq"), "name")
    return first_edges(type_edges(uses, resolve_types(refs, types, imports, supers, builtins)))


@query(f"""WITH RECURSIVE {PARTS_SQL}, {CLOSURE_SQL},
 f AS (SELECT src AS type, p_type AS name, dst AS owner, depth, p_size AS pos FROM up JOIN part ON p_partkey = dst WHERE p_size % 4 <> 0 AND (depth = 0 OR p_size % 3 <> 0)),
 n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY type, name ORDER BY depth, owner) = 1)
 SELECT type, row_number() OVER (PARTITION BY type ORDER BY depth DESC, owner DESC, pos, name)::INT AS number, name, owner FROM n""")
def fields_base_first(spark, d):
    """The fields of each part with those it inherits, the farthest ancestor's first; static ones and interfaces' left out."""
    part = table(spark, d, "part")
    fields = part.select(c("p_partkey").alias("owner"), c("p_size").alias("pos"), c("p_type").alias("name"), (c("p_size") % 4 == 0).alias("static"))
    kinds = part.select(c("p_partkey").alias("qname"), F.when(c("p_size") % 3 == 0, "interface").otherwise("class").alias("kind"))
    return all_fields(graph.closure(_part_tree(spark, d)), fields, kinds)
