"""Declaration tables to a graph: names of types resolved in their contexts, symbols and edges, inherited fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import closure
from weftline.operators.tables import best_per_key, materialised

#: Names that never mean a type of the tables.
PRIMITIVES = ("boolean", "byte", "char", "short", "int", "long", "float", "double", "void")


def enclosing(types: DataFrame) -> DataFrame:
    """``owner, enc, depth``: each type and those around it, itself at depth 0."""
    nested = closure(types.where("outer IS NOT NULL").select(F.col("qname").alias("src"), F.col("outer").alias("dst")))
    around = nested.where("depth > 0").select(F.col("src").alias("owner"), F.col("dst").alias("enc"), "depth")
    return types.select(F.col("qname").alias("owner"), F.col("qname").alias("enc"), F.lit(0).alias("depth")).unionByName(around)


def _simple_names(asks: DataFrame, types: DataFrame, imports: DataFrame, supers: DataFrame, around: DataFrame, builtins: DataFrame) -> DataFrame:
    """``owner, simple, kind, target``: what names without dots mean.

    Candidates of all stages are joined in and the least rank is taken: types nested in those around the owner (innermost
    first, each before its supertypes' and before its own name), explicit imports (one of a type outside of the tables
    ends the search), the package, wildcard imports, builtins, and last the only type of that name: in all tables, in the
    package, or under the package's first part.
    """
    known = types.select(F.col("qname").alias("target"))
    home = types.select(F.col("qname").alias("owner"), "package", "file")
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, stage: int, first, second, kind="project") -> DataFrame:
        rank = F.struct(F.lit(stage).alias("stage"), first.cast("int").alias("first"), second.cast("int").alias("second"))
        return df.select("owner", "simple", rank.alias("rank"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), "target")

    zero, many = F.lit(0), F.lit(1 << 30)
    in_chain = asks.join(around, "owner")
    dotted = lambda a, b: F.concat(F.col(a), F.lit("."), F.col(b))
    found = [rows(in_chain.withColumn("target", dotted("enc", "simple")).join(known, "target"), 1, F.col("depth"), zero)]
    above = in_chain.join(supers.select(F.col("type").alias("enc"), "seq", "super"), "enc")
    found.append(rows(above.withColumn("target", dotted("super", "simple")).join(known, "target"), 1, F.col("depth"), F.col("seq") + 1))
    own = types.select(F.col("qname").alias("enc"), F.col("name").alias("simple"))
    found.append(rows(in_chain.join(own, ["enc", "simple"]).withColumn("target", F.col("enc")), 1, F.col("depth"), many))
    at_home = materialised(asks.join(home, "owner"))
    plain = imports.where("NOT static")
    explicit = plain.where("NOT wildcard").select("file", "seq", F.col("name").alias("import"), F.substring_index("name", ".", -1).alias("simple"))
    taken = at_home.join(explicit, ["file", "simple"]).join(known, F.col("import") == F.col("target"), "left").join(builtins.select("simple", F.lit(True).alias("builtin")), "simple", "left")
    kind = F.when(F.col("target").isNotNull(), "project").when(F.col("builtin"), "builtin").otherwise("external")
    found.append(rows(taken, 2, F.col("seq"), zero, kind))
    in_package = F.when(F.col("package") != "", dotted("package", "simple")).otherwise(F.col("simple"))
    found.append(rows(at_home.withColumn("target", in_package).join(known, "target"), 3, zero, zero))
    wild = at_home.join(plain.where("wildcard").select("file", "seq", F.col("name").alias("import")), "file")
    found.append(rows(wild.withColumn("target", dotted("import", "simple")).join(known, "target"), 4, F.col("seq"), zero))
    found.append(rows(at_home.join(builtins.select("simple"), "simple").withColumn("target", none), 5, zero, zero, "builtin"))

    named = types.select(F.col("name").alias("simple"), F.col("qname").alias("target"))
    prefix = F.when(F.contains("target", F.lit(".")), F.expr("left(target, length(target) - length(substring_index(target, '.', -1)) - 1)")).otherwise(F.col("target"))
    root = F.when(F.contains("target", F.lit(".")), F.substring_index("target", ".", 1))
    only = lambda: F.when(F.count(F.lit(1)) == 1, F.min("target"))
    anywhere = named.groupBy("simple").agg(only().alias("one"))
    packaged = named.groupBy("simple", prefix.alias("package")).agg(only().alias("two"))
    rooted = named.groupBy("simple", root.alias("root")).agg(only().alias("three")).where("root IS NOT NULL")
    guess = at_home.join(anywhere, "simple").join(packaged, ["simple", "package"], "left").withColumn("root", F.substring_index("package", ".", 1)).join(rooted, ["simple", "root"], "left")
    guess = guess.withColumn("target", F.coalesce("one", "two", "three")).where("target IS NOT NULL")
    found.append(rows(guess, 6, zero, zero, "guessed"))
    best = best_per_key(reduce(DataFrame.unionByName, found), ["owner", "simple"], F.struct("rank", "target"))
    return asks.join(best, ["owner", "simple"], "left").select("owner", "simple", F.coalesce("kind", F.lit("external")).alias("kind"), "target")


def resolve_types(refs: DataFrame, types: DataFrame, imports: DataFrame, supers: DataFrame, builtins: DataFrame) -> DataFrame:
    """``ref, kind, target``: what each reference to a type means where it stands.

    ``refs``: ref, owner (the type inside which it stands), name, params (type variables of its method, or null).
    ``types``: qname, name, package, outer, file, params.  ``imports``: file, seq, name, static, wildcard.  ``supers``:
    type, seq, super.  ``builtins``: simple.

    Kinds: builtin, typevar, project, guessed (by its name alone) and external; the target is null but for project and
    guessed.  A qualified name is a type by that name, else a type nested in what its first part means, else (where that
    means no type of the tables) one whose qualified name ends in it.  Names are resolved once for each owner.
    """
    around = materialised(enclosing(types))
    held = around.join(types.select(F.col("qname").alias("enc"), F.explode("params").alias("param")), "enc").groupBy("owner").agg(F.collect_set("param").alias("held"))
    none = F.array().cast("array<string>")
    asked = refs.join(held, "owner", "left").withColumn("vars", F.concat(F.coalesce("held", none), F.coalesce("params", none)))
    name = F.coalesce("name", F.lit(""))
    early = F.when(name.isin("", "?", *PRIMITIVES), "builtin").when(F.array_contains("vars", name), "typevar")
    exact = types.select(F.col("qname").alias("name"), F.lit(True).alias("exact"))
    head = F.substring_index("name", ".", 1)
    asked = asked.withColumn("early", early).join(exact, "name", "left").withColumn("simple", head).withColumn("var", F.array_contains("vars", head))
    asked = materialised(asked.select("ref", "owner", "name", "early", "exact", "simple", "var"))
    settled = asked.where("early IS NOT NULL OR exact").select("ref", F.coalesce("early", F.lit("project")).alias("kind"), F.when(F.col("early").isNull(), F.col("name")).alias("target"))
    open_ = asked.where("early IS NULL AND exact IS NULL")
    meant = materialised(_simple_names(open_.select("owner", "simple").distinct(), types, imports, supers, around, builtins))
    is_dotted = F.contains("name", F.lit("."))
    looked = materialised(open_.join(meant, ["owner", "simple"]))
    plain = looked.where(~is_dotted).select("ref", "kind", "target")
    ok = F.col("kind").isin("project", "guessed") & ~F.col("var")
    inner = looked.where(is_dotted & ok).withColumn("inner", F.concat("target", F.expr("substring(name, length(simple) + 1)")))
    inner = inner.select("ref", "inner").join(types.select(F.col("qname").alias("inner"), F.col("qname").alias("target")), "inner", "left")
    inner = inner.select("ref", F.when(F.col("target").isNotNull(), "project").otherwise("external").alias("kind"), "target")
    ends = looked.where(is_dotted & ~ok).select("ref", "name", F.substring_index("name", ".", -1).alias("last"))
    suffix = ends.join(types.select(F.col("name").alias("last"), "qname"), "last").where(F.col("qname").endswith(F.concat(F.lit("."), "name")))
    suffix = ends.join(suffix.groupBy("ref").agg(F.min("qname").alias("target")), "ref", "left")
    suffix = suffix.select("ref", F.when(F.col("target").isNotNull(), "project").otherwise("external").alias("kind"), "target")
    return reduce(DataFrame.unionByName, [settled, plain, inner, suffix])


def external(name: Column) -> Column:
    """The node of a name outside of the tables."""
    return F.concat(F.lit("ext:"), F.substring_index(name, ".", -1))


def type_edges(uses: DataFrame, resolved: DataFrame) -> DataFrame:
    """``src, dst, kind, seq, guessed``: edges of what refers to types.

    ``uses``: ref, src, kind, seq, name; ``resolved``: as ``resolve_types`` gives it.  Names outside of the tables become
    ``ext:Name``; builtins and type variables make no edge.
    """
    rows = uses.join(resolved.withColumnRenamed("kind", "means"), "ref").where(F.col("means").isin("project", "guessed", "external"))
    dst = F.when(F.col("means") == "external", external(F.col("name"))).otherwise(F.col("target"))
    return rows.select("src", dst.alias("dst"), "kind", "seq", F.when(F.col("means") == "guessed", True).alias("guessed"))


def first_edges(edges: DataFrame) -> DataFrame:
    """Each (src, dst, kind) once; what is said of the first by seq counts."""
    return best_per_key(edges, ["src", "dst", "kind"], F.struct("seq", *(c for c in edges.columns if c not in ("src", "dst", "kind", "seq"))))


def all_fields(ancestors: DataFrame, fields: DataFrame, types: DataFrame) -> DataFrame:
    """``type, number, name, owner``: the fields of a type with those it inherits, those of the farthest ancestor first.

    ``fields``: owner, pos, name, static; ``types``: qname, kind.  A nearer field hides one of its name; static fields
    and those of interfaces above are left out.
    """
    held = ancestors.select(F.col("src").alias("type"), F.col("dst").alias("owner"), "depth")
    shown = held.join(types.select(F.col("qname").alias("owner"), "kind"), "owner").where("depth = 0 OR kind != 'interface'")
    rows = shown.join(fields.where("NOT static"), "owner")
    nearest = best_per_key(rows.select("type", "name", "owner", "depth", "pos"), ["type", "name"], F.struct("depth", "owner", "pos"))
    order = Window.partitionBy("type").orderBy(F.desc("depth"), F.desc("owner"), "pos", "name")
    return nearest.select("type", F.row_number().over(order).alias("number"), "name", "owner")
