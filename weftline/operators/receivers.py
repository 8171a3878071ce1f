"""What a call's receiver chain is, and which methods a call may run: folds of joins over declaration tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.tables import best_per_key, materialised, products, spread_join


def visible_fields(ancestors: DataFrame, fields: DataFrame) -> DataFrame:
    """``type, name, target``: each field that a type has or inherits, by the nearest owner.

    ``ancestors``: src, dst, depth (a type is its own at depth 0); ``fields``: owner, name, target (null: a type that is
    not in the tables).
    """
    held = ancestors.select(F.col("src").alias("type"), F.col("dst").alias("owner"), "depth").join(fields, "owner")
    return best_per_key(held, ["type", "name"], F.struct("depth", "owner")).select("type", "name", "target")


def receiver_types(calls: DataFrame, scope: DataFrame, fields: DataFrame, constants: DataFrame, names: DataFrame, supers: DataFrame) -> DataFrame:
    """``call, receiver``: the type that each call's receiver chain leads to, null where it leads nowhere.

    ``calls``: call, type, method, chain (names, from the left).  ``scope``: method, name, rank (parameters before local
    names), target.  ``fields``: as ``visible_fields`` gives them.  ``constants``: owner, name.  ``names``: type, name,
    target, how a name of a type, qualified or not, reads inside a type.  ``supers``: type, seq, super.

    No chain, or ``this``, is the type itself and ``super`` its first supertype; a call on a call's result leads nowhere.
    Else the first name is a parameter, a local name, a field or, if it begins with a capital, a type; where it is none
    of them, the shortest longer prefix that names a type.  Whatever is found first counts, even if its type is unknown.
    Each further name is a field of the type before it, or a constant of it, which keeps the type: one join a step.
    """
    rows = calls.select("call", "type", "method", F.coalesce("chain", F.array().cast("array<string>")).alias("chain"))
    first = F.get("chain", F.lit(0))
    rows = materialised(rows.withColumn("chain", F.when(first == "this", F.slice("chain", 2, F.size("chain"))).otherwise(F.col("chain"))))
    itself = rows.where(F.size("chain") == 0).select("call", F.col("type").alias("receiver"))
    top = best_per_key(supers, ["type"], F.struct("seq", "super")).select("type", F.col("super").alias("receiver"))
    above = rows.where(first == "super").join(top, "type", "left").select("call", "receiver")
    open_ = rows.where((F.size("chain") > 0) & ~first.isin("super", "()")).withColumn("head", first)
    answer = lambda df, rank: df.select("call", rank.alias("rank"), "used", "target")
    once = F.lit(1).alias("used")
    said = lambda df: df.withColumnRenamed("name", "head")
    # only the first of a name's meanings can count: calls never meet all that a scope or a type has
    scope = best_per_key(scope.select("method", "name", "rank", "target"), ["method", "name"], F.struct("rank", "target"))
    names = best_per_key(names.where("target IS NOT NULL").select("type", "name", "target"), ["type", "name"], F.col("target"))
    found = [
        answer(open_.join(said(scope.select("method", "name", F.col("rank").alias("of"), "target")), ["method", "head"]).withColumn("used", once), F.struct(F.lit(0).alias("stage"), F.col("of").cast("long").alias("in"))),
        answer(open_.join(said(fields.select("type", "name", "target")), ["type", "head"]).withColumn("used", once), F.struct(F.lit(1).alias("stage"), F.lit(0).cast("long").alias("in"))),
    ]
    capital = open_.where(F.left("head", F.lit(1)).rlike(r"^\p{Lu}"))
    prefixes = capital.select("call", "type", F.posexplode(F.transform("chain", lambda x, i: F.array_join(F.slice("chain", 1, i + 1), "."))).alias("at", "name"))
    typed = prefixes.join(names, ["type", "name"]).withColumn("used", F.col("at") + 1)
    found.append(answer(typed, F.struct(F.lit(2).alias("stage"), F.col("used").cast("long").alias("in"))))
    heads = best_per_key(reduce(DataFrame.unionByName, found), ["call"], F.struct("rank", "target"))
    at = materialised(open_.select("call", "chain").join(heads.select("call", "used", F.col("target").alias("cur")), "call", "left"))
    done = []
    steps = fields.select(F.col("type").alias("cur"), F.col("name").alias("seg"), F.col("target").alias("to"), F.lit(True).alias("is_field"))
    kept = constants.select(F.col("owner").alias("cur"), F.col("name").alias("seg"), F.lit(True).alias("is_constant")).distinct()
    while True:
        ended = F.col("cur").isNull() | (F.col("used") >= F.size("chain"))
        done.append(at.where(ended).select("call", F.col("cur").alias("receiver")))
        going = at.where(~ended).withColumn("seg", F.get("chain", F.col("used")))
        if going.isEmpty():
            break
        step = going.join(steps, ["cur", "seg"], "left").join(kept, ["cur", "seg"], "left")
        to = F.when(F.col("is_field"), F.col("to")).when(F.col("is_constant"), F.col("cur"))
        at = materialised(step.select("call", "chain", (F.col("used") + 1).alias("used"), to.alias("cur")))
    answers = reduce(DataFrame.unionByName, [itself, above, *done])
    return calls.select("call").join(answers, "call", "left")


def first_methods(asked: DataFrame, ancestors: DataFrame, methods: DataFrame) -> DataFrame:
    """``type, name, argc, owner, signature, has_body, depth``: the method that a name and a number of arguments mean on a
    type: of those that fit, the nearest owner's first.

    ``methods``: owner, name, signature, params, varargs, has_body, seq.
    """
    up = ancestors.select(F.col("src").alias("type"), F.col("dst").alias("owner"), "depth")
    n, argc = F.col("params"), F.col("argc")
    fits = (n == argc) | (F.col("varargs") & (argc >= n - 1))
    # written tables are small on disk, so their sizes say little: merged, not broadcast
    held = asked.select("type", "name", "argc").distinct().join(up.hint("merge"), "type").join(methods.hint("merge"), ["owner", "name"]).where(fits)
    return best_per_key(held, ["type", "name", "argc"], F.struct("depth", "owner", "seq")).select("type", "name", "argc", "owner", "signature", "has_body", "depth")


def call_targets(calls: DataFrame, ancestors: DataFrame, methods: DataFrame, imports: DataFrame) -> DataFrame:
    """``call, target, impl``: the methods (owner#signature) that a call may run.

    ``calls``: call, type, receiver, own (no receiver or ``this``), name, argc.  ``imports`` (static): type, seq, owner,
    member (null: all).  The first method of the receiver is a target; where it has no body, so are the bodies that types
    below its owner declare themselves (``impl``).  Where the receiver has none, those of the types below it are.  An
    own call that finds nothing is looked up in the static imports, in their order.

    Calls are resolved by signature, each once.  Targets below a type are kept once for the type, name and number of
    arguments, as a set that all calls which lead there share: the body or method that each type below declares itself is
    looked up, not what each inherits, as that is declared below as well, or met by a type of several supertypes (for
    which it is looked up).  Calls and sets meet in the last step (``products``), which nothing is written or shuffled
    after; a signature that very many calls have is dealt out with salts.
    """
    keys = ["type", "name", "argc"]
    rows = calls.select("call", "own", F.when(F.col("own"), F.col("type")).otherwise(F.col("receiver")).alias("type"), "name", "argc")
    asked = materialised(rows.select("own", *keys).where("type IS NOT NULL").distinct())
    found = materialised(first_methods(asked, ancestors, methods))
    target = F.concat(F.col("owner").cast("string"), F.lit("#"), F.col("signature"))
    missing = materialised(asked.join(found.select(*keys).hint("merge"), keys, "left_anti"))

    # bodies: of what stands below the owner of a method without a body; else of what stands below a type that has none
    tops = found.where("NOT has_body").select(F.col("owner").alias("top"), "name", "argc", F.lit(True).alias("bodies"))
    tops = tops.union(missing.where("NOT own").select(F.col("type").alias("top"), "name", "argc", F.lit(False).alias("bodies"))).distinct()
    tops = materialised(tops.withColumn("set", F.monotonically_increasing_id()))
    below = ancestors.where("depth > 0").select(F.col("dst").alias("top"), F.col("src").alias("owner"))
    below = spread_join(below, tops.select("top").distinct(), "top")  # a root has very many below it
    declared = methods.groupBy("owner", "name").agg(F.array_sort(F.collect_list(F.struct("seq", "signature", "params", "varargs", "has_body"))).alias("overloads"))
    fits = lambda m: (m["params"] == F.col("argc")) | (m["varargs"] & (F.col("argc") >= m["params"] - 1))
    members = below.join(declared.hint("merge"), "owner").join(tops.hint("merge"), ["top", "name"])
    members = members.withColumn("first", F.get(F.filter("overloads", fits), F.lit(0))).where("first IS NOT NULL AND (NOT bodies OR first.has_body)")
    members = members.select("set", "owner", "first.signature").select("set", target.alias("target"))

    several = ancestors.where("depth = 1").groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mixed = materialised(ancestors.join(several.hint("merge"), "dst", "left_semi").select(F.col("src").alias("under")).distinct())
    if not mixed.isEmpty():  # they may inherit from types that are not below
        under = ancestors.where("depth > 0").select(F.col("dst").alias("type"), F.col("src").alias("under")).join(mixed.hint("merge"), "under", "left_semi")
        lower = materialised(missing.where("NOT own").join(under.hint("merge"), "type").select(*keys, "under"))
        theirs = first_methods(lower.select(F.col("under").alias("type"), "name", "argc"), ancestors, methods).withColumnRenamed("type", "under")
        lower = lower.join(theirs.hint("merge"), ["under", "name", "argc"]).withColumnRenamed("type", "top")
        members = members.union(lower.join(tops.where("NOT bodies"), ["top", "name", "argc"]).select("set", target.alias("target")))
    members = materialised(members.distinct())
    tops = tops.join(members.select("set").distinct().hint("merge"), "set", "left_semi")

    static = missing.where("own").join(imports.withColumnRenamed("owner", "from_type").hint("merge"), "type").where("member IS NULL OR member = name")
    theirs = first_methods(static.select(F.col("from_type").alias("type"), "name", "argc"), ancestors, methods)
    static = static.join(theirs.select(F.col("type").alias("from_type"), "name", "argc", "owner", "signature").hint("merge"), ["from_type", "name", "argc"])
    static = best_per_key(static.select(*keys, "seq", "owner", "signature"), keys, F.struct("seq", "owner", "signature")).select(*keys, target.alias("target"))

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    theirs = tops.where("bodies").select(F.col("top").alias("owner"), "name", "argc", "set", F.lit(False).alias("has_body"))
    direct = found.join(theirs.hint("merge"), ["owner", "name", "argc", "has_body"], "left").select(*keys, target.alias("target"), "set")
    direct = asked.join(direct.hint("merge"), keys).select("own", *keys, "target", "set")
    lower = missing.where("NOT own").join(tops.where("NOT bodies").withColumnRenamed("top", "type").hint("merge"), keys).select("own", *keys, none("string", "target"), "set")
    static = static.select(F.lit(True).alias("own"), *keys, "target", none("long", "set"))
    each = reduce(DataFrame.unionByName, [direct, lower, static])
    named = lambda df: df.withColumn("__sig", F.struct("own", *keys)).drop("own", *keys)
    led = materialised(spread_join(named(rows), materialised(named(each)), "__sig").select("call", "target", "set"))
    first = led.where("target IS NOT NULL").select("call", "target", F.lit(False).alias("impl"))
    return first.unionByName(products(led.where("set IS NOT NULL"), members, "set", "call", "target").withColumn("impl", F.lit(True)))
