"""Secret scans, in DataFrame functions only: patterns, and character Markov models of random strings and identifiers.

Base kinds (assign, access, hex) are found by pattern.  Any other token of ``least`` or more characters from letters,
digits and ``+/_=-`` that mixes letters with digits becomes a span of kind ``random`` if a first-order Markov model of
random strings explains its characters better than one of ordinary identifiers, by ``margin`` per step or more.

Both models are trained from labelled samples: random strings are the values that the ``assign`` and ``access`` patterns
find in at most ``sample_docs`` documents (those with the smallest hash of their id), identifiers are the words of the
same documents outside these values.  Counts are taken with Spark and turned into one table of whole micro-units.

Defined results: a null text counts as empty; with no samples of either kind no ``random`` span is found; repeated rows
are judged alike; columns of the input that bear the name of a new one (``secret_*``) give way to it, and ``secret_body``
and ``secret_weights`` are dropped.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.spans import kinds_in_order, no_spans, run_start, sound, spans

BASE = ("assign", "access", "hex")
VALUE = "A-Za-z0-9+/_.=-"
PATTERN = {
    "assign": rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[{VALUE}]++""",
    "access": "AKIA[A-Z0-9]++",
    "hex": rf"{run_start('0-9a-f')}[0-9a-f]{{16,}}+",
    "random": rf"{run_start('A-Za-z0-9+/_=-')}[A-Za-z0-9+/_=-]{{20,}}+",
}
GROUP_2 = rf"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([{VALUE}]++)$"""
#: Classes of characters: one for each of these, and one for all others.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
N = len(SYMBOLS) + 1
MICRO = 1_000_000


def base_spans(text: Column, kind: str) -> Column:
    likely = {"assign": text.rlike("(?i)(?:password|passwd|secret|token|api_?key)"), "access": text.contains("AKIA"), "hex": text.rlike("[0-9a-f]{16}")}[kind]
    return spans(text, PATTERN[kind], likely)


def value_of(assign: Column) -> Column:
    """The assigned value of an ``assign`` match."""
    return F.regexp_extract(assign, GROUP_2, 1)


def _sound(kind: str, s: Column) -> Column:
    if kind == "assign":
        return F.char_length(value_of(s["text"])) >= 12
    return F.char_length(s["text"]) >= (18 if kind == "access" else 16)


def _classes(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c))


def _steps(classes: Column) -> Column:
    """Pairs of neighbouring classes as one number each."""
    return F.zip_with(F.slice(classes, 1, F.greatest(F.size(classes) - 1, F.lit(0))), F.slice(classes, 2, F.greatest(F.size(classes) - 1, F.lit(0))), lambda a, b: a * N + b)


def markov_weights(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 5_000) -> DataFrame:
    """One row: ``weights``, by step the log-likelihood ratio of random strings to identifiers in micro-units."""
    sample = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    labelled = sample.where(F.col("body").rlike("(?i)(?:password|passwd|secret|token|api_?key)|AKIA"))
    chosen = labelled.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    sample = labelled.join(F.broadcast(chosen), "id", "left_semi")
    body = F.col("body")
    found = sample.select("body", base_spans(body, "assign").alias("assign"), base_spans(body, "access").alias("access"))
    values = F.concat(F.transform(F.filter("assign", lambda s: _sound("assign", s)), lambda s: value_of(s["text"])), F.transform(F.filter("access", lambda s: _sound("access", s)), lambda s: s["text"]))
    # labels: a value is random if it holds digits and letters; a word is an identifier if it holds no digit
    values = F.filter(values, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    words = F.filter(F.split("body", "[^A-Za-z0-9+/_=-]+"), lambda w: (F.char_length(w) >= 3) & ~w.rlike("[0-9]"))
    each = found.select(F.explode(F.concat(F.transform(values, lambda v: F.struct(F.lit(True).alias("random"), v.alias("token"))), F.transform(words, lambda w: F.struct(F.lit(False).alias("random"), w.alias("token"))))).alias("x")).select("x.*")
    classes = each.select("random", _classes(F.col("token")).alias("classes"))
    steps = classes.select("random", F.explode(_steps(F.col("classes"))).alias("step"))
    counted = steps.groupBy("step").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("i"))
    every = docs.sparkSession.range(N * N).select(F.col("id").cast("int").alias("step")).join(counted, "step", "left")
    every = every.select("step", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("i", F.lit(0)).alias("i"))
    row = every.agg(F.sort_array(F.collect_list(F.struct("step", "r", "i"))).alias("c"), F.sum("r").alias("rs"), F.sum("i").alias("is"))
    # the first class of a step stands for the state; its counts are the sums over its N steps
    total = lambda k, f: F.aggregate(F.slice("c", k * N + 1, N), F.lit(0).cast("long"), lambda a, x: a + x[f]).alias(f)
    state = F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda k: F.struct(total(k, "r"), total(k, "i")))
    before = lambda k, f: F.aggregate(F.sequence(F.lit(0), F.lit(N - 1)), F.lit(0).cast("long"), lambda a, j: a + F.get("c", j * N + k)[f]).alias(f)
    after = F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda k: F.struct(before(k, "r"), before(k, "i")))
    row = row.withColumns({"state": state, "after": after})

    def log_p(x: Column, f: str, all_steps: str) -> Column:
        """A step's probability after its first character, backed by the frequency of its second with a weight of N."""
        alone = (F.get("after", (x["step"] % N).cast("int"))[f] + 0.5) / (F.col(all_steps) + 0.5 * N)
        return F.log((x[f] + N * alone) / (F.get("state", F.floor(x["step"] / N).cast("int"))[f] + N))

    known = (F.col("rs") > 0) & (F.col("is") > 0)
    return row.select(F.transform("c", lambda x: F.when(known, F.round((log_p(x, "r", "rs") - log_p(x, "i", "is")) * MICRO)).otherwise(-MICRO).cast("int")).alias("weights"))


def secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", prefix: str = "secret_", least: int = 20, margin: float = 0.5, sample_docs: int = 5_000) -> DataFrame:
    """``docs`` with ``<prefix>`` columns: assign, access, hex, random (arrays of start, stop, text), base and spans."""
    p = lambda kind: f"{prefix}{kind}"
    weights = markov_weights(docs, doc_id=doc_id, text=text, sample_docs=sample_docs).scalar()
    df = docs.withColumns({p("body"): F.coalesce(F.col(text), F.lit("")), p("weights"): weights})
    t = F.col(p("body"))
    df = df.withColumns({p(k): base_spans(t, k) for k in BASE} | {p("random"): spans(t, PATTERN["random"], t.rlike(f"[A-Za-z0-9+/_=-]{{{least}}}"))})
    df = df.withColumns({p(k): sound(F.col(p(k)), partial(_sound, k)) for k in BASE})
    df = df.withColumn(p("base"), kinds_in_order({k: F.col(p(k)) for k in BASE}))
    mixed = F.filter(p("random"), lambda s: (F.char_length(s["text"]) >= least) & s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]"))
    free = F.filter(mixed, lambda s: ~F.exists(p("base"), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    ratio = lambda s: F.aggregate(_steps(_classes(s["text"])), F.lit(0).cast("long"), lambda a, x: a + F.get(p("weights"), x)) / (F.char_length(s["text"]) - 1)
    chosen = F.when(F.size(p("random")) > 0, F.filter(free, lambda s: ratio(s) >= margin * MICRO)).otherwise(no_spans())
    df = df.withColumn(p("random"), chosen)
    return df.withColumn(p("spans"), kinds_in_order({k: F.col(p(k)) for k in (*BASE, "random")})).drop(p("body"), p("weights"))
