"""Quality rules: surface counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over ``buckets`` hashed word n-grams (one and two words) for each language: the raw corpus, from every
whole text, and the trusted target, from every document labelled good (their ids are broadcast up to a million and
shuffled above).  A document's score is the mean log-likelihood
ratio of its n-grams under its language's pair, so that a language with few documents is not held against another's.
Weights are whole micro-units, so sums do not depend on the order of rows.

A document is kept unless the surface rules fail or its score lies below its language's threshold.  Thresholds come from
labels, not from a guess: of the documents labelled good a fold is held out of the target (crc32 of the id, one in
four), and the threshold is the score that all but ``reject`` of them reach; where a language has fewer than
``least_held_out`` of them, the one of all languages' together.

The language is a column (``lang``); null and empty count as one language, and without such a column all documents
share one pair.  Sizes: ``buckets`` integers for each language are sent to all tasks.

Words are stretches without white space; ``n_repeat_words`` counts the words that lie in a window of three words which
the text holds at least twice.

Defined results: a null text has no words; texts without words fail the surface rules and score 0; without any labelled
good document (or corpus) all weights are 0, and without any held-out one there is no threshold: the score rejects
nothing; repeated rows are judged alike; columns of the input that bear the name of a new one give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import held_out, materialised, small

BLANKS = " \t\n\x0b\f\r"
MICRO = 1_000_000


def words(text: Column) -> Column:
    """The words of a text; none if it is null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), lambda w: w != "")


def _lines_twice(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return F.size(lines) - F.size(F.array_distinct(lines))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(hashes: Column) -> Column:
    """The hash of each window of three words."""
    last = F.size(hashes) - 3
    at = lambda i: F.get(hashes, i)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _covered(places: Column) -> Column:
    """How many words windows of three cover that start at these ascending places."""
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("p")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["p"])).alias("n"), x.alias("p")), lambda a: a["n"])


def surface(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add ``<prefix>`` columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and hashes (of the words).

    Windows that occur twice are found among the sorted hashes.  Few such windows: each place is looked up among them;
    many: hashes are sorted with their places.
    """
    p = lambda name: f"{prefix}{name}"
    t = F.coalesce(F.col(text), F.lit(""))
    solid = F.length(F.translate(t, BLANKS, ""))
    df = docs.withColumns(
        {
            p("hashes"): word_hashes(words(F.col(text))),
            p("word_chars"): solid.cast("long"),
            p("n_symbols"): (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            p("n_dup_lines"): F.when(F.instr(t, "\n") > 0, _lines_twice(F.col(text))).otherwise(0).cast("long"),
        }
    )
    df = df.withColumns({p("n_words"): F.size(p("hashes")).cast("long"), p("windows"): _windows(F.col(p("hashes")))})
    df = df.withColumn(p("sorted"), F.sort_array(p("windows")))
    df = df.withColumn(p("twice"), F.array_distinct(F.filter(p("sorted"), lambda x, i: x == F.get(p("sorted"), i + 1))))
    few = F.filter(F.transform(p("windows"), lambda h, i: F.when(F.array_contains(p("twice"), h), i)), lambda i: i.isNotNull())
    df = df.withColumn(p("placed"), F.when(F.size(p("twice")) > 24, F.sort_array(F.transform(p("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i, j: F.get(p("placed"), i)["h"] == F.get(p("placed"), j)["h"]
    many = F.sort_array(F.transform(F.filter(p("placed"), lambda x, i: F.coalesce(same(i, i + 1), F.lit(False)) | F.coalesce(same(i, i - 1), F.lit(False))), lambda x: x["i"]))
    places = F.when(F.size(p("twice")) == 0, F.array().cast("array<int>")).when(F.size(p("twice")) > 24, many).otherwise(few)
    return df.withColumn(p("n_repeat_words"), _covered(places).cast("long")).drop(p("windows"), p("sorted"), p("twice"), p("placed"))


def _pair(hashes: Column, i: Column) -> Column:
    return F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """The buckets of all words and word pairs."""
    pairs = F.when(F.size(hashes) > 1, F.transform(F.sequence(F.lit(0), F.size(hashes) - 2), lambda i: _bucket(_pair(hashes, i), buckets)))
    return F.concat(F.transform(hashes, lambda h: _bucket(h, buckets)), F.coalesce(pairs, F.array().cast("array<int>")))


def _language(docs: DataFrame, lang: str | None) -> Column:
    return F.coalesce(F.col(lang), F.lit("")) if lang in docs.columns else F.lit("")


def _good(labels: DataFrame, label_id: str, quality: str, held: bool) -> DataFrame:
    """Ids of all documents labelled good, of the held-out fold or of the rest."""
    good = labels.where((F.col(quality) == 1) & F.col(label_id).isNotNull() & (held_out(F.col(label_id)) == F.lit(held)))
    return small(materialised(good.select(F.col(label_id).alias("good")).distinct()))


def bucket_weights(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", label_id: str = "doc_id", quality: str = "quality", buckets: int = 1 << 14) -> DataFrame:
    """One row: ``weights``, by language the log-likelihood ratio of target to raw corpus by bucket, in micro-units."""
    good = _good(labels, label_id, quality, False)
    body = docs.select(F.col(doc_id).alias("id"), _language(docs, lang).alias("lang"), F.col(text).alias("body"))
    marked = body.join(good, F.col("id") == F.col("good"), "left")
    hashed = marked.select("lang", F.col("good").isNotNull().alias("target"), word_hashes(words(F.col("body"))).alias("hashes"))
    grams = hashed.select("lang", "target", F.explode(ngram_buckets(F.col("hashes"), buckets)).alias("bucket"))
    counted = materialised(grams.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("target").alias("target")))
    every = counted.select("lang").distinct().select("lang", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")).join(counted, ["lang", "bucket"], "left")
    every = every.select("lang", "bucket", (F.coalesce("raw", F.lit(0)) + 1).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    total = every.groupBy("lang").agg(F.collect_list(F.struct("bucket", "raw", "target")).alias("c"), F.sum("raw").alias("raws"), F.sum("target").alias("targets"))

    def ratio(x: Column) -> Column:
        """The target starts as the raw corpus, with the weight of ``buckets`` n-grams: few labels say little."""
        p = x["raw"] / F.col("raws")
        return F.log((x["target"] + p * buckets) / (F.col("targets") + buckets)) - F.log(p)

    each = total.select("lang", F.transform(F.sort_array("c"), lambda x: F.round(ratio(x) * MICRO).cast("int")).alias("weights"))
    return each.agg(F.map_from_entries(F.collect_list(F.struct("lang", "weights"))).alias("weights"))


def _score(hashes: Column, weights: Column, buckets: int) -> Column:
    """The mean ratio; ``weights`` may be null, for a language that the corpus has not."""
    # an array of one, so that the language is looked up once and not for each n-gram
    total = F.get(F.transform(F.array(weights), lambda w: F.aggregate(ngram_buckets(hashes, buckets), F.lit(0).cast("long"), lambda a, b: a + F.get(w, b))), 0)
    return F.coalesce(total, F.lit(0)) / F.greatest(2 * F.size(hashes) - 1, F.lit(1)) / MICRO


def thresholds(docs: DataFrame, labels: DataFrame, weights: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", label_id: str = "doc_id", quality: str = "quality", buckets: int = 1 << 14, reject: float = 0.01, least_held_out: int = 50) -> DataFrame:
    """One row: ``by_lang`` (language to threshold) and ``pooled``, from held-out documents labelled good."""
    good = _good(labels, label_id, quality, True)
    body = docs.select(F.col(doc_id).alias("id"), _language(docs, lang).alias("lang"), F.col(text).alias("body"))
    sample = body.join(good, F.col("id") == F.col("good"), "left_semi").select("lang", word_hashes(words(F.col("body"))).alias("hashes"))
    sample = sample.withColumn("w", F.try_element_at(weights.scalar(), F.col("lang")))
    # short texts count for nothing; a filter on their size would be pushed below the join, and hash all documents
    scored = sample.select("lang", F.when(F.size("hashes") >= 50, _score(F.col("hashes"), F.col("w"), buckets)).alias("score"))
    each = scored.groupBy("lang").agg(F.percentile("score", reject).alias("least"), F.count("score").alias("n"))
    by_lang = F.map_from_entries(F.collect_list(F.when(F.col("n") >= least_held_out, F.struct("lang", "least"))))
    pooled = scored.agg(F.percentile("score", reject).alias("pooled"))
    return each.agg(by_lang.alias("by_lang")).select(F.struct("by_lang", pooled.scalar().alias("pooled")).alias("least"))


def judged(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", reject: float = 0.01, buckets: int = 1 << 14, prefix: str = "q_") -> DataFrame:
    """``docs`` with ``<prefix>`` columns: the surface counts, base_failed, score (mean ratio), threshold and kept.

    To filter by them use an exploded flag or a written table, as corpus_pipeline does: a filter would be pushed below the
    steps that make them and repeat these.
    """
    p = lambda name: f"{prefix}{name}"
    columns = {"doc_id": doc_id, "text": text, "lang": lang, "buckets": buckets}
    weights = materialised(bucket_weights(docs, labels, **columns))
    least = materialised(thresholds(docs, labels, weights, reject=reject, **columns)).scalar()
    df = docs.withColumn(p("of_lang"), _language(docs, lang))
    df = surface(df, text, prefix).withColumns({p("weights"): F.try_element_at(weights.scalar(), F.col(p("of_lang"))), p("threshold"): F.coalesce(F.try_element_at(least["by_lang"], F.col(p("of_lang"))), least["pooled"])})
    failed = (F.col(p("n_words")) < 50) | (100 * F.col(p("n_repeat_words")) > 50 * F.col(p("n_words")))
    df = df.withColumns({p("base_failed"): failed, p("score"): _score(F.col(p("hashes")), F.col(p("weights")), buckets)})
    kept = ~F.col(p("base_failed")) & F.coalesce(F.col(p("score")) >= F.col(p("threshold")), F.lit(True))
    return df.withColumn(p("kept"), kept).drop(p("hashes"), p("weights"), p("of_lang"))
