"""Spans of pattern matches as DataFrame expressions: where the matches of a regular expression lie in a text.

Spark's functions return matches without their places.  What lies between matches and the matches themselves are both at
hand (``split`` and ``regexp_extract_all``), so places follow from adding up lengths, in code points.

The patterns for possibly long runs of characters use possessive repeats and start only where a run starts or the last
match ended (``\\G``): the same matches, in time proportional to the text and without deep recursion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,stop:int,text:string>"


def run_start(chars: str) -> str:
    """Matches where a run of ``chars`` (inside of a class) begins, or where the last match ended."""
    return rf"(?:\G|(?<![{chars}]))"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def spans(text: Column, pattern: str, likely: Column | None = None) -> Column:
    """``array<struct<start, stop, text>>`` of all matches; ``likely`` is a cheap test that may rule the text out.

    Neither ``text`` nor the pattern's matches may be null; ``text`` should be a plain column.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    # x: length of the gap before the match, and the match
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    nothing = no_spans()

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        stop = start + F.char_length(x["m"])
        return F.struct(stop.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("text")))).alias("out"))

    def block(at: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), nothing.alias("out")), step)

    walked = F.aggregate(
        in_blocks(pairs),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")),
        lambda a, part: once(block(a["at"], part), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out"))),
        lambda a: F.flatten(a["out"]),
    )
    test = text.rlike(pattern) if likely is None else likely & text.rlike(pattern)
    return F.when(test, walked).otherwise(nothing)


def in_blocks(items: Column, size: int = 256) -> Column:
    """An array in blocks: a fold that appends copies what it has so far, so it goes over blocks, each with its own fold."""
    last = F.floor((F.size(items) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(items, k * size + 1, size))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


#: Characters of a piece of a text.
PIECE = 1024


def pieces(text: Column) -> Column:
    """A text as an array of pieces of ``PIECE`` characters.  Cutting many stretches out of a long text scans it from its
    start for each; out of its pieces, each cut costs one piece more than its length."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def stretch(parts: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` to ``stop`` (exclusive) of the text that ``pieces`` has taken apart."""
    first = F.floor(start / PIECE).cast("int")
    n = F.floor((stop - 1) / PIECE).cast("int") - first + 1
    held = F.array_join(F.slice(parts, first + 1, n), "")
    return F.when(stop > start, F.substring(held, start - first * PIECE + 1, stop - start)).otherwise("")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.split(F.reverse(number), "")
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """The remainder by 97 of an account number: four characters moved to the end, letters as 10 to 35."""
    turned = F.concat(F.substring(code, 5, 1000), F.substring(code, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))


def sound(found: Column, test) -> Column:
    """The spans that pass ``test`` (a function of the span alone)."""
    return F.filter(found, lambda s: test(s))


def _ranked(found: Column, rank: int, kind: str, more: tuple[str, ...]) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["text"].alias("text"), *(s[m].alias(m) for m in more)))


def kinds_in_order(by_kind: dict[str, Column], more: tuple[str, ...] = ()) -> Column:
    """Spans of several kinds as one array of ``kind, start, stop, text`` and ``more``, by start, then as the kinds are listed."""
    return F.array_sort(F.concat(*(_ranked(v, k, n, more) for k, (n, v) in enumerate(by_kind.items()))))


def said(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
