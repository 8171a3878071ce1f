"""Personal data, in DataFrame functions only: patterns propose, checksums confirm, context words adjust the score.

Base kinds (email, ip, card, phone) are found by their patterns and tests alone.  Further kinds need more than a pattern:

=======  ==========================================  ===========================================
kind     pattern                                     confirmed by
=======  ==========================================  ===========================================
iban     two capitals, two digits, 11 to 30 more,    mod 97 leaves 1, and no word against it
         together or in groups of four
ssn      ddd-dd-dddd                                 number ranges, and a context word
=======  ==========================================  ===========================================

The score of a span starts at its kind's prior, rises if a context word stands within ``window`` characters before it
and falls if a word of the opposite sense does; kinds beyond the base ones are kept from ``least`` on.

Defined results: a null text counts as empty, which holds nothing; repeated rows are judged alike; columns of the input
that bear the name of a new one give way to it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.spans import digits, in_blocks, kinds_in_order, luhn, mod97, once, pieces, run_start, sound, spans, stretch

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn")
LOCAL = "A-Za-z0-9._%+-"
PATTERN = {
    "email": rf"{run_start(LOCAL)}[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"{run_start('0-9')}[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",  # runs of fewer digits fail the test anyway
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.6, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank",
    "ssn": "ssn|social security",
}
AGAINST = "version|example|isbn|order|serial"


def _sound(kind: str, s: Column) -> Column:
    text = s["text"]
    if kind == "ip":
        return text.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind in ("card", "phone"):
        least, most = (14, 19) if kind == "card" else (10, 15)
        n = F.char_length(digits(text))
        return F.when((n < least) | (n > most), False).otherwise(luhn(digits(text)) if kind == "card" else F.lit(True))
    if kind == "iban":
        return mod97(F.translate(text, " ", "")) == 1
    if kind == "ssn":
        return ~text.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _likely(kind: str, text: Column) -> Column:
    return {
        "email": text.contains("@"),
        "phone": text.contains("+"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike("[0-9](?:[ -]?[0-9]){13}"),
        "iban": text.rlike("[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11}| [A-Z0-9]{4} )"),
        "ssn": text.rlike("-[0-9]{2}-"),
    }[kind]


def _scored(kind: str, text: Column, found: Column, window: int) -> Column:
    def score(parts: Column, s: Column) -> Column:
        near = F.lower(stretch(parts, F.greatest(s["start"] - window, F.lit(0)), s["start"]))
        up = F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), 0.35).otherwise(0.0)
        down = F.when(near.rlike(rf"\b(?:{AGAINST})\b"), 0.2).otherwise(0.0)
        return F.least(F.greatest(F.lit(PRIOR[kind]) + up - down, F.lit(0.0)), F.lit(1.0))

    scored = lambda parts, s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["text"].alias("text"), F.round(score(parts, s), 2).alias("score"))
    return once(pieces(text), lambda parts: F.transform(found, lambda s: scored(parts, s)))


def personal_data(docs: DataFrame, *, text: str = "text", prefix: str = "pii_", window: int = 40, least: float = 0.5) -> DataFrame:
    """``docs`` with ``<prefix>`` columns: one array per kind (start, stop, text, score), and base and spans.

    ``base`` has the base kinds' spans and ``spans`` all, as arrays of kind, start, stop, text, score in order of start.
    """
    p = lambda kind: f"{prefix}{kind}"
    body = p("body")
    df = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    t = F.col(body)
    df = df.withColumns({p(k): spans(t, PATTERN[k], _likely(k, t)) for k in (*BASE, *EXTRA)})
    df = df.withColumns({p(k): F.when(F.size(p(k)) > 0, _scored(k, t, sound(F.col(p(k)), partial(_sound, k)), window)).otherwise(no_spans_scored()) for k in (*BASE, *EXTRA)})
    df = df.withColumns({p(k): F.filter(p(k), lambda s: s["score"] >= least) for k in EXTRA})
    named = lambda kinds: kinds_in_order({k: F.col(p(k)) for k in kinds}, ("score",))
    return df.withColumns({p("base"): named(BASE), p("spans"): named((*BASE, *EXTRA))}).drop(body)


def no_spans_scored() -> Column:
    return F.array().cast("array<struct<start:int,stop:int,text:string,score:double>>")


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, one covers all.

    A span's own part of the result is what stands between the furthest end before it and its start, and its kind; the
    furthest ends are carried through blocks of spans, and the text is cut in pieces, so the work grows with the number
    of spans and the length of the text, not with their product.
    """
    t = F.coalesce(text, F.lit(""))
    part = "struct<a:int,b:int,kind:string>"

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.array(F.struct(acc["at"].alias("a"), s["start"].alias("b"), s["kind"].alias("kind")))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    def block(at: Column, spans: Column) -> Column:
        return F.aggregate(spans, F.struct(at.alias("at"), F.array().cast(f"array<{part}>").alias("out")), step)

    def written(parts: Column, r: Column) -> Column:
        return F.array_join(F.transform(r["out"], lambda x: F.concat(stretch(parts, x["a"], x["b"]), F.lit("["), x["kind"], F.lit("]"))), "")

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def walked(parts: Column) -> Column:
        return F.aggregate(
            in_blocks(found),
            start,
            lambda acc, spans: once(block(acc["at"], spans), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(written(parts, r))).alias("out"))),
            lambda acc: F.concat(F.array_join(acc["out"], ""), stretch(parts, acc["at"], F.char_length(t))),
        )

    return F.when(F.size(found) > 0, once(pieces(t), walked)).otherwise(text)
