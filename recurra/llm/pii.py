"""Personal data by native expressions: patterns propose spans, checksums confirm, nearby words adjust the score.

Offsets count code points from 0, ends are exclusive. Positions come from the gaps between the matches: `split` and
`regexp_extract_all` walk the same matches, so a span starts where the lengths of the gaps and matches before it end.
Sums over them run in chunks, and parts of a text are cut from its blocks of 4,096 characters, so that a text with very
many spans costs about as much a span as one with few.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    guard: str  # a cheap pattern that every text with a match holds
    pattern: str
    score: float  # without context words
    context: str  # words that raise the score if they stand shortly before
    base: bool = True
    needs_context: bool = False


# Kinds in their order and what they match. Possessive and look-behind forms find the same spans as the
# plain patterns, without retries inside long runs and without recursion on repeated groups.
KINDS = [
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|write|address|kontakt|correo|courriel"),
    Kind("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13}", r"[0-9](?:[\x20-]?[0-9])++", 0.7, r"card|visa|master|credit|pay|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, r"phone|call|tel|fax|mobile|cell"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", 0.8, r"iban|bank|konto|account|cuenta|compte", base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"ssn|social", base=False, needs_context=True),
]
CONTEXT = 48
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)

    def step(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number of capitals and digits has check digits that leave 1 modulo 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        d = _digits(found)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    if kind == "iban":
        return mod97(found)
    return F.lit(True)


_SPAN = "array<struct<start:int,kind:int,stop:int,score:double>>"
_CHUNK, _BLOCK = 64, 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column], deep: int = 2) -> Column:
    """The array of `op` over each value and all before it; op is associative and 0 leaves a value as it is.

    Chunk by chunk, since an array that grows by one element is copied each time.
    """
    zero = F.lit(0)

    def plain(part: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc, x):
            return _let(op(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out")))

        return F.aggregate(part, start, step, lambda acc: acc["out"])

    if not deep:
        return plain(values)

    def chunked(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / _CHUNK).cast("int"), zero)
        return F.transform(F.sequence(zero, last), lambda i: plain(F.slice(v, i * _CHUNK + 1, F.lit(_CHUNK))))

    def joined(parts: Column) -> Column:
        tops = running(F.transform(parts, lambda p: F.try_element_at(p, F.lit(-1))), op, deep - 1)
        before = _let(tops, lambda t: F.concat(F.array(zero), F.slice(t, F.lit(1), F.size(t) - 1)))
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p, lambda x: op(b, x))))

    return _let(values, lambda v: _let(chunked(v), joined))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), 0)


def _between(blocks: Column, start: Column, stop: Column) -> Column:
    """Characters [start, stop) of the text of these blocks."""
    first, last = F.floor(start / _BLOCK).cast("int"), F.floor((stop - 1) / _BLOCK).cast("int")

    def part(b):
        at = F.greatest(start - b * _BLOCK, F.lit(0))
        return F.substring(F.get(blocks, b), at + 1, F.least(stop - b * _BLOCK, F.lit(_BLOCK)) - at)

    return F.when(stop > start, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")


def _spans(text: Column, number: int, kind: Kind) -> Column:
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), 0)

    def placed(m):
        # Java's split drops an empty first gap only for empty matches, and these patterns match no empty string.
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: g + F.length(x))
        return F.zip_with(running(steps, lambda x, y: x + y), m, lambda e, x: F.struct((e - F.length(x)).alias("start"), x.alias("m")))

    kept = F.filter(_let(found, placed), lambda x: _valid(kind.name, x["m"]))

    def scored(x, blocks):
        near = F.lower(_between(blocks, F.greatest(x["start"] - CONTEXT, F.lit(0)), x["start"]))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(kind.context), 0.3).otherwise(0.0))
        return F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), (x["start"] + F.length(x["m"])).alias("stop"), score.alias("score"))

    none = F.array().cast(_SPAN)
    all_scored = _let(kept, lambda k: F.when(F.size(k) > 0, _let(_blocks(text), lambda b: F.transform(k, lambda x: scored(x, b)))).otherwise(none))
    if kind.needs_context:
        all_scored = F.filter(all_scored, lambda x: x["score"] > kind.score + 0.1)
    guard = F.contains(text, F.lit("@")) if kind.guard == "@" else text.rlike(kind.guard)
    return F.when(guard, all_scored).otherwise(none).cast(_SPAN)


def find(docs: DataFrame, keep: list[str], prefix: str = "__pii") -> DataFrame:
    """The columns `keep` of every row and `<prefix>`, its spans by start, then kind (null or empty text: none)."""
    text = f"{prefix}_text"
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias(text))
    each = [f"{prefix}_{k.name}" for k in KINDS]
    own = own.select("*", *[_spans(F.col(text), i, k).alias(c) for i, (k, c) in enumerate(zip(KINDS, each, strict=True))])
    return own.select(*[F.col(f"`{c}`") for c in keep], F.array_sort(F.concat(*each)).alias(prefix), F.col(text))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["stop"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, spans with scores, counts of the base kinds, the digest of the base spans, all spans as text."""
    base = [i for i, k in enumerate(KINDS) if k.base]
    s = F.col("__pii")

    def count(i: int) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i].name}")

    counts = [count(i) for i in base]
    return find(docs, ["doc_id"]).select(
        "doc_id",
        *counts,
        F.sha2(_joined(F.filter(s, lambda x: x["kind"] <= base[-1])), 256).alias("base_sha256"),
        _joined(s).alias("spans"),
        F.transform(s, lambda x: x["score"]).alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each span replaced by its kind in capitals, as <EMAIL>; n_chars, where there is one, follows.

    Overlapping spans give one placeholder, of the first. Rows without a span, null texts included, do not change.
    """
    found = find(docs, docs.columns)
    text = F.col("__pii_text")
    names = F.array(*[F.lit(f"<{k.name.upper()}>") for k in KINDS])
    spans = F.col("__pii")
    reached = running(F.transform(spans, lambda x: x["stop"]), F.greatest)

    def replaced(reach, blocks):
        before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))
        heads = F.zip_with(spans, before, lambda x, b: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), b.alias("after")))
        heads = F.filter(heads, lambda x: x["start"] >= x["after"])
        pieces = F.transform(heads, lambda x: F.concat(_between(blocks, x["after"], x["start"]), names[x["kind"]]))
        return F.concat(F.array_join(pieces, ""), _between(blocks, F.element_at(reach, -1), F.length(text)))

    done = _let(reached, lambda reach: _let(_blocks(text), lambda blocks: replaced(reach, blocks)))
    some = F.size("__pii") > 0
    found = found.withColumn("__pii_new", F.when(some, done))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.coalesce("__pii_new", F.col("text")).alias("text"))
        elif c == "n_chars":
            kind = docs.schema["n_chars"].dataType
            out.append(F.when(some, F.length("__pii_new").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars"))
        else:
            out.append(F.col(f"`{c}`"))
    return found.select(*out)
