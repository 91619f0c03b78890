"""Personal data by patterns, checksums and context, in DataFrame functions only.

Regular expressions propose spans; validators confirm them (Luhn for cards,
mod-97 for IBANs, ranges for addresses and numbers); words that begin within 48
code points before a span, or lie within 48 after it, raise its score. Kinds whose pattern and checks suffice (``base``) are kept at
any score, the others from ``THRESHOLD`` up.

Positions: a pattern's matches are put between two marker characters and the
text is split at them, so the lengths of the parts give every start and end in
code points. Runs of candidate characters are taken possessively and, where a
run was tried from its start already, not again from its middle; both leave
the matches as they are and keep the scan linear. Sums of lengths are taken in
blocks, and surroundings from the ends of the parts nearby, so texts with very
many matches stay cheap.

Scale: narrow, row by row in the JVM; no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, read_table

OPEN, CLOSE = "", ""
BLOCK = 256
THRESHOLD = 0.5
CONTEXT_CHARS = 48
CONTEXT_SCORE = 0.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    def places(r):
        return F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.when(
            i % 2 == 1, F.substr(r, i, F.lit(1)).cast("int")).otherwise(
            F.substr(F.lit("0246813579"), F.substr(r, i, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int")))
    return let(F.reverse(digits), lambda r: F.aggregate(places(r), F.lit(0), lambda a, x: a + x) % 10 == 0)


def mod97(iban: Column) -> Column:
    """True if an IBAN (spaces left out) has remainder 1."""
    moved = let(F.regexp_replace(iban, " ", ""), lambda s: F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, ch: F.when(
        F.ascii(ch) >= 65, (a * 100 + F.ascii(ch) - 55) % 97).when(
        F.ascii(ch) >= 48, (a * 10 + F.ascii(ch) - 48) % 97).otherwise(a)) == 1


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    quick: Callable[[Column], Column]   # cheap test that a text may have a match
    valid: Callable[[Column], Column]
    score: float
    context: str                        # words that raise the score
    base: bool = False


# Characters of an IBAN by country: the registry, then countries that use IBANs without being in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
OTHER_LENGTHS = {25: "AO CV GW MZ", 26: "DZ IR", 27: "CF CG CM GA GQ KM MG TD", 28: "BF BJ CI MA ML NE SN TG"}


def _iban() -> str:
    """An IBAN as long as its country's are, so that what follows is not taken with it; spaces may part its characters."""
    of = [f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])"
          for lengths in (IBAN_LENGTHS, OTHER_LENGTHS) for n, codes in lengths.items()]
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(of)})"


def _any_digit(c: Column) -> Column:
    return c.rlike("[0-9]")


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda c: F.contains(c, F.lit("@")), lambda m: F.lit(True), 0.9, "mail|contact|write|reply", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _any_digit,
         lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"),
         0.6, "ip|address|host|server|from", True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", _any_digit,
         lambda m: let(digits_of(m), lambda d: F.when(_between(F.length(d), 12, 19), luhn(d)).otherwise(F.lit(False))),
         0.8, "card|visa|credit|debit|payment", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda c: F.contains(c, F.lit("+")),
         lambda m: _between(F.length(digits_of(m)), 9, 15), 0.7, "phone|tel|call|mobile|fax", True),
    Kind("iban", _iban(), _any_digit,
         mod97, 0.8, "iban|account|bank|transfer"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _any_digit,
         lambda m: m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
         0.3, "ssn|social security|national id"),
    Kind("local_phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", _any_digit,
         lambda m: F.lit(True), 0.3, "phone|tel|call|mobile|fax"),
)
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double,base:boolean>>"


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def _offsets(lengths: Column) -> Column:
    """Sums of the blocks of lengths before each block."""
    blocks = F.floor(F.size(lengths) / BLOCK).cast("int")
    totals = F.transform(F.sequence(F.lit(0), blocks), lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    return let(totals, lambda t: F.transform(F.sequence(F.lit(0), blocks), lambda b: _sum(F.slice(t, F.lit(1), b))))


def _near(left: Column, right: Column, i: Column, context: str) -> Column:
    """True if a word begins up to CONTEXT_CHARS before part i, or lies as close after it.

    ``left`` and ``right`` are the first and last CONTEXT_CHARS + 1 of each part. Every other part is a match and not
    empty, so twice as many parts reach as far. One more code point before tells whether a word begins there; a digit
    stands for the span.
    """
    n = CONTEXT_CHARS + 1
    first = F.greatest(i - 2 * n, F.lit(0))
    before = F.right(F.concat(F.lit(" "), F.array_join(F.slice(right, first + 1, i - first), "")), F.lit(n))
    after = F.left(F.array_join(F.slice(left, i + 2, F.lit(2 * n)), ""), F.lit(CONTEXT_CHARS))
    return F.lower(F.concat(before, F.lit("0"), after)).rlike(rf"(?s)(?<=.)\b(?:{context})")


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    marked = F.regexp_replace(text, f"({kind.pattern})", f"{OPEN}$1{CLOSE}")
    parts = F.when(kind.quick(text), F.split(marked, f"[{OPEN}{CLOSE}]")).otherwise(F.array(F.lit("")))

    def of(p, lengths, before, left, right):
        def span(i):
            block = F.floor(i / BLOCK).cast("int")
            start = F.get(before, block) + _sum(F.slice(lengths, block * BLOCK + 1, i % BLOCK))
            near = _near(left, right, i, kind.context)
            score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0)))
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.get(lengths, i)).alias("end"),
                            F.lit(kind.name).alias("kind"), score.alias("score"), F.lit(kind.base).alias("base"))
        at = F.filter(F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)), lambda i: kind.valid(F.get(p, i)))
        return F.filter(F.transform(at, span), lambda s: s["base"] | (s["score"] >= THRESHOLD))

    return let(parts, lambda p: F.when(F.size(p) > 1, let(
        F.transform(p, lambda x: F.length(x).cast("long")), lambda n: let(_offsets(n), lambda b: let(
            F.transform(p, lambda x: F.left(x, F.lit(CONTEXT_CHARS + 1))), lambda left: let(
                F.transform(p, lambda x: F.right(x, F.lit(CONTEXT_CHARS + 1))), lambda right: of(p, n, b, left, right))))),
    ).otherwise(F.array().cast(SPAN)))


def find_personal_data(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                       name: str = "pii_spans") -> DataFrame:
    """The kept columns and the spans of each whole text, by start, then kind.

    A span has start and end (code points, end exclusive), rank (the kind's
    place in KINDS), kind, score and base. Null and empty texts have none; a
    kept column called like the result is replaced; repeated rows stay.
    Spans of different kinds may overlap.
    """
    keep = [c for c in keep if c.lower() != name.lower()]
    # The markers cannot be part of a match: another character that cannot stands for them.
    held = fresh(docs, "_text_")
    clean = docs.select(*[col(c) for c in keep], F.translate(F.coalesce(col(text_col).cast("string"), F.lit("")), OPEN + CLOSE, "##").alias(held))
    spans = F.concat(*[_spans(col(held), r, k) for r, k in enumerate(KINDS)])
    return clean.select(*[col(c) for c in keep], F.array_sort(spans).alias(name))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets.

    Overlapping spans are replaced as one, under the first one's kind; a null
    text stays null. All columns and rows are kept.
    """
    columns, spans = docs.columns, fresh(docs, "_spans_")
    found = find_personal_data(docs, text_col, tuple(columns), spans)
    # Spans that begin before an earlier one ends join it.
    joined = F.aggregate(col(spans), F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"), lambda a, s: F.when(
        (F.size(a) > 0) & (s["start"] < F.element_at(a, -1)["end"]), F.concat(
            F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(
                F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"),
                F.element_at(a, -1)["kind"].alias("kind"))))).otherwise(
        F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))))

    def written(j, text):
        def piece(i):
            start = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(j, i - 1)["end"])
            return F.concat(F.substr(text, (start + 1).cast("int"), (F.get(j, i)["start"] - start).cast("int")),
                            F.lit("["), F.upper(F.get(j, i)["kind"]), F.lit("]"))
        tail = F.substr(text, (F.element_at(j, -1)["end"] + 1).cast("int"))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(j) - 1), piece), ""), tail)

    text = F.when(F.size(col(spans)) == 0, col(text_col)).otherwise(let(joined, lambda j: written(j, col(text_col))))
    return found.select(*[text.alias(c) if c == text_col else col(c) for c in columns])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digest(found: DataFrame, name: str = "pii_spans") -> DataFrame:
    """Counts per base kind, base_sha256 and all spans as a string, beside the kept columns."""
    kept = [col(c) for c in found.columns if c != name]
    counts = [F.size(F.filter(name, _is(k.name))).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    return found.select(*kept, *counts, F.sha2(_listed(F.filter(name, lambda s: s["base"])), 256).alias("base_sha256"),
                        _listed(F.col(name)).alias("spans"))


def op10_pii(spark, sf_dir):
    return digest(find_personal_data(read_table(spark, sf_dir, "documents")))
