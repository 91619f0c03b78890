"""HTML to text as column expressions.

Every rule is a chain of regexp and array functions: it runs in the JVM, with
no Python on the hot path (the functions over arrays are interpreted, not
compiled by whole-stage codegen). The patterns use no lookaround so they mean
the same in Java regex and RE2.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The paragraph split rule.
MARK = "\x1e"
NOISE_RE = r"(?is)<!--.*?(?:-->|\z)|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>"
P_START_RE = r"(?i)<p(\s[^>]*)?>"
# Start or end tags that end an open paragraph.
BLOCK_TAGS = ("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure "
              "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol pre section table tbody td tfoot th thead "
              "tr ul").split()
P_CUT_RE = r"(?is)</p\s*>.*$|</?(" + "|".join(BLOCK_TAGS) + r")[\s>/].*$"
TAG_RE = r"<[^>]*>"
TIME_RE = r"(?is)<time(?:\s[^>]*)?>(.*?)</time\s*>"
# Character references: every HTML5 name that ends with a semicolon (from the standard library's table).
NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
REFERENCE_RE = r"^(#[0-9]{1,10}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);"
# Numbers 128 to 159 mean the Windows characters of that byte, where there is one.
WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(d: dict) -> Column:
    """A constant map (one JSON literal, folded when the query is planned)."""
    return F.from_json(F.lit(json.dumps(d)), "map<string,string>")


def _character(n) -> Column:
    """The character of a code point; what is none is U+FFFD."""
    windows = F.try_element_at(_map({k: v for k, v in WINDOWS.items() if v}), n.cast("string"))
    bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    point = F.when(bad, F.lit(0xFFFD)).otherwise(n).cast("long")
    return F.when(n.between(128, 159), F.coalesce(windows, F.lit("\ufffd"))).otherwise(
        F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))


def _reference(name) -> Column:
    """What a character reference (without & and ;) stands for, NULL if nothing."""
    number = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 10), 16, 10)).otherwise(F.substring(name, 2, 10))
    named = F.when(name == "amp", "&")
    for common in ("lt", "gt", "quot", "nbsp"):  # without a search of the whole table
        named = named.when(name == common, NAMED[common])
    return F.when(F.startswith(name, F.lit("#")), _character(number.cast("long"))).otherwise(
        named.otherwise(F.try_element_at(_map(NAMED), name)))


def decode_entities(s) -> Column:
    """Named (with semicolon) and numeric character references decoded, in one pass."""
    def part(x, i):
        name = F.regexp_extract(x, REFERENCE_RE, 1)
        known = F.when(name != "", _reference(name))
        return F.when(i == 0, x).when(known.isNotNull(), F.concat(known, F.substring(x, F.length(name) + 2, F.length(x)))) \
            .otherwise(F.concat(F.lit("&"), x))
    text = _c(s)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&", -1), part), "")).otherwise(text)


def remove_tags(s) -> Column:
    """text runs between tags joined by one space, empty runs skipped.

    A '<' never closed emits the text before it and then, again, everything
    from the end of the last complete tag (the reference's exact output).
    """
    parts = F.split(_c(s), TAG_RE, -1)
    tail = F.element_at(parts, -1)
    head = F.filter(parts, lambda x, i: i < F.size(parts) - 1)
    tail_parts = F.when(F.instr(tail, "<") > 0,
                        F.array(F.substring_index(tail, "<", 1), tail)).otherwise(F.array(tail))
    return F.array_join(F.filter(F.concat(head, tail_parts), lambda x: x != ""), " ")


def remove_tags_invalid(s) -> Column:
    """True when the fragment ends inside an unclosed tag."""
    return F.instr(F.element_at(F.split(_c(s), TAG_RE, -1), -1), "<") > 0


def strip_noise(html) -> Column:
    """Comments, scripts and styles contribute no text."""
    return F.regexp_replace(_c(html), NOISE_RE, "")


def paragraphs(html, cleaned: bool = False, tag: str = "p") -> Column:
    """text of every ``tag`` element in document order (array<string>).

    A <p> ends at </p>, at the next <p>, or at a block-level start or end
    tag; inner tags are dropped with nothing in between; entities decoded.
    Other tags may nest: each element, outer before inner, ends at its own end
    tag (or the document's end) and has the text of all within.
    ``cleaned``: ``html`` already went through ``strip_noise``.
    """
    body = _c(html) if cleaned else strip_noise(html)
    if tag.lower() == "p":
        marked = F.regexp_replace(body, P_START_RE, MARK)
        pieces = F.filter(F.split(marked, MARK, -1), lambda x, i: i > 0)
        return F.transform(pieces, lambda x: decode_entities(
            F.regexp_replace(F.regexp_replace(x, P_CUT_RE, ""), TAG_RE, "")))
    # Pieces that begin with a start or end tag, and the depth after each.
    pieces = F.filter(F.split(F.regexp_replace(body, rf"(?i)(</?{tag}(?:\s[^>]*)?>)", MARK + "$1"), MARK, -1), lambda x, i: i > 0)
    step = F.transform(pieces, lambda x: F.when(F.startswith(x, F.lit("</")), -1).otherwise(1))
    depth = F.transform(step, lambda _, i: F.aggregate(F.slice(step, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    both = F.transform(F.arrays_zip(pieces.alias("x"), depth.alias("d")), lambda e, i: F.struct(e["x"].alias("x"), e["d"].alias("d"), i.alias("i")))

    def text(start):
        end = F.coalesce(F.get(F.filter(both, lambda e: (e["i"] > start["i"]) & (e["d"] < start["d"])), F.lit(0))["i"], F.size(both))
        inner = F.array_join(F.transform(F.slice(both, start["i"] + 1, end - start["i"]), lambda e: e["x"]), "")
        return decode_entities(F.regexp_replace(inner, TAG_RE, ""))
    return F.transform(F.filter(both, lambda e: ~F.startswith(e["x"], F.lit("</"))), text)


def article_text(html, cleaned: bool = False, tag: str = "p") -> Column:
    """A5: paragraphs joined by one space; no paragraph gives ''."""
    return F.array_join(paragraphs(html, cleaned, tag), " ")


def published(html, cleaned: bool = False) -> Column:
    """raw text of the first <time> element, NULL when there is none."""
    m = F.regexp_extract(_c(html) if cleaned else strip_noise(html), TIME_RE, 0)
    return F.when(m != "", decode_entities(F.regexp_replace(m, TAG_RE, "")))


# UTF-16 as hex, big and little endian: units that are no surrogates, or pairs.
UTF16_BE_RE = r"^(?:[0-9A-CEF]...|D[0-7]..|D[89AB]..D[C-F]..)*+$"
UTF16_LE_RE = r"^(?:..(?:[0-9A-CEF].|D[0-7])|..D[89AB]..D[C-F])*+$"


def _decoded(raw: Column, cs: Column) -> Column:
    """``decode_body`` of bytes whose charset is in capitals."""
    latin = F.decode(raw, "ISO-8859-1")
    known = {k: v for k, v in WINDOWS.items() if v}
    windows = F.translate(latin, "".join(map(chr, known)), "".join(known.values()))
    undefined = "[" + "".join(f"\\x{n:02x}" for n in WINDOWS if n not in known) + "]"
    code = F.hex(raw)
    little = F.startswith(code, F.lit("FFFE"))
    body = F.when(F.startswith(code, F.lit("FEFF")) | little, F.substring(raw, 3, 1 << 30)).otherwise(raw)
    be = lambda x: F.when(F.hex(x).rlike(UTF16_BE_RE), F.decode(x, "UTF-16BE"))
    le = lambda x: F.when(F.hex(x).rlike(UTF16_LE_RE), F.decode(x, "UTF-16LE"))
    return (F.when(cs.isin("UTF-8", "UTF8"), F.try_validate_utf8(raw.cast("string")))
            .when(cs.isin("US-ASCII", "ASCII"), F.when(~latin.rlike(r"[^\x00-\x7F]"), latin))
            .when(cs.isin("ISO-8859-1", "LATIN1", "ISO8859-1"), latin)
            .when(cs.isin("WINDOWS-1252", "CP1252"), F.when(~latin.rlike(undefined), windows))
            .when(cs == "UTF-16BE", be(raw)).when(cs == "UTF-16LE", le(raw))
            .when(cs == "UTF-16", F.when(little, le(body)).otherwise(be(body))))


def decode_body(content, charset) -> Column:
    """bytes -> string by declared charset; undecodable bytes and unknown charsets -> NULL.

    UTF-8, US-ASCII, ISO-8859-1, windows-1252, UTF-16 (with byte order mark,
    else big endian), UTF-16BE and UTF-16LE. Bytes are checked before they
    are decoded (decode() would fail the job). Bytes and charset are variables
    of the rule, so however long their own expressions are, they are evaluated
    once and the compiled code stays small.
    """
    landed = F.struct(_c(content).alias("raw"), F.upper(F.trim(_c(charset))).alias("cs"))
    return F.get(F.transform(F.array(landed), lambda x: _decoded(x["raw"], x["cs"])), F.lit(0))


META_RE = r"(?i)<meta\s[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)"
META_BYTES = 1024


def decode_any(content, charset=None) -> Column:
    """bytes -> struct(text, charset) by the first rule that decodes them.

    In order: a byte order mark (dropped from the text); the declared charset;
    the charset of a <meta> among the first META_BYTES bytes (one that says
    UTF-16 was read as ASCII, so it is UTF-8); UTF-8; windows-1252;
    ISO-8859-1, which takes any bytes. Null bytes give null.
    """
    raw = _c(content)
    code = F.hex(F.substring(raw, 1, 3))
    meta = F.upper(F.regexp_extract(F.decode(F.substring(raw, 1, META_BYTES), "ISO-8859-1"), META_RE, 1))
    meta = F.when(meta.startswith("UTF-16"), F.lit("UTF-8")).otherwise(meta)

    def guess(name, body):
        return F.struct(name.alias("name"), body.alias("body"))

    marks = [("UTF-8", 3, "EFBBBF"), ("UTF-16LE", 2, "FFFE"), ("UTF-16BE", 2, "FEFF")]
    named = [meta] if charset is None else [F.upper(F.trim(_c(charset))), meta]
    guesses = [guess(F.lit(c), F.when(code.startswith(m), F.substring(raw, n + 1, 1 << 30))) for c, n, m in marks]
    guesses += [guess(c, raw) for c in (*named, F.lit("UTF-8"), F.lit("WINDOWS-1252"), F.lit("ISO-8859-1"))]
    none = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("charset"))
    # Guesses after the one that decodes are not tried.
    return F.when(raw.isNotNull(), F.aggregate(F.array(*guesses), none, lambda found, g: F.when(found["text"].isNotNull(), found).otherwise(
        F.struct(_decoded(g["body"], g["name"]).alias("text"), g["name"].alias("charset")))))
