"""Text of documents: cleaning, detection of lists, tables and roles, widths, counters; as Column expressions."""

from __future__ import annotations

import codecs
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Fixed value: Han characters.
HAN = r"\x{4e00}-\x{9fa5}"
# Ordered and bulleted list lines.
ORDERED = r"^\s*(?:\(?[0-9A-Za-z]{1,3}\)?[.)\x{3001}\x{ff1f}]|[\x{ff08}(][\x{4e00}\x{4e8c}\x{4e09}\x{56db}\x{4e94}\x{516d}\x{4e03}\x{516b}\x{4e5d}\x{5341}]{1,3}[\x{ff09})])\s+(.+)$"
BULLETED = r"^\s*[\x{2022}\x{25cf}\x{25cb}\x{25a0}\x{25c6}*-]\s+(.+)$"
# Roman numerals and Chinese digits and units.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
CHINESE_DIGITS, CHINESE_UNITS = "零一二三四五六七八九", ("", "十", "百", "千")
# Widths and scores of characters.
#: Widths of characters as shares of the font size, by pattern; the first that fits counts.
CHAR_WIDTHS = ((r"\s", 0.25), (r"[\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{ff01}-\x{ff60}\x{ffe0}-\x{ffe6}]", 1.0), ("[MW]", 0.9), ("[CDGOQ]", 0.75), ("[PFLT]", 0.57), ("[IJ]", 0.36), ("[A-Z]", 0.66))
#: Scores of characters of decoded text, by pattern; the first that fits counts, any other character scores 0.3.
CHAR_SCORES = ((r"\x{fffd}", -12.0), (r"\x{0}", -5.0), (r"[\x{1}-\x{8}\x{b}\x{c}\x{e}-\x{1f}]", -3.0), ("[A-Za-z0-9]", 1.2), (r"\p{IsHan}", 3.5), (r"\s", 0.2), (r"[.,:;!?()\-_/|]", 0.5))


def matches(text: Column, pattern: str) -> Column:
    """How many code points fit a pattern of one character."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _weigh(text: Column, weights: tuple, other: float) -> Column:
    """Sum of the weights of all characters; each counts for the first pattern that it fits."""
    total, rest = F.lit(0.0), text
    for pattern, weight in weights:
        left = F.regexp_replace(rest, pattern, "")
        total = total + (F.char_length(rest) - F.char_length(left)) * F.lit(weight)
        rest = left
    return total + F.char_length(rest) * F.lit(other)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; characters beyond the basic plane count two."""
    return F.char_length(text) + matches(text, r"[\x{10000}-\x{10ffff}]")


def normalize(text: Column) -> Column:
    """NUL goes, BEL is a cell border, VT and CR are line ends, other controls go; runs of spaces and tabs are one; trimmed."""
    gone = "".join(map(chr, [*range(7), 8, 12, *range(14, 32), 127]))
    text = F.translate(text, "\x07\x0b\r" + gone, "|\n\n")
    return F.trim(F.regexp_replace(text, "[ \\t]+", " "))


# Fixed value: characters that UTF-8 read as Latin-1 or GBK shows, and the sign of bytes that were lost.
MOJIBAKE = "[ÃÂäåæçèé]|\ufffd|锟|鎬|宸|濮|韬|骞|涓|鍚|煡"


def mojibake(text: Column) -> Column:
    """UTF-8 that was read by single bytes, read again; as it was where it has no sign of that or does not decode.

    The bytes are the lower eight bits of each character's first UTF-16 unit, whatever stands above them.
    """
    units = F.hex(F.encode(text, "UTF-16BE"))
    low = F.unhex(F.regexp_replace(units, r"\G..(..)(?:D[C-F]..)?", "$1"))
    again = low.cast("string")
    good = text.rlike(MOJIBAKE) & F.is_valid_utf8(again) & ~F.contains(F.make_valid_utf8(again), F.lit("\ufffd"))
    return F.when(good, F.decode(F.when(good, low), "UTF-8")).otherwise(text)


def weighted_length(text: Column) -> Column:
    """Han characters count 1, others 0.55."""
    return _weigh(text, ((f"[{HAN}]", 1.0),), 0.55)


def decode_score(text: Column) -> Column:
    """How much a text looks as if its bytes had been decoded rightly."""
    return _weigh(text, CHAR_SCORES, 0.3)


# Code pages of old files and their codecs, and the candidates for bytes of an unknown one, in order.
CODE_PAGES = {1252: "cp1252", 936: "gbk", 950: "big5", 932: "cp932", 949: "cp949"}
CANDIDATES = ("cp1252", "gb18030", "gbk", "utf-8")
#: Code page 1252 with the bytes that it leaves out as control characters.
_WESTERN = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))


def _decoded(raw: bytes, codec: str) -> str:
    return codecs.charmap_decode(raw, "strict", _WESTERN)[0] if codec == "cp1252" else raw.decode(codec, "replace")


@pandas_udf(ArrayType(StringType()))
def _candidates(raw: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else [_decoded(bytes(x), c) for c in CANDIDATES] for x in raw])


def best_decoded(raw: Column) -> Column:
    """Bytes of an unknown code page as text: the first candidate with the highest decode_score()."""
    scored = F.transform(_candidates(raw), lambda t, i: F.struct(decode_score(t).alias("score"), (-i).alias("first"), t.alias("text")))
    return F.array_max(scored)["text"]


@pandas_udf(StringType())
def _by_page(raw: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else _decoded(bytes(x), CODE_PAGES.get(int(p) if p == p and p is not None else 1252, "cp1252")) for x, p in zip(raw, page, strict=True)])


def decode_page(raw: Column, page: Column) -> Column:
    """struct<text, warning>: bytes of a code page as text; unknown pages count as 1252, with a warning."""
    warning = F.when(~page.isin(*CODE_PAGES), F.concat(F.lit("code page "), page.cast("string"), F.lit(" is read as 1252")))
    return F.struct(_by_page(raw, page).alias("text"), warning.alias("warning"))


# Fixed value: marks of a field's beginning, the end of its instruction and its end; 01 and 08 are anchors of objects.
FIELD_MARKS = "\x13\x14\x15"


#: One round of resolving fields: instructions keep their anchors only, further separators go, a field that holds no
#: other becomes its result, or its anchors if it has none.
FIELD_STEPS = (
    (r"(\x13|(?!\A)\G)([\x01\x08]*)[^\x01\x08\x13-\x15]+", "$1$2"),
    (r"(\x13[\x01\x08]*\x14|(?!\A)\G)([^\x13-\x15]*)\x14", "$1$2"),
    (r"\x13[\x01\x08]*\x14([^\x13-\x15]+)\x15", "$1"),
    (r"\x13([\x01\x08]*)\x14?\x15", "$1"),
)


def field_results(text: Column) -> Column:
    """Texts of old documents with each field as its result, or as the anchors of its instruction where it has no result.

    Fields lie in each other: a running count over the marks says how deep, which is how many rounds from the inside out
    it takes, and how many fields have no end, which come to theirs at the end of the text. Marks that belong to no field
    go.
    """
    ends = F.split(F.regexp_replace(text, f"[^{FIELD_MARKS[0]}{FIELD_MARKS[2]}]", ""), "")
    count = lambda s, c: F.when(c == FIELD_MARKS[0], s["now"] + 1).when(c == FIELD_MARKS[2], F.greatest(s["now"] - 1, F.lit(0))).otherwise(s["now"])
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    depth = F.aggregate(ends, start, lambda s, c: F.struct(count(s, c).alias("now"), F.greatest(s["most"], count(s, c)).alias("most")))

    def round_(t: Column) -> Column:
        for pattern, kept in FIELD_STEPS:
            t = F.regexp_replace(t, pattern, kept)
        return t

    whole = F.concat(text, F.repeat(F.lit(FIELD_MARKS[2]), depth["now"]))
    resolved = F.aggregate(F.sequence(F.lit(1), depth["most"]), whole, lambda t, _: round_(t))
    return F.translate(F.when(depth["most"] > 0, resolved).otherwise(text), FIELD_MARKS, "")


def text_width(text: Column, font: Column) -> Column:
    """Estimated width of a line in the unit of the font size."""
    return _weigh(text, CHAR_WIDTHS, 0.5) * font


def list_kind(line: Column) -> Column:
    """'ordered', 'bulleted' or null."""
    return F.when(line.rlike(ORDERED), "ordered").when(line.rlike(BULLETED), "bulleted")


def list_text(line: Column) -> Column:
    """The line without its list mark; null where it has none."""
    return F.when(line.rlike(ORDERED), F.regexp_extract(line, ORDERED, 1)).when(line.rlike(BULLETED), F.regexp_extract(line, BULLETED, 1))


def is_table_line(line: Column) -> Column:
    """Two or more parts between bars that are not blank."""
    return F.size(F.filter(F.split(line, r"\|"), lambda c: F.trim(c) != "")) >= 2


def solid_length(text: Column) -> Column:
    """Characters that are no white space."""
    return F.char_length(F.translate(text, " \t\n\x0b\f\r", ""))


def role(text: Column, index: Column, styled: Column | None = None, signal: Column | None = None, solid: Column | None = None) -> Column:
    """title, heading or body of the paragraph at a 0-based place of its document.

    styled: it has a style of its own; signal: that style speaks for a heading; solid: its solid_length(), where that
    is worked out before (functions of arrays share no work).
    """
    n = solid_length(text) if solid is None else solid
    plain = ~text.rlike(r"[|:\x{ff1a}]") & ~text.rlike("[0-9]{4,}")
    if styled is not None:
        plain = plain & (~styled | signal)
    return F.when((index == 0) & (n <= 24), "title").when(n.between(1, 18) & plain, "heading").otherwise("body")


def strip_html(text: Column) -> Column:
    """Text of HTML by patterns: scripts and styles go, tags are spaces, white space is one space; trimmed."""
    text = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"\s+", " "))


def strip_rtf(text: Column) -> Column:
    """Text of RTF by patterns: paragraph marks are line ends, other control words, groups' braces and escapes go."""
    text = F.regexp_replace(text, r"\\par[d]?\b ?", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"\\'[0-9a-fA-F]{2}", ""), r"\\[a-zA-Z]+-?[0-9]* ?", "")
    return F.trim(F.regexp_replace(text, r"[{}]", ""))


def escape_html(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def roman(n: Column) -> Column:
    """Roman numeral; numbers below 1 count as 1."""
    start = F.struct(F.greatest(n, F.lit(1)).cast("int").alias("n"), F.lit("").alias("out"))
    steps = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN])
    return F.aggregate(steps, start, lambda a, x: F.struct((a["n"] % x["v"]).alias("n"), F.concat(a["out"], F.repeat(x["s"], F.floor(a["n"] / x["v"]).cast("int"))).alias("out")), lambda a: a["out"])


def chinese(n: Column) -> Column:
    """Chinese numeral of 1 to 9999 (numbers below 1 count as 1); decimal digits beyond."""
    n = F.greatest(n, F.lit(1)).cast("int")
    digits = F.array(*map(F.lit, CHINESE_DIGITS))
    text = F.lit("")
    for p in (3, 2, 1, 0):
        d = F.floor(n / 10**p) % 10
        gap = (F.floor(n / 10 ** (p + 1)) > 0) & (F.floor(n / 10 ** (p + 1)) % 10 == 0) if p < 3 else F.lit(False)
        one = F.when((d == 1) & (n < 20) & F.lit(p == 1), "").otherwise(digits[d.cast("int")])
        text = F.concat(text, F.when(d == 0, "").otherwise(F.concat(F.when(gap & (text != ""), CHINESE_DIGITS[0]).otherwise(""), one, F.lit(CHINESE_UNITS[p]))))
    return F.when(n > 9999, n.cast("string")).otherwise(text)


def line_count(text: Column, width: Column, font: Column, least: int = 8) -> Column:
    """Estimated lines of a text: each line of it wraps by weighted length at the width, at least ``least`` characters."""
    capacity = F.greatest(F.lit(least), F.floor(width / (font * 0.95)))
    return F.aggregate(F.split(text, "\n"), F.lit(0).cast("long"), lambda n, line: n + F.greatest(F.lit(1).cast("long"), F.ceil(weighted_length(line) / capacity)))


def paragraph_height(text: Column, kind: Column, width: float = 554.0) -> Column:
    """Estimated height of a paragraph in px by its role, at least 18: lines by line height, and the space after it."""
    pick = lambda title, heading, body: F.when(kind == "title", title).when(kind == "heading", heading).otherwise(body)
    font, high, after = pick(22.0, 16.0, 14.0), pick(1.45, 1.65, 1.8), pick(18.0, 14.0, 12.0)
    capacity = F.greatest(F.lit(8), F.floor(width / (font * 0.95)))
    first = F.greatest(F.lit(4), F.floor(width / (font * 0.95)))
    lengths = F.transform(F.split(F.when(text == "", " ").otherwise(text), "\n"), weighted_length)
    one = lambda n: F.when(n <= first, F.lit(1).cast("long")).otherwise(1 + F.ceil((n - first) / capacity))
    lines = F.aggregate(lengths, F.lit(0).cast("long"), lambda sum_, n: sum_ + one(n))
    return F.greatest(F.lit(18.0), lines * font * high + after)


def with_number(text: Column, number: Column, suffix: Column) -> Column:
    """A paragraph after its list number, with a tab, a space or nothing between; as it was if it begins with the number already."""
    gap = F.when(suffix == "space", " ").when(suffix == "tab", "\t").otherwise("")
    there = (text == number) | text.startswith(F.concat(number, F.lit(" "))) | text.startswith(F.concat(number, F.lit("\t")))
    return F.when(number.isNull() | (number == "") | there, text).otherwise(F.concat(number, gap, text))


def json_table(text: Column) -> Column:
    """array<struct<category, values array<double>>> of a JSON table of rows under a row of headings: {"data": [[...], ...]}.

    The category is a row's first cell, trimmed; rows without one are left out. What is no number is 0. Quotes may be
    written as ?quot;.
    """
    schema = "struct<data: array<array<string>>>"
    read = F.coalesce(F.from_json(text, schema)["data"], F.from_json(F.replace(text, F.lit("?quot;"), F.lit('"')), schema)["data"])
    rows = F.slice(read, F.lit(2), F.greatest(F.size(read) - 1, F.lit(0)))
    number = lambda v: F.coalesce(v.try_cast("double"), F.lit(0.0))
    return F.filter(
        F.transform(rows, lambda r: F.struct(F.trim(F.get(r, F.lit(0))).alias("category"), F.transform(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), number).alias("values"))),
        lambda r: F.coalesce(r["category"], F.lit("")) != "",
    )
