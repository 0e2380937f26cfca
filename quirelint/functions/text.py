"""Text functions as Spark columns. Offsets are code points, as ``substring`` and ``length`` count them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: character classes and patterns that results depend on
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
CJK_BASIC = r"[\x{4E00}-\x{9FFF}]"
LATIN_CJK = rf"([a-zA-Z0-9])({CJK})"
CJK_LATIN = rf"({CJK})([a-zA-Z0-9])"
LATIN_CHINESE_PUNCTUATION = r"([a-zA-Z0-9])([，。；：！？])"
OPEN_PARENTHESIS, CLOSE_PARENTHESIS = r"[（(]", r"[）)]"
SYMBOL_BULLET = r"(?U)^\s*[•◦▪▸◆\-*]\s"
NUMBERED_BULLET = r"(?U)^\s*(?:\d+[\.\)]\s|\(\d+\)\s|[①②③④⑤⑥⑦⑧⑨⑩]\s)"
LETTERED_BULLET = r"(?U)^\s*(?:[a-zA-Z][\.\)]\s|\([a-zA-Z]\)\s)"
TRAILING_PUNCTUATION = r"[。，、.!,;；：…—]+$"
ENGLISH_TITLE_WORD = r"[a-zA-Z]+(?:'[a-z]+)?"
LONG_ENGLISH_WORD = r"(?U)\b[a-zA-Z]{4,}\b"

_SPACE = r"[\s\x1c-\x1f]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any alphabet at both ends."""
    return F.regexp_replace(col(x), rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def is_blank(x: Column | str) -> Column:
    """Whether nothing but white space is there; stops at the first other character."""
    return F.coalesce(~col(x).rlike(rf"(?U)[^{_SPACE[1:]}"), F.lit(True))


def count(x: Column | str, pattern: str) -> Column:
    """How many characters match a one-character class: what is left when runs of others are taken out."""
    inside = pattern[1:-1] if pattern.startswith("[") else pattern
    return F.length(F.regexp_replace(col(x), f"[^{inside}]+", ""))


def cjk_count(x: Column | str) -> Column:
    return count(x, CJK)


def has_cjk(x: Column | str) -> Column:
    return col(x).rlike(CJK_BASIC)


#: code points that are no characters mark where matches begin and end
BEGIN, END = "\ufdd0", "\ufdd1"


def scan(values: Column, combine) -> Column:
    """Running combination of an array of numbers, itself first: each round doubles the reach, so n values take n log n steps."""
    rounds = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda i: F.pow(F.lit(2), i).cast("int"))

    def more(a: Column, reach: Column) -> Column:
        return F.transform(a, lambda x, i: F.when(i >= reach, combine(x, F.get(a, i - reach))).otherwise(x))

    return F.aggregate(rounds, values, more)


def bound(value: Column, fn) -> Column:
    """fn of a value that is computed once however often fn names it."""
    return F.transform(F.array(value), fn)[0]


MATCHES = "array<struct<start:int,m:string>>"


def _pieces(text: Column | str, pattern: str) -> Column:
    """The text split before each match, a mark behind it. A text that holds the marks themselves is matched with U+FFFD for them."""
    return F.split(F.regexp_replace(F.translate(col(text), BEGIN + END, "\ufffd\ufffd"), pattern, f"{BEGIN}$0{END}"), BEGIN, -1)


def _located(pieces: Column) -> Column:
    n = F.size(pieces) - 1
    lengths = F.transform(F.slice(pieces, F.lit(1), n), lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))
    found = F.transform(F.slice(pieces, F.lit(2), n), lambda p: F.substring_index(p, END, 1))
    return F.zip_with(scan(lengths, lambda x, y: x + y), found, lambda at, m: F.named_struct(F.lit("start"), at, F.lit("m"), m))


def matches(text: Column | str, pattern: str) -> Column:
    """array<struct<start:int,m:string>> of the pattern's matches, left to right.

    Matches are bracketed by two marks, the text is split there, and the pieces' lengths are summed: exact
    in code points, without Python.
    """
    none = F.array().cast(MATCHES)
    return F.when(col(text).rlike(pattern), bound(_pieces(text, pattern), _located)).when(col(text).isNotNull(), none)


def first_matches(text: Column | str, pattern: str, most: int) -> Column:
    """struct<n:int,found>: how many matches there are, and the first ``most``."""
    counted = bound(_pieces(text, pattern), lambda pieces: F.named_struct(F.lit("n"), F.size(pieces) - 1, F.lit("found"), bound(F.slice(pieces, 1, most + 1), _located)))
    return F.when(col(text).rlike(pattern), counted)


def parenthesis_ranges(text: Column | str) -> Column:
    """array<struct<a:int,b:int>>: each opening one with the first closing one after it that is still free.

    The i-th opening one takes the closing one of number i + the greatest surplus of closing ones before an opening one so far.
    """
    def pair(found: Column) -> Column:
        closes = F.transform(found, lambda x: x["m"].rlike(CLOSE_PARENTHESIS).cast("int"))
        before = F.zip_with(found, scan(closes, lambda x, y: x + y), lambda x, n: F.named_struct(F.lit("at"), x["start"], F.lit("closes"), x["m"].rlike(CLOSE_PARENTHESIS), F.lit("n"), n))
        return bound(before, join)

    def join(events: Column) -> Column:
        opens, closes = F.filter(events, lambda x: ~x["closes"]), F.filter(events, lambda x: x["closes"])["at"]
        surplus = scan(F.transform(opens, lambda x, i: x["n"] - i), lambda x, y: F.greatest(x, y))
        return bound(closes, lambda ends: F.filter(F.zip_with(opens, F.transform(surplus, lambda x, i: F.get(ends, x + i)), lambda x, b: F.named_struct(F.lit("a"), x["at"], F.lit("b"), b)), lambda r: r["b"].isNotNull()))

    return bound(matches(text, f"{OPEN_PARENTHESIS[:-1]}{CLOSE_PARENTHESIS[1:]}"), pair)


def before(text: Column | str, at: Column, n: int) -> Column:
    """The n characters before an offset, fewer at the start."""
    return col(text).substr(F.greatest(at - n, F.lit(0)) + 1, F.least(at, F.lit(n)))


def window(text: Column | str, start: Column, end: Column, n: int) -> Column:
    """text[max(0, start - n) : end + n]."""
    a = F.greatest(start - n, F.lit(0))
    return col(text).substr(a + 1, end + n - a)


def bullet_class(text: Column | str) -> Column:
    c = col(text)
    return F.when(c.rlike(SYMBOL_BULLET), "symbol").when(c.rlike(NUMBERED_BULLET), "numbered").when(c.rlike(LETTERED_BULLET), "lettered")


def is_technical(word: Column | str) -> Column:
    """All capitals, or at least two capitals among small letters."""
    w = col(word)
    capitals = count(w, r"\p{Lu}")
    upper = w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")
    return (F.length(w) >= 2) & (upper | ((capitals >= 2) & w.rlike(r"\p{Ll}")))


def hex_colour(x: Column | str) -> Column:
    """Six hex digits, or null if it isn't a colour."""
    h = F.regexp_replace(strip(x), "^#+", "")
    return F.when(h.rlike("^[0-9a-fA-F]{6}$"), h)


def luminance(colour: Column | str) -> Column:
    h = hex_colour(colour)
    part = lambda i, weight: F.struct(F.lit(weight).alias("w"), (F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255.0).alias("c"))
    linear = lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return F.aggregate(F.array(part(1, 0.2126), part(3, 0.7152), part(5, 0.0722)), F.lit(0.0), lambda sum_, x: sum_ + x["w"] * linear(x["c"]))


def contrast(a: Column | str, b: Column | str) -> Column:
    x, y = luminance(a), luminance(b)
    ratio = (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
    return F.when(x.isNotNull() & y.isNotNull(), ratio)


def rounded(x: Column) -> Column:
    """A whole number as text, halves to even."""
    r = F.bround(x, 0)
    return F.when((r == 0) & (x < 0), F.lit("-0")).otherwise(r.cast("long").cast("string"))


def dedup_key(type_: Column, rule: Column, page: Column, context: Column) -> Column:
    digest = F.md5(F.encode(F.substring(F.coalesce(context, F.lit("")), 1, 120), "utf-8"))
    little = F.concat(*(F.substring(digest, i, 2) for i in (7, 5, 3, 1)))
    return F.concat_ws("|", type_, F.coalesce(rule, F.lit("")), F.coalesce(page, F.lit(-1)).cast("string"), little)


def language_segments(text: Column | str) -> Column:
    """array<struct<text:string,lang:string>>: runs that start with a Latin letter and go on to the next Chinese one, and the rest."""
    pieces = F.regexp_extract_all(col(text), F.lit(rf"[A-Za-z][^{CJK[1:-1]}]*|[^A-Za-z]+"), F.lit(0))
    pieces = F.filter(pieces, lambda p: ~is_blank(p))
    return F.transform(pieces, lambda p: F.named_struct(F.lit("text"), p, F.lit("lang"), F.when(p.rlike("^[A-Za-z]"), "en").otherwise("zh")))


def space_mixed(x: Column | str) -> Column:
    """One space between Chinese and Latin characters that touch."""
    return F.regexp_replace(F.regexp_replace(col(x), CJK_LATIN, "$1 $2"), LATIN_CJK, "$1 $2")
