"""Checks of numbers and abbreviations across a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelint.functions.text import before, bound, matches, parenthesis_ranges, strip, window
from quirelint.model import Tables
from quirelint.operators.findings import findings, page_label
from quirelint.plans.rules import Config

# fixed values: abbreviations, numbers with units, what goes before page and figure numbers
ABBREVIATION = r"(?U)\b[A-Z]{2,8}\b"
NUMBER = r"(?U)(\d+(?:\.\d+)?\s*(?:%|nm|μm|kV|°[CF]|cm|mm|mV|mA|kW|MHz|GHz|V|A|W|m)?)(?![a-zA-Z])"
NUMBERED = r"(?iuU)(?:page|slide|fig|figure|table|tab|图|表|第)\s*\.?\s*$"
GLOSS = r"(?U)^\s*\([^)]+\)"
# fixed values: capitals that are plain words, not abbreviations
COMMON_WORDS = [
    "OK", "AM", "PM", "GO", "DO", "IS", "IT", "WE", "HE", "MY", "BY", "TO", "IF", "OR", "SO", "NO", "UP", "ON", "IN", "AT", "OF", "AS", "BE", "AN", "ME", "US", "THE", "AND", "FOR", "ALL", "BUT",
    "NOT", "CAN", "ARE", "WAS", "HAS", "HAD", "NEW", "SET", "END", "TOP", "ONE", "TWO", "VIA", "MAY", "ANY", "NOW", "OUR", "USE", "GET", "LET", "SEE", "WAY", "THAT", "THIS", "THAN", "THEN", "WITH",
    "WHEN", "FROM", "HAVE", "BEEN", "WILL", "ALSO", "USED", "EACH", "SOME", "MORE", "ONLY", "VERY", "JUST", "WHAT", "WHICH", "THEIR", "THESE", "WHERE", "WOULD", "COULD", "SHOULD", "THERE", "ABOUT",
]


def numbers(t: Tables) -> DataFrame:
    """(doc_id, page_index, page_number, start, match, value, context, key): numbers but for those of pages and figures.

    key is the context, 30 characters each side, in small letters with digits as N.
    """
    rows = t.page_text.select("doc_id", "page_index", "page_number", "all_text", F.explode(matches("all_text", NUMBER)).alias("x"))
    start, end = F.col("x.start"), F.col("x.start") + F.length("x.m")
    match = strip("x.m")
    prefix, suffix = strip(before("all_text", start, 30)), strip(F.col("all_text").substr(end + 1, F.lit(30)))
    context = strip(F.concat_ws(" ", prefix, match, suffix))
    of_page = match.rlike(r"(?U)^\d+$") & strip(F.lower(before("all_text", start, 10))).rlike(NUMBERED)
    value = F.regexp_replace(match, r"[^0-9.]", "").try_cast("double")
    key = F.regexp_replace(strip(F.lower(context)), r"(?U)\d+", "N")
    rows = rows.where(~of_page).select("doc_id", "page_index", "page_number", start.alias("start"), match.alias("match"), value.alias("value"), context.alias("context"), key.alias("key"))
    return rows.where("value is not null")


def number_groups(t: Tables) -> DataFrame:
    """(doc_id, key, n, distinct values, x: mentions in order)."""
    g = numbers(t).groupBy("doc_id", "key")
    return g.agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct"), F.array_sort(F.collect_list(F.struct("page_index", "start", "page_number", "match", "value", "context"))).alias("x"))


def numeric_consistency(t: Tables, c: Config) -> DataFrame:
    """CON-001: one wording, several values."""
    rows = number_groups(t).where("distinct > 1").withColumn("first", F.col("x")[0])
    places = F.array_join(F.transform("x", lambda e: F.format_string("  - 第 %d 页: %s", e["page_number"], e["match"])), "\n")
    seen = F.to_json(F.struct(F.array_sort(F.array_distinct("x.value")).alias("values"), F.transform("x", lambda e: F.named_struct(F.lit("page"), e["page_number"], F.lit("value"), e["value"])).alias("occurrences")))
    return findings(
        rows, "factual", "error", "CON-001", F.lit("数值不一致: 相同指标在不同位置出现不同的数值"), page=F.col("first.page_index"), context=F.substring("first.context", 1, 100),
        suggestion=F.concat(F.lit("请确认正确的数值并统一修改:\n"), places), location=F.format_string("第 %d 页等多处", "first.page_number"), metadata=seen, seq=["first.page_index", "first.start"],
    )


def abbreviation_occurrences(t: Tables) -> DataFrame:
    """(doc_id, page_index, page_number, abbr, pos, context, def_site): def_site is the parenthesis that defines, after it or around it."""
    text = F.col("all_text")

    def located(ranges: Column) -> Column:
        """What a match needs of its page's text and brackets, found once a page and not once a match."""

        def one(x: Column) -> Column:
            end = x["start"] + F.length(x["m"])
            gloss = F.regexp_extract(text.substr(end + 1, F.lit(80)), GLOSS, 0)
            after = F.when(gloss != "", end + F.instr(gloss, "(") - 1)
            around = F.get(F.filter(ranges, lambda r: (r["a"] < x["start"]) & (x["start"] < r["b"])), F.lit(0))["a"]
            return F.named_struct(F.lit("abbr"), x["m"], F.lit("pos"), x["start"], F.lit("context"), window("all_text", x["start"], end, 20), F.lit("def_site"), F.coalesce(after, around))

        return F.transform(F.filter(matches(text, ABBREVIATION), lambda x: ~x["m"].isin(COMMON_WORDS)), one)

    rows = t.page_text.where(text.rlike(ABBREVIATION)).select("doc_id", "page_index", "page_number", F.explode(bound(parenthesis_ranges(text), located)).alias("x"))
    return rows.select("doc_id", "page_index", "page_number", "x.*")


def abbreviations(occurrences: DataFrame) -> DataFrame:
    """A row for each document and abbreviation: total, definitions (distinct sites, whatever the page), first, first definition."""
    where, defined = F.struct("page_index", "pos"), F.col("def_site").isNotNull()
    occurrence = F.struct("page_index", "page_number", "pos", "context", defined.alias("defined"))
    return occurrences.groupBy("doc_id", "abbr").agg(
        F.count("*").alias("total"), F.count_distinct("def_site").alias("definitions"), F.min_by(occurrence, where).alias("first"),
        F.min_by(F.when(defined, occurrence), F.when(defined, where)).alias("definition"), F.array_sort(F.collect_list(F.when(defined, F.struct("page_index", "pos", "page_number")))).alias("sites"),
    )


def _abbreviation(rows: DataFrame, severity: str, rule: str, message: Column, suggestion: Column, location: Column | None = None, of: str = "first", metadata: Column | None = None) -> DataFrame:
    page = F.col(f"{of}.page_index")
    return findings(rows, "factual", severity, rule, message, page=page, context=F.substring(f"{of}.context", 1, 120), suggestion=suggestion, location=page_label(F.col(f"{of}.page_number")) if location is None else location, metadata=metadata, seq=["first.page_index", "first.pos"])


def first_defined(t: Tables, c: Config) -> DataFrame:
    """CON-003: the first occurrence is no definition."""
    rows = t.abbreviations.where("not first.defined")
    return _abbreviation(rows, "warning", "CON-003", F.format_string("缩写「%s」首次出现时未给出全称", "abbr"), F.format_string("建议首次出现时写为「%s (全称)」格式", "abbr"), metadata=F.to_json(F.struct(F.col("total").alias("total_occurrences"))))


def defined_never_used(t: Tables, c: Config) -> DataFrame:
    """CON-003-A: defined, and in no other place."""
    rows = t.abbreviations.where("(first.defined or definitions > 0) and total <= definitions")
    return _abbreviation(rows, "info", "CON-003-A", F.format_string("缩写「%s」已定义但未再次使用，定义可能是多余的", "abbr"), F.lit("如果该缩写不再出现，可考虑移除其定义；或检查是否有遗漏的使用场景"), metadata=F.to_json(F.struct(F.col("total").alias("total_occurrences"), F.col("definitions").alias("definition_count"))))


def multiply_defined(t: Tables, c: Config) -> DataFrame:
    """CON-003-B: defined at several sites; sites at one offset of different pages count once."""
    rows = t.abbreviations.where("definitions >= 2")
    pages = F.array_join(F.transform("sites", lambda s: F.format_string("第 %d 页", s["page_number"])), "、")
    seen = F.to_json(F.struct(F.col("definitions").alias("definition_count"), F.col("sites.page_number").alias("definition_pages")))
    return _abbreviation(rows, "warning", "CON-003-B", F.format_string("缩写「%s」被重复定义了 %d 次", "abbr", "definitions"), F.lit("建议仅保留首次定义，后续出现时直接使用缩写"), pages, "definition", seen)


def used_before_defined(t: Tables, c: Config) -> DataFrame:
    """CON-003-C: defined, but not where it first occurs."""
    rows = t.abbreviations.where("definitions > 0 and not first.defined")
    pages = [F.col("first.page_number"), F.col("definition.page_number")]
    return _abbreviation(
        rows, "warning", "CON-003-C", F.format_string("缩写「%s」在第 %d 页使用，但在第 %d 页才给出定义", "abbr", *pages), F.lit("建议将缩写定义移至首次出现处，写为「全称 (ABBR)」格式"),
        F.format_string("第 %d 页 (使用) → 第 %d 页 (定义)", *pages), metadata=F.to_json(F.struct(pages[0].alias("first_use_page"), pages[1].alias("definition_page"))),
    )
