"""Regex rules: user-defined patterns over page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelint.functions.text import has_cjk, matches, parenthesis_ranges
from quirelint.model import Tables
from quirelint.operators.findings import findings, page_label
from quirelint.plans.rules import Rule, java_pattern, truthy


def regex_rule(t: Tables, rule: Rule) -> DataFrame | None:
    """A finding for each match; None if the rule has no pattern or an invalid one."""
    pattern = java_pattern(rule.params.get("pattern", ""), not truthy(rule.params.get("大小写敏感")))
    if pattern is None:
        return None
    pages = t.page_text
    if truthy(rule.params.get("仅中文页面")):
        pages = pages.where(has_cjk("all_text"))
    found = matches("all_text", pattern)
    if truthy(rule.params.get("排除括号内")):
        ranges = parenthesis_ranges("all_text")
        inside = lambda x: F.exists("ranges", lambda r: (x["start"] >= r["a"] + 1) & (x["start"] + F.length(x["m"]) <= r["b"]))
        pages = pages.withColumn("ranges", ranges)
        found = F.filter(found, lambda x: ~inside(x))
    rows = pages.select("doc_id", "page_index", "page_number", F.explode(found).alias("x"))
    return findings(rows, "custom", rule.severity, rule.rule_id, F.lit(rule.description), page=F.col("page_index"), context=F.substring("x.m", 1, 100), suggestion=F.lit(rule.params.get("suggestion", "")), location=page_label(), seq=["page_index", "x.start"])
