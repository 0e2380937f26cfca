"""The findings table and what is done with it: de-duplication, filters, counts, top lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelint.functions.text import dedup_key

SCHEMA = "doc_id string, type string, severity string, message string, rule_id string, page_index int, element_index int, context string, suggestion string, location string, metadata string, seq array<int>"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
SEVERITIES = ("error", "warning", "info")


def page_label(number: Column | str = "page_number") -> Column:
    return F.format_string("第 %d 页", number)


def findings(df: DataFrame, type_: str, severity: str, rule: str | None, message: Column, *, page: Column | None = None, context: Column | None = None, suggestion: Column | None = None, location: Column | None = None, metadata: Column | None = None, seq: list | None = None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    order = F.array(*(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("int"), F.lit(-1)) for c in seq or [])).cast("array<int>")
    return df.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(type_).alias("type"), F.lit(severity).alias("severity"), message.alias("message"), F.lit(rule).cast("string").alias("rule_id"),
        (F.lit(None) if page is None else page).cast("int").alias("page_index"), F.lit(None).cast("int").alias("element_index"),
        text(context).alias("context"), text(suggestion).alias("suggestion"), text(location).alias("location"), text(metadata).alias("metadata"), order.alias("seq"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    """All findings; ``seq`` gets the part's place in front."""
    return reduce(DataFrame.unionByName, (p.withColumn("seq", F.concat(F.array(F.lit(i)), "seq")) for i, p in enumerate(parts)))


def rank(severity: Column | str = "severity") -> Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    return F.when(c == "error", 3).when(c == "warning", 2).when(c == "info", 1).otherwise(-1)


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("dedup_key", dedup_key(F.col("type"), F.col("rule_id"), F.col("page_index"), F.col("context")))


def deduplicate(df: DataFrame, order: str = "seq") -> DataFrame:
    """One finding a document and key: the gravest, of those the first. ``place`` is where its key came first.

    Equal findings that repeat without end (one rule, one page) are first reduced by a map-side aggregate. The rule is part of the
    key and a grouping column too, so a filter on rules reaches the checks and leaves the others out of the plan.
    """
    rest = [c for c in df.columns if c not in ("doc_id", "rule_id")]
    first = with_key(df).withColumn("grave", -rank())
    best = first.groupBy("doc_id", "rule_id", "dedup_key").agg(F.min_by(F.struct(*rest), F.struct("grave", order)).alias("x"), F.min(order).alias("place"))
    return best.select("doc_id", *(F.col("rule_id") if c == "rule_id" else F.col(f"x.{c}").alias(c) for c in df.columns if c not in ("doc_id", order)), F.col(f"x.{order}").alias(order), "dedup_key", "place")


def exempted(*parts: DataFrame) -> DataFrame:
    """All exempt (doc_id, dedup_key), each once."""
    return reduce(DataFrame.unionByName, (p.select("doc_id", "dedup_key") for p in parts)).distinct()


def same(a: DataFrame, b: DataFrame) -> DataFrame:
    """Findings of either that the other doesn't have as often, ids and order aside: (columns compared, missing: how many more ``a`` has)."""
    compared = ["doc_id", "type", "severity", "message", "rule_id", "page_index", "context", "suggestion", "location"]
    counted = a.select(*compared, F.lit(1).alias("n")).unionByName(b.select(*compared, F.lit(-1).alias("n"))).groupBy(*compared).agg(F.sum("n").alias("missing"))
    return counted.where("missing <> 0")


def filtered(df: DataFrame, severities: list[str] | None = None, types: list[str] | None = None, without_rules: list[str] | None = None, without_pages: list[int] | None = None, exempt: DataFrame | None = None) -> DataFrame:
    """Findings of given severities (errors and warnings if None) and types (all if empty), less rules, pages as readers number them, and exempt (doc_id, dedup_key)."""
    df = df.where(F.col("severity").isin(severities if severities is not None else ["error", "warning"]))
    if types:
        df = df.where(F.col("type").isin(types))
    if without_rules:
        df = df.where(F.col("rule_id").isNull() | ~F.col("rule_id").isin(without_rules))
    if without_pages:
        df = df.where(F.col("page_index").isNull() | ~(F.col("page_index") + 1).isin(without_pages))
    return df if exempt is None else df.join(exempt, ["doc_id", "dedup_key"], "left_anti")


def ordered(df: DataFrame) -> DataFrame:
    """Errors first, then warnings, then the rest, each as found."""
    return df.orderBy("doc_id", -rank(), "seq")


def severity_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), F.count("*").alias("total"))


def batch_totals(pages: DataFrame, df: DataFrame) -> DataFrame:
    """One row for a batch: (documents, pages, findings by severity, total)."""
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).agg(F.count("*").alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))
    return sizes.crossJoin(severity_counts(df))  # a row by a row


def type_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "type").agg(F.count("*").alias("n"))


def page_counts(df: DataFrame, *by: str) -> DataFrame:
    label = F.when(F.col("page_index").isNull(), "?").otherwise(F.concat(F.lit("p"), (F.col("page_index") + 1).cast("string")))
    return df.groupBy(*by, label.alias("page")).agg(F.count("*").alias("n"))


def grouping_sets(df: DataFrame) -> DataFrame:
    """Counts by severity, by type, and in all."""
    return df.groupingSets([["severity"], ["type"], []], "severity", "type").agg(F.count("*").alias("n"))


def pivot(df: DataFrame, by: str = "doc_id") -> DataFrame:
    return df.groupBy(by).pivot("severity", list(SEVERITIES)).agg(F.count(F.lit(1))).na.fill(0)


def top(df: DataFrame, limits: dict[str, int], order: list, by: list[str] | None = None) -> DataFrame:
    """The first findings of each severity, in ``order``, of each group or of all.

    Over all findings each severity is cut by a top-k first, so that no task sorts a whole severity.
    """
    if not by:
        df = reduce(DataFrame.unionByName, (df.where(F.col("severity") == s).orderBy(*order).limit(n) for s, n in limits.items()))
    most = F.coalesce(*(F.when(F.col("severity") == s, n) for s, n in limits.items()))
    place = F.row_number().over(W.partitionBy(*(by or []), "severity").orderBy(*order))
    return df.where(F.col("severity").isin(list(limits))).withColumn("place", place).where(F.col("place") <= most)
