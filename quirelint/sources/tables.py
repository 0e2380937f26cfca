"""Driver tables as documents.

``documents``: a document of one page, each line a paragraph. ``pages``: a document a host, pages in the order of their ids, the
h1 a title. ``conversations``: a slide deck a conversation, a slide a turn, the role its layout, lines as paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelint.functions.text import is_blank
from quirelint.model import SCHEMAS, Tables


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(df: DataFrame, table: str) -> DataFrame:
    """The table's columns, in order; those that are missing are null."""
    have = set(df.columns)
    columns = [c.split(" ") for c in SCHEMAS[table].split(", ")]
    return df.select(*((F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in columns))


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def page_body(text: Column | str) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.filter(lines, lambda x: ~is_blank(x)), "\n")


def documents(spark: SparkSession, sf_dir: str) -> Tables:
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("md").alias("format"), F.lit(0).alias("page_index"), F.lit(1).alias("slide_number"), F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select("doc_id", "format", "page_index", F.lit(0).alias("flat_idx"), F.posexplode(F.split("text", "\n")).alias("para_idx", "text"))
    elements = rows.select("doc_id", "format", "page_index", F.lit(0).alias("flat_idx"), F.lit(0).alias("depth"), F.lit("text_frame").alias("type"), *(F.lit(False).alias(c) for c in ("is_title", "is_body", "is_placeholder")))
    text = rows.select("doc_id", "format", "page_index", F.lit(1).alias("page_number"), page_body("text").alias("all_text"), F.lit(None).cast("string").alias("notes"))
    return Tables(shaped(rows, "documents"), shaped(rows, "pages"), shaped(elements, "elements"), shaped(lines, "paragraphs"), empty(spark, "runs"), empty(spark, "cells"), text)


def title(html: Column | str) -> Column:
    return F.regexp_extract(html, "(?s)<h1>(.*?)</h1>", 1)


def sites(spark: SparkSession, sf_dir: str) -> Tables:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    rows = load(spark, sf_dir, "pages").select(host.alias("doc_id"), F.lit("md").alias("format"), F.col("page_id").cast("int").alias("page_index"), (F.col("page_id") + 1).cast("int").alias("slide_number"), title("html").alias("text"))
    elements = rows.withColumns({"flat_idx": F.lit(0), "depth": F.lit(0), "type": F.lit("text_frame"), "is_title": F.lit(True), "is_body": F.lit(False), "is_placeholder": F.lit(False)})
    paragraphs = rows.withColumns({"flat_idx": F.lit(0), "para_idx": F.lit(0), "level": F.lit(1)})
    text = rows.select("doc_id", "format", "page_index", F.col("slide_number").alias("page_number"), F.col("text").alias("all_text"), F.lit(None).cast("string").alias("notes"))
    docs = rows.select("doc_id", "format").distinct()
    return Tables(shaped(docs, "documents"), shaped(rows, "pages"), shaped(elements, "elements"), shaped(paragraphs, "paragraphs"), empty(spark, "runs"), empty(spark, "cells"), text)


def decks(spark: SparkSession, sf_dir: str) -> Tables:
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.lit("pptx").alias("format"), F.col("turn").cast("int").alias("page_index"), (F.col("turn") + 1).cast("int").alias("slide_number"), F.col("role").alias("layout_name"), F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select("doc_id", "format", "page_index", F.lit(0).alias("flat_idx"), F.posexplode(F.split("text", "\n")).alias("para_idx", "text"))
    elements = rows.withColumns({"flat_idx": F.lit(0), "depth": F.lit(0), "type": F.lit("text_frame"), "is_title": F.lit(False), "is_body": F.lit(True), "is_placeholder": F.lit(False)})
    text = rows.select("doc_id", "format", "page_index", F.col("slide_number").alias("page_number"), page_body("text").alias("all_text"), F.lit(None).cast("string").alias("notes"))
    docs = rows.select("doc_id", "format").distinct()
    return Tables(shaped(docs, "documents"), shaped(rows, "pages"), shaped(elements, "elements"), shaped(lines, "paragraphs"), empty(spark, "runs"), empty(spark, "cells"), text)
