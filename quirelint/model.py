"""The document model as flat tables.

A corpus is six tables that share ``doc_id``. Groups of shapes are flattened when read: ``flat_idx`` is an element's
place in a pre-order walk of its page, ``parent_idx`` and ``depth`` keep the tree. ``page_text`` is derived.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelint.functions.text import is_blank

SCHEMAS = {
    "documents": "doc_id string, source_path string, format string, title string, author string, created string, modified string, slide_count int, page_count int, word_count int, custom_properties map<string,double>",
    "pages": "doc_id string, format string, page_index int, slide_number int, layout_name string, notes string",
    "elements": "doc_id string, format string, page_index int, flat_idx int, parent_idx int, depth int, type string, left double, top double, width double, height double, shape_name string, style_name string, is_title boolean, is_body boolean, is_placeholder boolean, image_ext string, chart_type string",
    "paragraphs": "doc_id string, format string, page_index int, flat_idx int, para_idx int, text string, level int, alignment string, space_before double, space_after double, line_spacing double",
    "runs": "doc_id string, format string, page_index int, flat_idx int, para_idx int, run_idx int, text string, font_name string, font_name_east_asia string, font_size double, bold boolean, italic boolean, underline boolean, strikethrough boolean, color string",
    "cells": "doc_id string, format string, page_index int, flat_idx int, row int, col int, rowspan int, colspan int, text string, font_name string, font_size double, fill_color string, font_color string",
}

#: one row a file, as parsers give it
NESTED = (
    "doc_id string, source_path string, format string, title string, author string, created string, modified string, slide_count int, page_count int, word_count int, custom_properties map<string,double>, error string, warnings array<string>, "
    "pages array<struct<page_index:int,slide_number:int,layout_name:string,notes:string,elements:array<struct<flat_idx:int,parent_idx:int,depth:int,type:string,left:double,top:double,width:double,height:double,"
    "shape_name:string,style_name:string,is_title:boolean,is_body:boolean,is_placeholder:boolean,image_ext:string,chart_type:string,"
    "paragraphs:array<struct<para_idx:int,text:string,level:int,alignment:string,space_before:double,space_after:double,line_spacing:double,"
    "runs:array<struct<run_idx:int,text:string,font_name:string,font_name_east_asia:string,font_size:double,bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,color:string>>>>,"
    "cells:array<struct<row:int,col:int,rowspan:int,colspan:int,text:string,font_name:string,font_size:double,fill_color:string,font_color:string>>>>>>"
)


@dataclass(frozen=True)
class Tables:
    documents: DataFrame
    pages: DataFrame
    elements: DataFrame
    paragraphs: DataFrame
    runs: DataFrame
    cells: DataFrame
    text: DataFrame | None = None  # page_text, where a source has it at hand
    errors: DataFrame | None = None  # (doc_id, source_path, error) of files that could not be read

    @cached_property
    def page_text(self) -> DataFrame:
        """(doc_id, format, page_index, page_number, all_text): non-blank paragraphs, then cells, element by element, then notes."""
        if self.text is not None:
            return self.text
        order = lambda *c: F.struct(*(x.cast("int").alias(f"o{i}") for i, x in enumerate(c))).alias("ord")
        zero = F.lit(0)
        kinds = self.elements.where("type is not null").select("doc_id", "page_index", "flat_idx")
        keys = ["doc_id", "page_index"]
        paragraphs = self.paragraphs.join(kinds, [*keys, "flat_idx"], "left_semi").select(*keys, order(F.col("flat_idx"), zero, F.col("para_idx"), zero), "text")
        cells = self.cells.join(kinds, [*keys, "flat_idx"], "left_semi").select(*keys, order(F.col("flat_idx"), F.lit(1), F.col("row"), F.col("col")), "text")
        notes = self.pages.select(*keys, order(F.lit(2**31 - 1), zero, zero, zero), F.col("notes").alias("text"))
        pieces = paragraphs.unionByName(cells).unionByName(notes).where(~is_blank("text"))
        joined = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x"))
        joined = joined.select(*keys, F.array_join("x.text", "\n").alias("all_text"))
        return self.pages.select("doc_id", "format", "page_index", page_number().alias("page_number"), "notes").join(joined, keys, "left").select("doc_id", "format", "page_index", "page_number", F.coalesce("all_text", F.lit("")).alias("all_text"), "notes")

    @cached_property
    def document_text(self) -> DataFrame:
        """(doc_id, format, all_text): page texts joined by an empty line; documents without pages have an empty text."""
        pages = self.page_text.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "all_text"))).alias("x"))
        return self.documents.select("doc_id", "format").join(pages, "doc_id", "left").select("doc_id", "format", F.coalesce(F.array_join("x.all_text", "\n\n"), F.lit("")).alias("all_text"))

    @cached_property
    def frames(self) -> DataFrame:
        """Paragraphs of text frames with what checks ask of their element and page."""
        element = self.elements.where("type = 'text_frame'").select("doc_id", "page_index", "flat_idx", "is_title", "is_body", "is_placeholder", "shape_name")
        number = self.pages.select("doc_id", "page_index", page_number().alias("page_number"))
        return self.paragraphs.join(element, ["doc_id", "page_index", "flat_idx"]).join(number, ["doc_id", "page_index"])

    @cached_property
    def abbreviations(self) -> DataFrame:
        """One scan for the four checks of abbreviations."""
        from quirelint.operators.factual import abbreviation_occurrences, abbreviations

        return abbreviations(abbreviation_occurrences(self))

    def persist(self) -> Tables:
        return replace(self, **{n: getattr(self, n).persist() for n in SCHEMAS})


def page_number():
    """The number that readers see: 0 counts as missing."""
    return F.coalesce(F.when(F.col("slide_number") != 0, F.col("slide_number")), F.col("page_index") + 1)


def from_nested(nested: DataFrame) -> Tables:
    """Flat tables of parsed files; ``nested`` should be persisted or checkpointed, it is read once a table."""
    good = nested.where("error is null")
    pages = good.select("doc_id", "format", F.explode("pages").alias("p"))
    elements = pages.select("doc_id", "format", F.col("p.page_index").alias("page_index"), F.explode("p.elements").alias("e"))
    paragraphs = elements.select("doc_id", "format", "page_index", F.col("e.flat_idx").alias("flat_idx"), F.explode("e.paragraphs").alias("x"))
    runs = paragraphs.select("doc_id", "format", "page_index", "flat_idx", F.col("x.para_idx").alias("para_idx"), F.explode("x.runs").alias("r"))
    cells = elements.select("doc_id", "format", "page_index", F.col("e.flat_idx").alias("flat_idx"), F.explode("e.cells").alias("c"))
    names = lambda table: [x.split()[0] for x in SCHEMAS[table].split(", ")]

    def flat(df: DataFrame, table: str, struct: str) -> DataFrame:
        have = set(df.columns)
        return df.select(*(n if n in have else F.col(f"{struct}.{n}").alias(n) for n in names(table)))

    return Tables(
        good.select(*names("documents")), flat(pages, "pages", "p"), flat(elements, "elements", "e"), flat(paragraphs, "paragraphs", "x"), flat(runs, "runs", "r"), flat(cells, "cells", "c"),
        errors=nested.where("error is not null").select("doc_id", "source_path", "error"),
    )


def tables(spark: SparkSession, **rows) -> Tables:
    """Tables from lists of dicts (or frames); what a row leaves out is null."""
    out = {}
    for name, schema in SCHEMAS.items():
        given = rows.get(name, [])
        out[name] = given if isinstance(given, DataFrame) else spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in given], schema)
    return Tables(**out)
