"""Folders of documents: found by Spark, parsed on the executors, one row a file."""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from quirelint.model import NESTED, Tables, from_nested
from quirelint.sources import markdown, ooxml, pdf

#: extension -> parser; legacy binary formats have none here and become error rows, as PDF files do where docling isn't installed
PARSERS: dict[str, Callable[[str, bytes], dict]] = {"pptx": ooxml.parse_pptx, "docx": ooxml.parse_docx, "md": markdown.parse, "markdown": markdown.parse, "txt": markdown.parse, "pdf": pdf.parse}
SUPPORTED = ("pptx", "ppt", "docx", "doc", "pdf", "md", "markdown", "txt")


def register(extension: str, parser: Callable[[str, bytes], dict]) -> None:
    """Adds or replaces a parser, (path, bytes) -> a row of ``model.NESTED``."""
    PARSERS[extension.lower()] = parser


def find_parser(path: str) -> Callable[[str, bytes], dict] | None:
    return PARSERS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def check_folder(folder: str) -> str:
    """The folder, if its path has no step up."""
    if ".." in folder.replace("\\", "/").split("/"):
        raise ValueError(f"path leads out of its folder: {folder}")
    return folder


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """(path, content) of the folder's own files, not of folders below, by extension in either case."""
    glob = "*.{" + ",".join(sorted({v for e in extensions for v in _cases(e)})) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(check_folder(folder)).select("path", "content")


def _cases(extension: str) -> list[str]:
    return ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)]


def _parse(schema: pa.Schema, parsers: dict):
    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                extension = path.rsplit(".", 1)[-1].lower()
                try:
                    if extension not in parsers:
                        raise ValueError(f"no parser for .{extension}")
                    row = parsers[extension](path, content)
                except Exception as e:  # one file that can't be read must not stop the others
                    row = {"doc_id": path, "source_path": path, "format": extension, "error": f"{type(e).__name__}: {e}"}
                rows.append(row | {"custom_properties": list((row.get("custom_properties") or {}).items())})
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return run


def parse(files: DataFrame) -> DataFrame:
    """Rows of ``model.NESTED``; a file that can't be read has ``error`` set."""
    env = files.sparkSession.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    schema = to_arrow_schema(files.sparkSession.createDataFrame([], NESTED).schema)
    return files.select("path", "content").mapInArrow(_parse(schema, dict(PARSERS)), NESTED)


def read(spark: SparkSession, folder: str, extensions: tuple[str, ...] = SUPPORTED) -> Tables:
    """The folder's documents as tables. Parsed rows are persisted, since every table reads them."""
    return from_nested(parse(scan(spark, folder, extensions)).persist())
