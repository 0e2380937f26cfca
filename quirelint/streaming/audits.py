"""Audits of folders that grow, and windowed counts of findings-like events.

Every check needs one file only, so a micro-batch holds all that it needs and no state is kept between batches; a file delivered
twice gives the same keys, which the sink table drops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quirelint.model import from_nested
from quirelint.plans.audit import audit
from quirelint.plans.rules import Config, Rule
from quirelint.sources.files import parse

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, folder: str, glob: str = "*.{pptx,docx,md,markdown,txt}", per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(folder)


def audited(files: DataFrame, rules: list[Rule], config: Config | None, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Gives ``sink`` the findings of each batch of files."""

    def batch(df: DataFrame, n: int) -> None:
        nested = parse(df).persist()
        try:
            sink(audit(from_nested(nested), rules, config), n)
        finally:
            nested.unpersist()

    return files.writeStream.foreachBatch(batch)


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts a tumbling window and ``by``; events later than ``late`` are dropped when the input is a stream."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def first_seen(findings: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Findings of a stream without those already seen within ``late``."""
    return findings.withWatermark(time, late).dropDuplicatesWithinWatermark(["doc_id", "dedup_key"])
