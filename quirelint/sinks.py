"""Reports: JSON a document, a stand-alone HTML page, a summary for terminals, exit status."""

from __future__ import annotations

import html
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelint.model import Tables
from quirelint.operators.findings import rank, top

# fixed values: labels of severities, limits of the terminal summary
LABELS = {"error": "错误", "warning": "警告", "info": "提示"}
SUMMARY_LIMITS = {"error": 10, "warning": 5}
FIELDS = ["type", "severity", "message", "rule_id", "page_index", "element_index", "context", "suggestion", "location"]


def json_reports(t: Tables, findings: DataFrame, version: str = "1.0") -> DataFrame:
    """(doc_id, report): meta, document, summary by severity and type, findings in order; documents without findings too."""
    item = F.struct(F.substring("dedup_key", -8, 8).alias("id"), *FIELDS, "metadata")
    by_type = findings.groupBy("doc_id", "type").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    counted = findings.groupBy("doc_id").agg(
        *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in LABELS), F.count("*").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("place", "seq", item.alias("f")))), lambda x: x["f"]).alias("findings"),
    ).join(by_type, "doc_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = t.documents.join(counted, "doc_id", "left").withColumn("findings", F.coalesce("findings", F.array()))
    report = F.struct(
        F.struct(F.lit(version).alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("source_path").alias("source_file"), "format").alias("meta"),
        F.struct("title", "author", F.coalesce("page_count", F.lit(0)).alias("page_count"), "slide_count", "word_count").alias("document"),
        F.struct(zero("total").alias("total_findings"), zero("n_error").alias("errors"), zero("n_warning").alias("warnings"), zero("n_info").alias("info"), F.coalesce("by_type", F.create_map().cast("map<string,bigint>")).alias("by_type")).alias("summary"),
        "findings",
    )
    return rows.select("doc_id", F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))


def write_json(reports: DataFrame, path: str) -> None:
    """One line a document."""
    reports.select(F.col("report").alias("value")).write.text(path)


def html_report(title: str, rows: Iterable, page_count: int | None = None, file_label: str | None = None) -> str:
    """A page without outside references; every field is escaped. rows: findings of one document, already limited."""
    rows = list(rows)
    esc = lambda x: html.escape(str(x), quote=True)
    cards = "".join(f'<div class="card {s}"><b>{sum(r["severity"] == s for r in rows)}</b> {label}</div>' for s, label in LABELS.items())
    items = []
    for r in sorted(rows, key=lambda r: list(LABELS).index(r["severity"]) if r["severity"] in LABELS else 9):
        more = "".join(f"<p>{name}: {esc(r[k])}</p>" for name, k in (("位置", "location"), ("原文", "context"), ("建议", "suggestion")) if r[k])
        items.append(f'<div class="finding {esc(r["severity"])}"><h3>[{esc(LABELS.get(r["severity"], r["severity"]))}] {esc(r["rule_id"] or "")} {esc(r["message"])}</h3>{more}</div>')
    facts = [f"<p>{esc(file_label)}</p>"] * bool(file_label) + [f"<p>{page_count} 页</p>"] * (page_count is not None)
    style = "body{font-family:sans-serif;margin:2em}.card{display:inline-block;margin:.5em;padding:1em;border:1px solid #ccc}.error{border-left:4px solid #c00}.warning{border-left:4px solid #e90}.info{border-left:4px solid #39c}.finding{padding:.5em 1em;margin:.5em 0}"
    return f'<!DOCTYPE html><html lang="zh-CN"><head><meta charset="utf-8"><title>{esc(title)}</title><style>{style}</style></head><body><h1>{esc(title)}</h1>{"".join(facts)}{cards}{"".join(items) or "<p>无</p>"}</body></html>'


def html_reports(findings: DataFrame, title: str = "审查报告") -> DataFrame:
    """(doc_id, report) of every document with findings, rendered on the executors; a document's findings are in memory there."""
    fields = ["severity", "rule_id", "message", "location", "context", "suggestion"]
    grouped = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "seq", *fields))).alias("rows"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "report": [html_report(title, rows, None, doc) for doc, rows in zip(batch["doc_id"], batch["rows"], strict=True)]})

    return grouped.mapInPandas(run, "doc_id string, report string")


META = "struct<meta:struct<version:string,timestamp:string,source_file:string,format:string>,document:struct<title:string,author:string,page_count:int,slide_count:int,word_count:int>,summary:struct<total_findings:bigint,errors:bigint,warnings:bigint,info:bigint,by_type:map<string,bigint>>,findings:array<struct<id:string,type:string,severity:string,message:string,rule_id:string,page_index:int,element_index:int,context:string,suggestion:string,location:string,metadata:string>>>"


def read_json(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports (report) as they were written: (source_file, format, title, ... of each document) and its findings in order (source_file, place, fields)."""
    parsed = reports.select(F.from_json("report", META).alias("x"))
    documents = parsed.select("x.meta.*", "x.document.*", "x.summary.*")
    found = parsed.select(F.col("x.meta.source_file").alias("source_file"), F.posexplode("x.findings").alias("place", "f"))
    return documents, found.select("source_file", "place", "f.*")


def write_atomically(path: str, text: str) -> None:
    """Through a file beside it, so that readers never see half of it."""
    target = Path(path)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=".part-", suffix=target.suffix)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def summary(findings: DataFrame) -> DataFrame:
    """For each document the first ten errors and five warnings, in order."""
    return top(findings, SUMMARY_LIMITS, ["place", "seq"], ["doc_id"]).orderBy("doc_id", -rank(), "place")


def numbered_name(path: str, i: int, n: int) -> str:
    """``stem_NN.ext`` if there are several files."""
    p = Path(path)
    return str(p.with_name(f"{p.stem}_{i + 1:02d}{p.suffix}")) if n > 1 else path


def exit_status(findings: DataFrame, failed_files: int = 0) -> int:
    """1 if a file failed or any finding is an error, else 0."""
    return int(failed_files > 0 or not findings.where("severity = 'error'").isEmpty())
