"""``python -m quirelint.cli audit PATH [--rules FILE] ...``: audits a file or a folder and writes reports.

Exit status: 0 without errors, 1 if a file failed, a finding is an error or nothing was found, 2 for a report of unknown kind.
"""

from __future__ import annotations

import argparse
import importlib.util
import shutil
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quirelint import repair, sinks
from quirelint.operators.findings import type_counts
from quirelint.plans.audit import audit
from quirelint.plans.rules import configure, parse_rules
from quirelint.sources import files, service, vocabulary

REPORTS = {".html", ".json"}


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quirelint")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("audit")
    a.add_argument("path")
    a.add_argument("--rules", default="rules.md")
    a.add_argument("--glossary")
    a.add_argument("--vocab")
    a.add_argument("--output", help="report.html or report.json; several files are numbered")
    a.add_argument("--format", choices=files.SUPPORTED, help="only files of this extension")
    a.add_argument("--fix", action="store_true", help="write repaired copies as <stem>_fixed")
    a.add_argument("--fix-type", choices=repair.KINDS, action="append")
    a.add_argument("--dictionary", help="words, one a line: turns spelling on")
    a.add_argument("--service-jar", help="starts the grammar service from a jar if none answers")
    a.add_argument("--one-plan", action="store_true", help="all checks in one plan; a check that fails then stops the audit")
    commands.add_parser("doctor")
    return parser.parse_args(argv if argv[:1] and argv[0] in ("audit", "doctor", "-h", "--help") else ["audit", *argv])


def doctor() -> int:
    """Whether what the engine needs is here."""
    checks = {"java": shutil.which("java") is not None, **{m: importlib.util.find_spec(m) is not None for m in ("pyspark", "pyarrow", "pandas", "yaml")}}
    for name, good in checks.items():
        print(f"{'ok     ' if good else 'missing'} {name}")
    return int(not all(checks.values()))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    if args.command == "doctor":
        return doctor()
    output = Path(args.output) if args.output else None
    if output and output.suffix not in REPORTS:
        print(f"unknown kind of report: {output}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("quirelint").getOrCreate()
    found = files.scan(spark, args.path, (args.format,) if args.format else files.SUPPORTED) if Path(args.path).is_dir() else spark.read.format("binaryFile").load(args.path)
    tables = files.from_nested(files.parse(found).persist())
    failed = 0
    for r in tables.errors.toLocalIterator():
        print(f"{r.source_path}: {r.error}", file=sys.stderr)
        failed += 1
    n = tables.documents.count()
    if not n and not failed:
        print("no documents", file=sys.stderr)
        return 1
    rules = parse_rules(Path(args.rules).read_text(encoding="utf-8")) if Path(args.rules).exists() else []
    config = vocabulary.load(args.glossary, args.vocab)
    dictionary = spark.read.text(args.dictionary).toDF("word") if args.dictionary else None
    post = service.choose(configure(rules, config).service_url, args.service_jar)
    out = audit(tables, rules, config, dictionary, post=post, isolate=not args.one_plan, on_progress=lambda name, i, n: print(f"[{i}/{n}] {name}", file=sys.stderr)).persist()
    for r in sinks.summary(out).collect():
        print(f"[{sinks.LABELS[r.severity]}] {r.rule_id or ''} {r.location or ''} {r.message}")
    print(", ".join(f"{r.type}: {r.n}" for r in type_counts(out).orderBy("type").collect()))
    if args.fix:
        for r in repair.patch(found, configure(rules, config), tuple(args.fix_type or repair.KINDS)).where("error is null").toLocalIterator():
            path = Path(r.path.removeprefix("file:"))
            path.with_name(f"{path.stem}_fixed{path.suffix}").write_bytes(bytes(r.content))
    if output:
        reports = sinks.json_reports(tables, out).select("doc_id", "report")
        if output.suffix == ".html":
            rendered = sinks.html_reports(out).withColumnRenamed("report", "page")
            reports = reports.join(rendered, "doc_id", "left").select("doc_id", F.coalesce("page", F.lit(sinks.html_report("审查报告", []))).alias("report"))
        for i, r in enumerate(reports.orderBy("doc_id").toLocalIterator()):  # a report at a time: they go to one folder of this machine
            sinks.write_atomically(sinks.numbered_name(str(output), i, n), r.report)
    return sinks.exit_status(out, failed)


if __name__ == "__main__":
    sys.exit(main())
