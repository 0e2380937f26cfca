"""Language tiers, failing checks, PDF files, reports read back, exempt lists, streams without repeats."""

import http.server
import json
import sys
import threading
import types
from dataclasses import replace
from datetime import datetime
from pathlib import Path

import pytest
from cases import corpus, page
from pyspark.sql import functions as F

from quirelint import sinks
from quirelint.operators import findings, formatting
from quirelint.plans import audit as plans
from quirelint.plans.rules import Config, parse_rules
from quirelint.sources import files, pdf, service
from quirelint.streaming import audits

RULES = "# 格式规则\n## FMT-003: p\n- 检查: per_page_char_limit\n"


def test_grammar_without_a_dictionary(spark):
    t = corpus(spark, {"d": ("md", page("我们认真的的工作一二三四五六七八九十一二三四五六七八九十很快的完成"))})
    found = plans.audit(t, []).where("rule_id = 'PY-ZH-GRAMMAR'").collect()
    assert {r.message for r in found} >= {"重复用词: '的的'", "应为 '很快地' (副词用'地')"}
    words = spark.createDataFrame([("work",)], "word string")
    t = corpus(spark, {"d": ("md", page("wrok work"))})
    assert [r.suggestion for r in plans.audit(t, [], dictionary=words).where("rule_id = 'PY-SPELL'").collect()] == ["建议改为: work"]


class _Service(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(200)
        self.end_headers()

    def do_POST(self):
        self.rfile.read(int(self.headers["Content-Length"]))
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"matches": [{"offset": 0, "message": "m", "rule": {"id": "R-9", "issueType": "style", "category": {"id": "C"}}}]}).encode())

    def log_message(self, *args):
        pass


def test_service_tier(spark):
    server = http.server.ThreadingHTTPServer(("localhost", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://localhost:{server.server_port}/v2"
        post = service.choose(url)
        t = corpus(spark, {"d": ("md", page("an English text 中文中文的的"))})
        rules = {r.rule_id for r in plans.audit(t, [], post=post).collect()}
        assert "R-9" in rules and "PY-ZH-GRAMMAR" not in rules
    finally:
        server.shutdown()
    server.server_close()
    assert service.choose(url) is None and not service.available(url)
    with pytest.raises(ValueError, match="this machine"):
        service.choose("http://example.org/v2")


def test_a_check_that_fails_while_it_runs(spark, monkeypatch):
    def broken(t, c):
        return findings.findings(t.documents, "format", "error", "X", F.raise_error(F.lit("no disk")).cast("string"))

    monkeypatch.setitem(plans.REGISTRY, "broken", plans.Entry(broken))
    t = corpus(spark, {"d": ("md", page("x" * 300))})
    told = []
    rules = parse_rules(RULES + "## X-1: x\n- 检查: broken\n")
    got = plans.audit(t, rules, isolate=True, on_progress=lambda *x: told.append(x)).collect()
    assert {r.rule_id for r in got} >= {"FMT-003", "SYS-ERROR"}
    (error,) = [r for r in got if r.rule_id == "SYS-ERROR"]
    assert "X-1" in error.message and "no disk" in error.metadata
    assert [i for _, i, _ in told] == list(range(len(told))) and told[-1][0] == "完成" and told[-1][1] == told[-1][2] == len(told) - 1


def test_registry(spark, monkeypatch):
    t = corpus(spark, {"d": ("md", page("x"))})
    assert plans.check_registry(t) == []
    monkeypatch.setitem(plans.REGISTRY, "bad", plans.Entry(lambda t, c: t.documents))
    monkeypatch.setitem(plans.REGISTRY, "worse", plans.Entry(lambda t: t))
    assert [x.split(":")[0] for x in plans.check_registry(t)] == ["bad", "worse"]


def test_a_filter_on_rules_reaches_the_checks(spark):
    t = corpus(spark, {"d": ("md", page("x" * 300))})
    out = plans.audit(t, parse_rules(RULES))
    whole, one = (df._jdf.queryExecution().optimizedPlan().toString().count("Union") + df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") for df in (out, out.where("rule_id = 'FMT-003'")))
    assert one < whole and out.where("rule_id = 'FMT-003'").count() == 1


def item(text, page_no=None, label=None, **more):
    on = [page_no] if isinstance(page_no, int) else page_no or []
    return types.SimpleNamespace(text=text, prov=[types.SimpleNamespace(page_no=n) for n in on], label=label, **more)


def test_pdf(spark, monkeypatch):
    row = files.parse(spark.createDataFrame([("a.pdf", bytearray(b"%PDF"))], "path string, content binary")).first()
    assert "docling" in row.error
    cells = [types.SimpleNamespace(row=1, col=0, text=" b "), types.SimpleNamespace(row=0, col=0, text="a")]
    doc = types.SimpleNamespace(
        pages={1: types.SimpleNamespace(size=1), 2: types.SimpleNamespace(size=1)},
        texts=[item("Title", 1, types.SimpleNamespace(value="title")), item(" both ", [1, 2]), item("loose"), item("  ", 2), item("Part", 2, "section_header")],
        tables=[types.SimpleNamespace(cells=cells, prov=[types.SimpleNamespace(page_no=2)])],
    )
    monkeypatch.setattr(pdf, "analyse", lambda source, data: doc)
    row = pdf.parse("x/a.pdf", b"")
    texts = [[(e["type"], [(p["text"], p["level"]) for p in e["paragraphs"]], e["is_title"]) for e in p["elements"]] for p in row["pages"]]
    frame = "text_frame"
    assert texts == [[(frame, [("Title", 1)], True), (frame, [("both", None)], False), (frame, [("loose", None)], False)], [(frame, [("both", None)], False), (frame, [("Part", 2)], False), ("table", [], False)]]
    assert [(c["row"], c["text"]) for c in row["pages"][1]["elements"][2]["cells"]] == [(0, "a"), (1, "b")] and row["title"] == "a" and row["page_count"] == 2
    old = types.SimpleNamespace(pages={3: types.SimpleNamespace(cells=[item("c")]), 1: types.SimpleNamespace(items=[item("i", heading_level=2)], tables=[types.SimpleNamespace(export_to_dataframe=lambda: __import__("pandas").DataFrame({"h": ["v", None]}))])})
    assert [[e["type"] for e in p] for p in pdf.pages_of(old)] == [[frame, "table"], [frame]]
    none = types.SimpleNamespace(pages={}, export_to_markdown=lambda: "one\n\n---\n\ntwo")
    assert [p[0]["paragraphs"][0]["text"] for p in pdf.pages_of(none)] == ["one", "two"]


def test_docling_is_called(monkeypatch):
    base, converter = types.ModuleType("docling.datamodel.base_models"), types.ModuleType("docling.document_converter")
    base.DocumentStream = lambda name, stream: (name, stream.read())
    converter.DocumentConverter = lambda: types.SimpleNamespace(convert=lambda x: types.SimpleNamespace(document=x))
    for name, module in (("docling", types.ModuleType("docling")), ("docling.datamodel", types.ModuleType("docling.datamodel")), ("docling.datamodel.base_models", base), ("docling.document_converter", converter)):
        monkeypatch.setitem(sys.modules, name, module)
    assert pdf.analyse("p/a.pdf", b"x") == ("a.pdf", b"x")


def test_reports(spark, tmp_path):
    t = corpus(spark, {"d<1>": ("md", page("x" * 300)), "e": ("md", page("short"))})
    out = findings.deduplicate(findings.union([formatting.page_char_limit(t, Config())]))
    sinks.write_json(sinks.json_reports(t, out), str(tmp_path / "r"))
    documents, items = sinks.read_json(spark.read.text(str(tmp_path / "r")).withColumnRenamed("value", "report"))
    assert {(r.source_file, r.total_findings) for r in documents.collect()} == {("d<1>.md", 1), ("e.md", 0)}
    (found,) = items.collect()
    first = out.first()
    assert (found.rule_id, found.message, found.severity, found.page_index) == (first.rule_id, first.message, first.severity, 0)
    back = items.select(F.regexp_replace("source_file", "[.]md$", "").alias("doc_id"), "type", "severity", "message", "rule_id", "page_index", "context", "suggestion", "location")
    assert findings.same(out, back).isEmpty() and findings.same(out, back.limit(0)).count() == 1
    (page_,) = sinks.html_reports(out).collect()
    assert page_.doc_id == "d<1>" and "d&lt;1&gt;" in page_.report and "FMT-003" in page_.report
    totals = findings.batch_totals(t.pages, out).first()
    assert (totals.documents, totals.pages, totals.total) == (2, 2, 1)


def test_exempt_lists(spark):
    t = corpus(spark, {d: ("md", page("x" * 300)) for d in "abc"})
    out = findings.deduplicate(findings.union([formatting.page_char_limit(t, Config()).withColumn("severity", F.lit("error"))]))
    exempt = findings.exempted(out.where("doc_id = 'a'"), out.where("doc_id < 'c'"))
    assert exempt.count() == 2 and [r.doc_id for r in findings.filtered(out, exempt=exempt).collect()] == ["c"]


def test_findings_seen_once(spark, tmp_path):
    schema = "doc_id string, dedup_key string, at timestamp"
    rows = [("a", "k", datetime(2024, 1, 1, 1)), ("a", "k", datetime(2024, 1, 1, 2)), ("b", "k", datetime(2024, 1, 1, 2)), ("a", "j", datetime(2024, 1, 1, 3))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    once = audits.first_seen(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "at")
    query = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.doc_id, r.dedup_key) for r in spark.table("once").collect()) == [("a", "j"), ("a", "k"), ("b", "k")]


def test_command_line_with_a_dictionary(spark, tmp_path, capsys):
    from quirelint import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.md").write_text("# Title\n\nwrok here")
    (tmp_path / "words").write_text("work\nhere\nTitle\n")
    assert cli.main([str(tmp_path / "in"), "--rules", "none", "--dictionary", str(tmp_path / "words")], spark) == 1
    said = capsys.readouterr()
    assert "PY-SPELL" in said.out and "[0/" in said.err


SAMPLE = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SAMPLE.is_dir(), reason="no sample tables")
@pytest.mark.parametrize("name", "con001_numeric_consistency con003_definitions con003c_used_before_defined fmt_mixed_contexts fmt001_page_fonts fix_runs glossary_near parenthesis_pairs py_spell py_zh_grammar source_markdown str002_figure_numbering str007_caption_format term_outside_brackets".split())
def test_built_queries(spark, name):
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in SAMPLE.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, str(SAMPLE))
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    got = sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    assert got and got == sorted(map(str, con.sql(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()))


def test_text_marks_are_kept(spark):
    from quirelint.functions import text as tx

    rows = spark.createDataFrame([("a\x01b12\x02c3",), ("﷐7﷑",)], "t string")
    assert [[tuple(x) for x in r.m] for r in rows.select(tx.matches("t", r"\d+").alias("m")).collect()] == [[(3, "12"), (7, "3")], [(1, "7")]]
    assert replace(Config(), accepted=("x",)).accepted == ("x",)
