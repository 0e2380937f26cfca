"""Rules, de-duplication, text functions against plain loops, sources, reports, repairs, streams."""

import hashlib
import io
import json
import random
import re
import zipfile
from dataclasses import replace

from cases import corpus, page, title
from pyspark.sql import functions as F

from quirelint import repair, sinks
from quirelint.functions import text as tx
from quirelint.model import from_nested
from quirelint.operators import findings, formatting, structure
from quirelint.plans.audit import REGISTRY, audit
from quirelint.plans.rules import Config, configure, items, bounds, parse_rules
from quirelint.sources import files, markdown, ooxml, vocabulary
from quirelint.streaming import audits

RULES = """---
version: 1
---
# 结构规则
## STR-005: t
- 严重度: error
- 检查: duplicate_title
## STR-003: h
- 检查: heading_level_sequential
# 格式规则
## FMT-003: p
- 严重度: info
- 检查: per_page_char_limit
- 最大字数: 5
## FMT-002: s
- 标题: {min: 20, max: 30}
- 正文: 10-18
## FMT-008: c
- 最小对比度: x
# 内容规则
## CON-002: s
- 章节: [概述, "结论"]
## X-1: typo
- 检查: table_contras
# 术语规则
### TERM-001: m
- 模式: "fan-out"
- 建议: "quoted"
- 严重度: strange
"""


def test_rules():
    rules = parse_rules(RULES)
    assert [r.rule_id for r in rules] == ["STR-005", "STR-003", "FMT-003", "FMT-002", "FMT-008", "CON-002", "X-1", "TERM-001"]
    assert rules[-1].params == {"pattern": "fan-out", "suggestion": '"quoted"'} and rules[-1].category == "terminology"
    c = configure(rules)
    assert (c.max_chars_per_page, c.title_size_range, c.body_size_range, c.min_contrast, c.required_sections) == (5, (20, 30), (10, 18), 4.5, ("概述", "结论"))
    assert items("[]") == [] and bounds("nonsense") is None and bounds("12–22") == (12, 22)
    assert len(REGISTRY) == 19


def test_audit(spark):
    t = corpus(spark, {"a": ("md", page(title("T"), "fan-out text"), page(title("t"))), "b": ("pptx", page("概述 结论"))})
    rows = audit(t, parse_rules(RULES)).collect()
    got = sorted((r.doc_id, r.rule_id, r.severity) for r in rows)
    assert got == sorted([("a", "STR-005", "error"), ("a", "FMT-003", "info"), ("a", "CON-002", "error"), ("a", "TERM-001", "info"), ("a", "SYS-ERROR", "error"), ("b", "SYS-ERROR", "error")])


def test_deduplication(spark):
    rng = random.Random(2)
    rows = [(str(rng.randint(0, 3)), rng.choice("ab"), rng.choice(["error", "warning", "info"]), rng.choice(["R", None]), rng.choice([0, None]), rng.choice(["x" * 130, "x" * 125 + "y", None, "é"]), [i]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id string, type string, severity string, rule_id string, page_index int, context string, seq array<int>")
    rank, best, order = {"error": 3, "warning": 2, "info": 1}, {}, {}
    for r in rows:
        digest = int.from_bytes(hashlib.md5((r[5] or "")[:120].encode()).digest()[:4], "little")
        key = (r[0], f"{r[1]}|{r[3] or ''}|{-1 if r[4] is None else r[4]}|{digest:08x}")
        order.setdefault(key, r[6])
        if key not in best or rank[r[2]] > rank[best[key][2]]:
            best[key] = r
    got = {(r.doc_id, r.dedup_key): (r.severity, list(r.seq), list(r.place)) for r in findings.deduplicate(df).collect()}
    assert got == {k: (v[2], v[6], order[k]) for k, v in best.items()}


def test_positions_and_parentheses(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab（()）😀中 A1", k=rng.randint(0, 40))) for _ in range(300)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", tx.matches("t", "[A1]+|中").alias("m"), tx.parenthesis_ranges("t").alias("p"), tx.language_segments("t").alias("s"), tx.strip("t").alias("x")).collect()
    for r in rows:
        if r.t is None:
            assert r.m is None
            continue
        assert [(x.start, x.m) for x in r.m] == [(m.start(), m[0]) for m in re.finditer("[A1]+|中", r.t)]
        pairs, last = [], -1
        closes = [i for i, c in enumerate(r.t) if c in "）)"]
        for i, c in enumerate(r.t):
            if c in "（(":
                j = next((k for k in closes if k > i and k > last), None)
                if j is not None:
                    pairs.append((i, j))
                    last = j
        assert [(x.a, x.b) for x in r.p] == pairs and r.x == r.t.strip()


def test_windows_against_loops(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.randint(1, 5)) for g in range(60) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "g int, i int, n int")
    want = []
    for g in range(60):
        prev, seen = None, set()
        for _, i, n in [r for r in rows if r[0] == g]:
            if n in seen:
                want.append((g, i, "repeated"))
            elif prev is not None and n != prev + 1:
                want.append((g, i, "skipped" if n > prev + 1 else "back"))
            seen.add(n)
            prev = n
    assert sorted((r.g, r.i, r.fault) for r in structure.sequence_faults(df, ["g"], ["i"]).collect()) == want
    places = [(g, i, rng.uniform(0, 60), rng.choice([None, rng.uniform(0, 100)])) for g in range(40) for i in range(8)]
    df = spark.createDataFrame(places, "g int, i int, left double, top double")
    want = []
    for g in range(40):
        cluster: list = []
        for r in [*sorted((r for r in places if r[0] == g), key=lambda r: (r[2], r[1])), (g, -1, 1e9, None)]:
            if cluster and r[2] - cluster[-1][2] > 5:
                tops = [x[3] for x in cluster if x[3] is not None]
                want += [(g, x[1]) for x in cluster if x[3] is not None and len(tops) > 1 and abs(x[3] - sum(tops) / len(tops)) > 10]
                cluster = []
            cluster.append(r)
    assert sorted((r.g, r.i) for r in formatting.alignment_outliers(df, ["g"], ["i"]).collect()) == sorted(want)


def test_markdown():
    row = markdown.parse("d/x.md", "---\ntitle: T\nauthor: me\n---\n# 概述\n\nTSV text\n\n| A | B |\n|---|---|\n| 1 | - |\n\n- a | b\n\n## 结论\nend\n```\n# code\n```\n".encode())
    assert (row["title"], row["author"], row["page_count"]) == ("T", "me", 3)
    first = row["pages"][0]["elements"]
    assert [e["type"] for e in first] == ["text_frame", "text_frame", "table", "text_frame"] and first[0]["is_title"]
    assert [(c["row"], c["col"], c["text"]) for c in first[2]["cells"]] == [(0, 0, "A"), (0, 1, "B"), (1, 0, "1"), (1, 1, "-")]
    assert markdown.decode("中文a".encode("gbk")) == "中文a" and markdown.frontmatter("---\n# only\n---\nx") == ({}, "x") and markdown.frontmatter("---\ntext\n---\nx")[0] == {}
    assert markdown.parse("e.txt", b"")["pages"][0]["elements"][0]["paragraphs"][0]["text"] == ""


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rels(**targets: str) -> str:
    items = "".join(f'<Relationship Id="{i}" Type="{REL}/{t.split("|")[0]}" Target="{t.split("|")[1]}"/>' for i, t in targets.items())
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{items}</Relationships>'


def deck() -> bytes:
    ns = f'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="{REL}"'
    sp = lambda name, ph, x, text, rpr="": f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="{name}"/><p:cNvSpPr/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="0"/><a:ext cx="1270000" cy="635000"/></a:xfrm></p:spPr><p:txBody><a:bodyPr/><a:p><a:r>{rpr}<a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    body = sp("Title 1", '<p:ph type="title"/>', 0, "标题。") + sp("Box", "", 12000000, "- 用FinFET", '<a:rPr sz="800"><a:solidFill><a:srgbClr val="ff0000"/></a:solidFill><a:latin typeface="Comic"/></a:rPr>')
    group = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="9" name="G"/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="1" cy="1"/></a:xfrm></p:grpSpPr>{sp("In", "", 0, "child")}</p:grpSp>'
    tbl = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="4" name="T"/></p:nvGraphicFramePr><p:xfrm><a:off x="0" y="0"/><a:ext cx="10" cy="10"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>c1</a:t></a:r></a:p></a:txBody><a:tcPr><a:solidFill><a:srgbClr val="00FF00"/></a:solidFill></a:tcPr></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    return package({
        "_rels/.rels": rels(a="officeDocument|ppt/presentation.xml"), "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="s1"/></p:sldIdLst><p:sldSz cx="12192000" cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(s1="slide|slides/slide1.xml"), "ppt/slides/slide1.xml": f'<p:sld {ns}><p:cSld><p:spTree><p:nvGrpSpPr/><p:grpSpPr/>{body}{group}{tbl}</p:spTree></p:cSld></p:sld>',
        "ppt/slides/_rels/slide1.xml.rels": rels(l="slideLayout|../slideLayouts/l.xml"), "ppt/slideLayouts/l.xml": f'<p:sldLayout {ns}><p:cSld name="标题幻灯片"/></p:sldLayout>',
    })


def letter() -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, text, rpr="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:rPr>{rpr}</w:rPr><w:t>{text}</w:t></w:r></w:p>'
    body = p("H1", "One") + p("N", "text", '<w:rFonts w:ascii="Comic"/><w:sz w:val="16"/>') + p("H3", "Deep") + p("H1", "Two") + '<w:tbl><w:tr><w:tc><w:tcPr><w:shd w:fill="abcdef"/></w:tcPr><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>'
    style = lambda i, name: f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{name}"/></w:style>'
    return package({"_rels/.rels": rels(a="officeDocument|word/document.xml"), "word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels(s="styles|styles.xml", f="footnotes|footnotes.xml"), "word/styles.xml": f"<w:styles {ns}>{style('H1', 'heading 1')}{style('H3', 'heading 3')}{style('N', 'Normal')}</w:styles>"})


def test_packages():
    row = ooxml.parse_pptx("a.pptx", deck())
    (slide,) = row["pages"]
    assert slide["layout_name"] == "标题幻灯片" and row["custom_properties"] == {"slide_width": 960.0, "slide_height": 540.0}
    assert [(e["type"], e["flat_idx"], e["parent_idx"], e["depth"]) for e in slide["elements"]] == [("text_frame", 0, None, 0), ("text_frame", 1, None, 0), ("group", 2, None, 0), ("text_frame", 3, 2, 1), ("table", 4, None, 0)]
    assert slide["elements"][0]["is_title"] and slide["elements"][1]["paragraphs"][0]["runs"][0]["font_size"] == 8.0 and slide["elements"][4]["cells"][0]["fill_color"] == "00FF00"
    row = ooxml.parse_docx("a.docx", letter())
    assert [[e["type"] for e in p["elements"]] for p in row["pages"]] == [["text_frame"] * 3, ["text_frame", "table"]]
    assert [e["paragraphs"][0]["level"] for e in row["pages"][0]["elements"]] == [0, None, 2] and row["pages"][0]["elements"][0]["is_title"] and row["warnings"] == ["footnotes are not read"]


def test_folder_to_report(spark, tmp_path):
    for name, data in {"a.pptx": deck(), "b.DOCX": letter(), "c.md": b"# T\n\n" + b"x" * 300, "d.pdf": b"%PDF", "e.docx": b"broken", "skip.bin": b""}.items():
        (tmp_path / name).write_bytes(data)
    t = files.read(spark, str(tmp_path))
    assert sorted(r.source_path.rsplit("/", 1)[-1] for r in t.errors.collect()) == ["d.pdf", "e.docx"]
    rules = parse_rules("# 格式规则\n## FMT-005: o\n- 严重度: error\n- 检查: element_overflow\n## FMT-003: p\n- 严重度: warning\n- 检查: per_page_char_limit\n")
    out = audit(t, rules).cache()
    names = {(r.doc_id.rsplit("/", 1)[-1], r.rule_id) for r in out.collect()}
    assert {("a.pptx", "FMT-005"), ("a.pptx", "FMT-001"), ("c.md", "FMT-003"), ("b.DOCX", "FMT-002")} <= names
    reports = {r.doc_id.rsplit("/", 1)[-1]: json.loads(r.report) for r in sinks.json_reports(t, out).collect()}
    assert set(reports) == {"a.pptx", "b.DOCX", "c.md"} and reports["c.md"]["summary"]["warnings"] >= 1 and reports["a.pptx"]["document"]["slide_count"] == 1
    assert sinks.exit_status(out) == 1 and sinks.summary(out).count() >= 3
    page_ = sinks.html_report("<b>", [r.asDict() for r in out.where("rule_id = 'FMT-001'").collect()], 3, "a&b")
    assert "<b> " not in page_ and "&lt;b&gt;" in page_ and "a&amp;b" in page_ and "3 页" in page_
    sinks.write_atomically(str(tmp_path / "r.html"), page_)
    assert (tmp_path / "r.html").read_text() == page_ and sinks.numbered_name("o.html", 1, 3) == "o_02.html"
    plan = {(r.doc_id.rsplit("/", 1)[-1], r.new_font, r.new_size, r.new_text) for r in repair.run_fixes(t, Config()).collect()}
    assert plan == {("a.pptx", None, None, "标题"), ("a.pptx", "微软雅黑", 12.0, "• 用 FinFET"), ("b.DOCX", "微软雅黑", 12.0, "text")}
    assert [(r.new_left, r.new_top) for r in repair.moves(t).collect()] == [(860.0, 0.0)]


def test_repair_files(spark):
    c = Config()
    new, count = repair.patch_file("a.pptx", deck(), c)
    row = ooxml.parse_pptx("a.pptx", new)
    title_, box = row["pages"][0]["elements"][:2]
    assert title_["paragraphs"][0]["text"] == "标题" and box["paragraphs"][0]["text"] == "• 用 FinFET" and box["left"] == 860.0
    run = box["paragraphs"][0]["runs"][0]
    assert (run["font_name"], run["font_name_east_asia"], run["font_size"]) == ("微软雅黑", "微软雅黑", 12.0) and count == 6
    assert repair.patch_file("a.pptx", new, c)[1] == 0
    new, count = repair.patch_file("a.docx", letter(), c)
    assert count == 3 and ooxml.parse_docx("a.docx", new)["pages"][0]["elements"][1]["paragraphs"][0]["runs"][0]["font_size"] == 12.0
    df = spark.createDataFrame([("a.pptx", bytearray(deck())), ("x.md", bytearray(b"x"))], "path string, content binary")
    assert sorted((r.path, r.fixes, r.error is None) for r in repair.patch(df, c).collect()) == [("a.pptx", 6, True), ("x.md", 0, False)]


def test_vocabulary(tmp_path):
    (tmp_path / "reject.txt").write_bytes("# c\n利用 # 正式\nkind of\nv[0-9]+ # r\n".encode("gbk"))
    (tmp_path / "accept.txt").write_text("FinFET\n\n# x\n")
    (tmp_path / "bad.yaml").write_text("a: [")
    (tmp_path / "g.yaml").write_text("category: k\nterms:\n  - {pattern: through.silicon.via, preferred: 'Through Silicon Via (TSV)'}\n")
    c = vocabulary.load(str(tmp_path), str(tmp_path))
    assert c.accepted == ("finfet",) and [x[0] for x in c.rejected] == ["利用", "kind of", "v[0-9]+"] and c.rejected[1][2] == vocabulary.DEFAULT_REASON
    assert c.glossary[0]["near"] == r"(?dUiu)\bTSV\b"


def test_filters(spark):
    rows = [("d", "k1", "error", "format", "A", 0), ("d", "k2", "info", "format", "A", 0), ("d", "k3", "warning", "language", None, None), ("d", "k4", "error", "format", "B", 1)]
    df = spark.createDataFrame(rows, "doc_id string, dedup_key string, severity string, type string, rule_id string, page_index int")
    keys = lambda x: sorted(r.dedup_key for r in x.collect())
    assert keys(findings.filtered(df)) == ["k1", "k3", "k4"] and keys(findings.filtered(df, without_rules=["A"])) == ["k3", "k4"]
    assert keys(findings.filtered(df, without_pages=[2], types=["format"])) == ["k1"] and keys(findings.filtered(df, exempt=spark.createDataFrame([("d", "k1")], "doc_id string, dedup_key string"))) == ["k3", "k4"]
    assert findings.pivot(df).first().asDict() == {"doc_id": "d", "error": 2, "warning": 1, "info": 1}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n\n" + "y" * 300)
    seen = []
    rules = parse_rules("# 格式规则\n## FMT-003: p\n- 严重度: warning\n- 检查: per_page_char_limit\n")
    writer = audits.audited(audits.new_files(spark, str(tmp_path / "in")), rules, None, lambda df, n: seen.extend(r.rule_id for r in df.collect()))
    writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(seen) == ["FMT-003", "FMT-004"]


def test_from_nested_is_empty_without_files(spark):
    from quirelint.model import NESTED

    t = from_nested(spark.createDataFrame([], NESTED))
    assert audit(t, parse_rules(RULES)).count() == 0 and replace(Config(), max_font_types=1).max_font_types == 1
    assert t.page_text.select(F.col("all_text")).count() == 0


def test_service(spark):
    import pytest

    from quirelint.sources import service

    t = corpus(spark, {"d": ("md", page("teh text and FinFET 中文中文的的"))})

    def post(text: str, language: str) -> list[dict]:
        hit = lambda w, issue, category="C": [{"message": "m", "offset": text.find(w), "rule": {"id": "R", "issueType": issue, "category": {"id": category}}, "replacements": [{"value": "the"}] * 4, "context": {"text": text, "offset": text.find(w), "length": len(w)}}] if w in text else []
        return hit("teh", "misspelling") + hit("FinFET", "grammar") + hit("text", "style", "TYPOGRAPHY") + hit("的的", "other")

    rows = service.service_findings(t, replace(Config(), accepted=("finfet",)), post).collect()
    assert sorted((r.rule_id, r.severity, r.suggestion, json.loads(r.metadata)["language"]) for r in rows) == [("R", "error", "建议改为: the / the / the", "en"), ("R", "warning", "建议改为: the / the / the", "zh")]
    with pytest.raises(ValueError, match="this machine"):
        service.http_post("http://example.org/v2")

    def fails(text: str, language: str) -> list[dict]:
        if text.startswith("b"):
            raise OSError
        return [{"offset": 1}]

    assert [m["offset"] for m in service.matches("a" * service.CHUNK * 2 + "b" * service.CHUNK * 2, "en-US", fails)] == [1, service.CHUNK + 1]


def test_command_line(spark, tmp_path, capsys):
    from quirelint import cli

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pptx").write_bytes(deck())
    (folder / "b.md").write_text("# T\n\ntext")
    (tmp_path / "rules.md").write_text("# 格式规则\n## FMT-005: o\n- 严重度: error\n- 检查: element_overflow\n", encoding="utf-8")
    common = ["--rules", str(tmp_path / "rules.md")]
    assert cli.main([str(folder), *common, "--output", str(tmp_path / "r.html"), "--fix"], spark) == 1
    assert (tmp_path / "r_01.html").exists() and (tmp_path / "r_02.html").exists() and "FMT-005" in capsys.readouterr().out
    assert ooxml.parse_pptx("x", (folder / "a_fixed.pptx").read_bytes())["pages"][0]["elements"][1]["left"] == 860.0
    assert cli.main(["audit", str(folder / "b.md"), *common, "--output", str(tmp_path / "r.json")], spark) == 0
    assert json.loads((tmp_path / "r.json").read_text())["document"]["title"] == "b"
    assert cli.main([str(folder), "--output", "r.txt"], spark) == 2 and cli.main([str(folder), "--format", "docx"], spark) == 1
