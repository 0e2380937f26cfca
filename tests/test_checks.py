"""Each check on documents that should and shouldn't set it off."""

from dataclasses import replace

import pytest
from cases import corpus, frame, page, table, title

from quirelint.operators import factual, formatting, language, patterns, structure
from quirelint.plans.rules import Config, Rule
from quirelint.sources.vocabulary import glossary, rejected

C = Config()


def fired(df) -> list[str]:
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def text(*pages: str, kind: str = "md") -> tuple:
    return (kind, *(page(p) for p in pages))


def test_titles(spark):
    t = corpus(spark, {
        "same": ("pptx", page(title("重复标题")), page(title("重复标题 "))), "differ": ("pptx", page(title("A")), page(title("B"))), "mark": ("md", page(title("标题。"))), "plain": ("md", page(title("标题"))),
        "long": ("md", page(title(" ".join(["word"] * 11)))), "zh": ("md", page(title("字" * 41))), "short": ("md", page(title("it's " * 10))), "named": ("md", page(frame("x " * 12 + ".", shape_name="Title 1"))),
    })
    rows = structure.duplicate_titles(t, C).collect()
    assert [(r.doc_id, r.page_index, r.location) for r in rows] == [("same", 0, "第 1 页, 第 2 页")]
    assert fired(structure.title_punctuation(t, C)) == ["mark", "named"]
    assert fired(structure.title_length(t, C)) == ["long", "named", "zh"]


def test_numbering(spark):
    t = corpus(spark, {
        "back": text("参见图3 与图1 的对比"), "skip": text("如图1 所示", "如图3 所示"), "chapter": text("图1-1 和图1-2 和图2-1 和"), "good": text("Fig. 1 and Figure 2", "fig 3, Table 1 and table 2"), "twice": text("图1 图2 图2"), "one": text("图7"),
        "forms": text("图1：a\nFig. 1: b"), "blank": text("Fig. 1: a\nFig.2: b"),
    })
    rows = {r.doc_id: r.message for r in structure.figure_numbering(t, C).collect()}
    assert "倒退" in rows["back"] and "不连续" in rows["skip"] and "重复" in rows["twice"]
    assert set(rows) == {"back", "skip", "twice", "forms"}
    (r,) = structure.caption_format(t, C).collect()
    assert r.doc_id == "forms" and "2 种" in r.message


@pytest.mark.parametrize(("levels", "jumps"), [([2, 3], 0), ([1, 3], 1), ([1, 2, 3], 0), ([2, 4], 1)])
def test_headings(spark, levels, jumps):
    t = corpus(spark, {"d": ("md", page(*(frame("h", levels=[v]) for v in levels))), "s": ("pptx", page(frame("a", "b", levels=[0, 2])))})
    assert fired(structure.heading_levels(t, C)) == ["d"] * jumps


def test_layouts(spark):
    t = corpus(spark, {
        "one": ("pptx", page("a", layout_name="内容页"), page("b", layout_name="内容页")), "two": ("pptx", page("a", layout_name="标题页"), page("b", layout_name="内容页")), "none": ("pptx", page("a")),
        "covers": ("pptx", page("a", layout_name="标题幻灯片"), page("b", layout_name="标题幻灯片")), "large": ("pptx", page(frame("Big", runs={0: [{"text": "Big", "font_size": 30.0}]}))),
    })
    assert fired(structure.layout_variety(t, C)) == ["covers", "one"]
    assert fired(structure.title_slide(t, C)) == ["none", "one"]
    assert fired(formatting.title_layouts(t, C)) == ["covers"]


def test_conclusions(spark):
    t = corpus(spark, {
        "empty": ("pptx", page()), "word": ("pptx", page("结论：测试完成")), "three": ("pptx", page(frame("a", "b", "c"))), "notes": ("pptx", page("a", notes="said")), "cover": ("pptx", page("a", layout_name="My COVER page")), "bad": ("pptx", page("a")), "md": ("md", page("a")),
    })
    rows = {r.doc_id: r.context for r in structure.conclusions(t, C).collect()}
    assert rows == {"empty": "(空白页)", "bad": "a"}


def test_sections(spark):
    t = corpus(spark, {"no": text("正文内容"), "yes": text("这是概述部分"), "none": ("md",)})
    assert fired(structure.required_sections(t, replace(C, required_sections=("概述",)))) == ["no", "none"]
    assert fired(structure.required_sections(t, C)) == []


def test_fonts(spark):
    run = lambda **k: {"text": "sample", **k}
    t = corpus(spark, {
        "ok": ("pptx", page(frame("x", runs={0: [run(font_name="Arial", font_size=14.0)]}))),
        "bad": ("pptx", page(frame("x", runs={0: [run(font_name="Comic", font_size=8.0), run(font_name="Comic"), run(font_name="Arial", font_name_east_asia="宋体")]}))),
        "many": ("pptx", page(frame("x", runs={0: [run(font_name=f) for f in ("Arial", "Calibri", "Noto Sans SC", "微软雅黑")]}))),
        "title": ("pptx", page(frame("x", is_title=True, runs={0: [run(font_size=20.0), run(font_size=44.0), run(font_size=28.0)]}))),
    })
    rows = sorted((r.doc_id, r.message, r.context) for r in formatting.page_fonts(t, C).collect())
    assert rows == [("bad", "使用了非标准中文（eastAsia）字体「宋体」(1 处)", '"sample"'), ("bad", "使用了非标准西文（latin）字体「Comic」(2 处)", '"sample | sample"')]
    (r,) = formatting.document_fonts(t, C).collect()
    assert r.doc_id == "many" and r.suggestion == "最常用的字体: Arial(西文)(1次), Calibri(西文)(1次), Noto Sans SC(西文)(1次)"
    sizes = sorted((r.doc_id, r.message) for r in formatting.font_sizes(t, C).collect())
    assert sizes == [("bad", "正文字号偏小: 8.0pt（建议 ≥ 12pt）"), ("title", "标题字号过大: 44.0pt（建议 28-40pt）"), ("title", "标题字号过小: 20.0pt（建议 28-40pt）")]


def test_lengths(spark):
    t = corpus(spark, {"page": text("测" * 250), "cells": ("md", page(table({"text": "x" * 150}, {"text": "y" * 60}), notes="n" * 500)), "short": text("测"), "zh": text("中" * 160), "lines": text("a\nb\nc\nd"), "digits": text("1" * 300), "en": text("e" * 300)})
    assert fired(formatting.page_char_limit(t, C)) == ["cells", "digits", "en", "page"]
    rows = {r.doc_id: r.message for r in formatting.paragraph_length(t, C).collect()}
    assert set(rows) == {"page", "zh", "lines", "en"} and rows["lines"].endswith("显式换行 3 行 (上限 3)")


def test_positions(spark):
    at = lambda left, top, w=100.0, h=50.0: frame("x", left=left, top=top, width=w, height=h)
    t = corpus(spark, {
        "out": ("pptx", page(at(1000.0, 100.0))), "in": ("pptx", page(at(100.0, 100.0))), "edge": ("pptx", page(at(-5.0, 495.0))), "unknown": ("pptx", page(at(2000.0, 0.0, None, None))),
        "column": ("pptx", page(at(100.0, 10.0), at(104.0, 11.0), at(108.0, 90.0), at(300.0, 0.0))),
    })
    (r,) = formatting.element_overflow(t, C).collect()
    assert (r.doc_id, r.message) == ("out", "元素超出页面边界: right=1100pt > 960pt")
    assert len(fired(formatting.alignment(t, C))) == 3


def test_slides_only(spark):
    t = corpus(spark, {
        "empty": ("pptx", page(frame("", is_placeholder=True, is_title=True))), "filled": ("pptx", page(frame("有内容", is_placeholder=True))), "nothing": ("pptx", page(frame(is_placeholder=True))), "mixed": ("md", page(frame("• 第一项", "1. 第二项"))), "same": ("md", page(frame("• a", "• b"))),
    })
    assert sorted((r.doc_id, r.message[5:7]) for r in formatting.empty_placeholders(t, C).collect()) == [("empty", "标题"), ("nothing", "通用")]
    (r,) = formatting.bullet_consistency(t, C).collect()
    assert r.message == "该页混用了多种项目符号样式: 数字(1. 2.), 符号(•-*)" and r.context == "1. 第二项 | • 第一项"


def test_contrast(spark):
    cell = lambda fill, font, size=None, text="same": {"text": text, "fill_color": fill, "font_color": font, "font_size": size}
    t = corpus(spark, {
        "equal": ("pptx", page(table(cell("1E3A5F", "#1e3a5f")))), "large": ("pptx", page(table(cell("808080", "FFFFFF", 18.0)))), "small": ("pptx", page(table(cell("808080", "FFFFFF", 12.0)))), "two": ("pptx", page(table(cell("111111", "111111"), cell("111111", "111111")))),
        "odd": ("pptx", page(table(cell("red", "FFFFFF"), cell(None, "FFFFFF"), cell("000000", "000000", text=" ")))),
    })
    rows = sorted((r.doc_id, r.message, r.context) for r in formatting.table_contrast(t, C).collect())
    assert rows[0] == ("equal", "表格单元格文字与底色对比度不足: 1.0:1 (阈值 4.5:1)", "[1行 1列] same")
    assert [r[0] for r in rows] == ["equal", "small", "two", "two"]


def test_numbers(spark):
    t = corpus(spark, {
        "differ": text("成品良率 95.3%", "成品良率 95.4%"), "equal": text("成品良率 95.3%", "成品良率 95.3%"), "pages": text("Page 1", "Page 2"), "back": text("x 12.5abc"), "minutes": text("waits 5 minutes"),
    })
    assert fired(factual.numeric_consistency(t, C)) == ["differ"]
    found = {r.doc_id: r.match for r in factual.numbers(t).where("doc_id in ('back', 'minutes', 'pages')").collect()}
    assert found == {"back": "12", "minutes": "5"}


def test_abbreviations(spark):
    t = corpus(spark, {
        "a": text("TSV (Through Silicon Via) 工艺。"), "used": text("TSV (Through Silicon Via) 工艺。TSV 用于先进封装。"), "b": text("TSV (Through Silicon Via) 工艺。TSV (硅通孔) 用于先进封装。"), "c": text("TSV 用于先进封装。TSV (Through Silicon Via) 是硅通孔。"),
        "inside": text("硅通孔 (TSV) 与 TSV 。"), "word": text("THE END"), "touch": text("TSV技术"),
    })
    assert fired(factual.first_defined(t, C)) == ["c"]
    assert fired(factual.defined_never_used(t, C)) == ["a", "b"]
    assert fired(factual.multiply_defined(t, C)) == ["b"]
    (r,) = factual.used_before_defined(t, C).collect()
    assert r.doc_id == "c" and r.location == "第 1 页 (使用) → 第 1 页 (定义)"


def test_language(spark):
    t = corpus(spark, {
        "touch": text("使用FinFET技术"), "apart": text("使用 FinFET 技术"), "mark": text("FinFET，很好"), "no": text("我们利用该技术"), "yes": text("我们使用该技术"), "na": text("the NA is 0.33"), "nano": text("NANO technology"), "commas": text("重复逗号，，测试"), "accepted": text("他仔细的看了看"),
        "term": ("pptx", page("we utilize it", notes="utilize")), "near": text("use it, do not utilize it"),
    })
    mixed = sorted((r.doc_id, r.rule_id, r.severity) for r in language.mixed_formatting(t, C).collect())
    assert mixed == [("mark", "FMT-MIXED-003", "warning"), ("touch", "FMT-MIXED-001", "info"), ("touch", "FMT-MIXED-002", "info")]
    c = replace(C, rejected=rejected(["利用", "NA # unclear"]), accepted=("仔细的",), glossary=tuple(glossary("category: x\nterms: [{pattern: '(?i)utilize', preferred: use}, {no: pattern}, 5]")))
    assert fired(language.rejected_words(t, c)) == ["na", "no"]
    assert [(r.doc_id, r.context) for r in language.chinese_grammar(t, c).collect()] == [("commas", "重复逗号，，测试")]
    assert sorted((r.doc_id, r.location, r.rule_id, r.severity) for r in language.glossary_terms(t, c).collect()) == [("term", "第 1 页", "TERM-x", "warning")] * 2 + [("term", "第 1 页 (备注)", "TERM-x", "warning")]
    segments = {(r.doc_id, r.lang) for r in language.segments(t).collect()}
    assert ("yes", "zh") in segments and ("nano", "en") in segments and {("touch", "en")} <= segments


def test_spelling(spark):
    t = corpus(spark, {"d": text("xrecieve then recieve alone, TSMC FinFET Recieve")})
    words = spark.createDataFrame([("receive",), ("then",), ("alone",), ("xrecieve",)], "word string")
    rows = language.spelling(t, C, words).collect()
    assert [(r.message, r.suggestion) for r in rows] == [("可能的拼写错误: 'recieve'", "建议改为: receive, xrecieve")] * 2


def test_regex_rules(spark):
    pattern = r"(?<![A-Za-z0-9])(?:[A-Z]{2,8}(?![A-Za-z0-9])|[A-Z][a-z]{2,}(?![A-Za-z0-9]))(?!\s*[（(][^）)]*[）)])"
    rule = Rule("TERM-003", "terminology", "info", "d", "regex", {"pattern": pattern, "仅中文页面": "true", "大小写敏感": "true", "排除括号内": "true"})
    t = corpus(spark, {"bare": text("TSV 工艺用于先进封装。"), "gloss": text("TSV (硅通孔) 工艺用于先进封装。"), "english": text("TSV process"), "long": text("CDMA2000 与 TSVstack 技术对比。"), "inside": text("硅通孔 (Through Silicon Via) 工艺")})
    assert fired(patterns.regex_rule(t, rule)) == ["bare"]
    fan = Rule("TERM-001", "terminology", "error", "d", "regex", {"pattern": r"fan-out(?!\s*(wafer|panel))"})
    t = corpus(spark, {"yes": text("a Fan-Out design"), "no": text("fan-out wafer")})
    assert fired(patterns.regex_rule(t, fan)) == ["yes"]
    assert patterns.regex_rule(t, replace(fan, params={"pattern": "("})) is None
