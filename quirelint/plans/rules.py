"""Rules as text: the parser of rule files, the configuration drawn from them, and pattern translation."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

# fixed values: keys and marks of rule files, and what they are called here
SECTIONS = {"结构": "structure", "格式": "format", "术语": "terminology", "内容": "content"}
LINE = re.compile(r"#\s+(?P<section>.+)|###?\s+(?P<id>[\w-]+):\s*(?P<title>.+)|\s*-[-\s]*(?P<key>[^:]*?)\s*:(?P<value>.*)")
FRONT = re.compile(r"\A---.*?---", re.S)
LIST_EDGES, ITEM_EDGES = re.compile(r"^\s*[\[\]]*|[\[\]]*\s*$"), re.compile(r"^\s*[\"']*|[\"']*\s*$")
RANGES = (re.compile(r"min\s*:\s*(\d+).*?max\s*:\s*(\d+)"), re.compile(r"^(\d+)\s*[-–—]\s*(\d+)"))
WHOLE, QUOTED = re.compile(r"\s*[+-]?\d+\s*"), re.compile(r"([\"'])(.*)\1", re.S)
#: rule prefix -> parameter names -> (configuration field, type)
NUMBERS = {
    "FMT-003": {("max_chars",): ("max_chars_per_page", int)},
    "FMT-004": {("中文上限", "max_chinese"): ("max_chinese_chars", int), ("英文上限", "max_english"): ("max_english_chars", int), ("最大显式换行", "max_newlines"): ("max_explicit_newlines", int)},
    "FMT-008": {("最小对比度",): ("min_contrast", float), ("大字最小对比度",): ("large_text_min_contrast", float), ("大字字号阈值",): ("large_text_threshold", float)},
    "STR-001": {("最小标题字号",): ("min_title_font_size", int)},
    "STR-004": {("最大英文词数",): ("max_english_words", int), ("最大中文字数",): ("max_chinese_chars_title", int)},
}


@dataclass
class Rule:
    rule_id: str
    category: str
    severity: str
    description: str
    check_type: str = ""
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    """What the checks are set to; the defaults hold where no rule says otherwise."""

    # fixed values: defaults
    allowed_fonts: tuple = ("微软雅黑", "Arial", "Calibri", "Noto Sans SC")
    title_size_range: tuple = (28, 40)
    body_size_range: tuple = (12, 22)
    max_font_types: int = 3
    alignment_tolerance: float = 5.0
    required_sections: tuple = ()
    max_chinese_chars: int = 150
    max_english_chars: int = 300
    max_explicit_newlines: int = 3
    max_chars_per_page: int = 200
    conclusion_keywords: tuple = ("结论", "小结", "总结", "要点", "关键", "建议", "展望", "Summary", "Conclusion", "Key", "Takeaway", "Recommend")
    exempt_layouts: tuple = ("标题幻灯片", "Title Slide", "Title", "Titelfolie", "封面", "タイトル", "Cover")
    max_english_words: int = 10
    max_chinese_chars_title: int = 40
    min_title_font_size: int = 28
    min_contrast: float = 4.5
    large_text_min_contrast: float = 3.0
    large_text_threshold: float = 18
    rejected: tuple = ()  # (word, Java pattern, reason)
    accepted: tuple = ()
    glossary: tuple = ()  # dicts: category, pattern, near, advice, context, severity
    service_url: str | None = None


def truthy(value: Any) -> bool:
    return str(value or "").lower() in ("true", "1", "yes")


def items(value: str) -> list[str]:
    """``[a, "b"]``, with or without brackets and quotes."""
    inner = LIST_EDGES.sub("", value)
    return [ITEM_EDGES.sub("", x) for x in inner.split(",")] if inner else []


def bounds(value: str) -> tuple[int, int] | None:
    """``min: 1 ... max: 2``, or ``1-2``."""
    found = next(filter(None, (r.search(value) for r in RANGES)), None)
    return found and (int(found[1]), int(found[2]))


def unquoted(value: str) -> str:
    inside = QUOTED.fullmatch(value)
    return inside[2] if inside else value


def most_chars(value: str) -> int:
    return int(value) if WHOLE.fullmatch(value) else 200


#: key -> (attribute of the rule, or None for a parameter; its name; what reads the value)
KEYS: dict[str, tuple[str | None, str, Callable[[str], Any]]] = {
    key: (attribute, name, read)
    for keys, attribute, name, read in (
        (("严重度", "severity"), "severity", "", str.lower), (("检查", "check"), "check_type", "", str), (("说明", "description"), "description", "", str), (("建议", "suggestion"), None, "suggestion", str),
        (("模式", "pattern"), None, "pattern", unquoted), (("字体", "fonts"), None, "allowed_fonts", items), (("章节", "sections"), None, "required_sections", items), (("关键词", "keywords"), None, "关键词", items),
        (("豁免版式", "exempt_layouts"), None, "exempt_layouts", items), (("标题",), None, "title_range", bounds), (("正文",), None, "body_range", bounds), (("最大字数",), None, "max_chars", most_chars),
    )
    for key in keys
}


def parse_rules(text: str) -> list[Rule]:
    """Rules of a Markdown text: ``# section``, ``## ID: title`` or ``### ID: title``, ``- key: value``; settings belong to the rule above them."""
    lines = [m for m in (LINE.fullmatch(x.rstrip()) for x in FRONT.sub("", text, count=1).split("\n")) if m]
    sections = list(itertools.accumulate((m["section"] for m in lines), lambda now, new: new or now))
    heads = [i for i, m in enumerate(lines) if m["id"]]
    rules = []
    for i, end in itertools.pairwise([*heads, len(lines)]):
        name = sections[i] or ""
        rule = Rule(lines[i]["id"], next((to for mark, to in SECTIONS.items() if mark in name), name.strip()), "warning", lines[i]["title"].strip())
        for m in lines[i + 1 : end]:
            if m["key"] is not None:
                attribute, to, read = KEYS.get(m["key"], (None, m["key"], str))
                value = read(m["value"].strip())
                setattr(rule, attribute, value) if attribute else rule.params.update({to: value})
        rules.append(rule)
    return rules


def configure(rules: list[Rule], base: Config | None = None) -> Config:
    """The configuration that the rules ask for; a value that is no number leaves the default."""
    out: dict[str, Any] = {}
    for rule in rules:
        p, prefix = rule.params, rule.rule_id[:7]
        if prefix == "FMT-001" and "allowed_fonts" in p:
            out["allowed_fonts"] = tuple(p["allowed_fonts"])
        if prefix == "FMT-002":
            out |= {to: p[name] for name, to in (("title_range", "title_size_range"), ("body_range", "body_size_range")) if p.get(name) is not None}
        if prefix == "CON-002" and "required_sections" in p:
            out["required_sections"] = tuple(p["required_sections"])
        if prefix == "CON-004":
            out |= {to: tuple(p[name]) for name, to in (("关键词", "conclusion_keywords"), ("exempt_layouts", "exempt_layouts")) if name in p}
        for names, (to, kind) in NUMBERS.get(prefix, {}).items():
            for name in reversed(names):
                if name in p:
                    try:
                        out[to] = kind(p[name])
                    except (TypeError, ValueError):
                        out.pop(to, None)
    urls = [str(r.params["languagetool_url"]) for r in rules if "languagetool_url" in r.params]
    return replace(base or Config(), **out, **({"service_url": urls[0]} if urls else {}))


def java_pattern(pattern: str, ignore_case: bool) -> str | None:
    """The pattern for Spark's engine, with Unicode classes and Unix lines; None if it is empty or invalid."""
    if not pattern:
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    return ("(?dUiu)" if ignore_case else "(?dU)") + pattern
