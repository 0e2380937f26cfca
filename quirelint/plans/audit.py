"""From rules to one plan: every check is a DataFrame over the tables, the audit is their union, de-duplicated."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelint.model import Tables
from quirelint.operators import factual, formatting, language, patterns, structure
from quirelint.operators.findings import COLUMNS, deduplicate, findings, union
from quirelint.plans.rules import Config, Rule, configure
from quirelint.sources.service import Post, service_findings

Check = Callable[[Tables, Config], DataFrame]


@dataclass(frozen=True)
class Entry:
    check: Check
    per_page: bool = False
    slides_only: bool = False


#: check_type of a rule -> check
REGISTRY = {
    "first_slide_has_title_layout": Entry(structure.title_slide, slides_only=True),
    "figure_numbering_sequential": Entry(structure.figure_numbering),
    "heading_level_sequential": Entry(structure.heading_levels, slides_only=True),
    "title_length": Entry(structure.title_length),
    "duplicate_title": Entry(structure.duplicate_titles),
    "title_trailing_punctuation": Entry(structure.title_punctuation, per_page=True),
    "figure_caption_format": Entry(structure.caption_format),
    "slide_structure_consistency": Entry(structure.layout_variety, slides_only=True),
    "every_slide_has_conclusion": Entry(structure.conclusions, slides_only=True),
    "per_page_char_limit": Entry(formatting.page_char_limit, per_page=True),
    "element_overflow": Entry(formatting.element_overflow, per_page=True),
    "empty_placeholder": Entry(formatting.empty_placeholders, per_page=True, slides_only=True),
    "bullet_consistency": Entry(formatting.bullet_consistency, per_page=True),
    "table_contrast": Entry(formatting.table_contrast, per_page=True),
    "numeric_cross_reference": Entry(factual.numeric_consistency),
    "abbreviation_first_defined": Entry(factual.first_defined),
    "abbreviation_defined_never_used": Entry(factual.defined_never_used),
    "abbreviation_multiply_defined": Entry(factual.multiply_defined),
    "abbreviation_used_before_defined": Entry(factual.used_before_defined),
}
#: checks that run without a rule that names them, and keep their severity
NATIVE: list[Check] = [
    structure.required_sections, formatting.page_fonts, formatting.font_sizes, formatting.alignment, formatting.paragraph_length, formatting.document_fonts,
    lambda t, c: formatting.title_layouts(replace(t, pages=t.pages.where("format = 'pptx'")), c),
]
LANGUAGE: list[Check] = [language.glossary_terms, language.mixed_formatting, language.rejected_words]


def check_registry(t: Tables) -> list[str]:
    """What is wrong with the registry: a check that can't be called so, or gives no findings; ``t`` may be empty."""
    wrong = []
    for name, entry in REGISTRY.items():
        try:
            if entry.check(t, Config()).columns != COLUMNS:
                wrong.append(f"{name}: {entry.check.__name__} gives no findings")
        except Exception as e:  # whatever it raises is what is reported
            wrong.append(f"{name}: {type(e).__name__}: {e}")
    return wrong


def _system_error(t: Tables, message: str, context: str, suggestion: str, **metadata: str) -> DataFrame:
    details = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in metadata.items())))
    return findings(t.documents, "custom", "error", "SYS-ERROR", F.lit(message), context=F.lit(context[:120]), suggestion=F.lit(suggestion), location=F.lit("系统"), metadata=details)


def rule_findings(t: Tables, rule: Rule, c: Config, parity: bool = True) -> DataFrame | None:
    """What a rule finds, at the rule's severity; None if there is nothing to run.

    With ``parity`` a check of slides never sees other documents, as in the rules' own dispatch; heading levels,
    which leave slides out, then find nothing. Without it they run on the documents that they understand.
    """
    severity = rule.severity if rule.severity in ("error", "warning", "info") else "info"
    if rule.category == "terminology" and "pattern" in rule.params:
        return patterns.regex_rule(t, replace(rule, severity=severity))
    if not rule.check_type:
        return None
    entry = REGISTRY.get(rule.check_type)
    if entry is None:
        return _system_error(
            t, f"规则 '{rule.rule_id}' 的 check_type '{rule.check_type}' 未注册，检查未执行", f"check_type={rule.check_type} rule_id={rule.rule_id}", "检查 rules.md 中 '检查' 键的拼写是否与 _DISPATCH 表一致",
            rule_id=rule.rule_id, check_type=rule.check_type,
        )
    out = entry.check(t, c)
    if entry.slides_only and parity:
        out = out.join(t.documents.where("format = 'pptx'").select("doc_id"), "doc_id", "left_semi").select(out.columns)
    return out.withColumn("severity", F.lit(severity))


def _name(check: Check) -> str:
    return getattr(check, "__name__", "check").strip("<>")


def language_checks(dictionary: DataFrame | None = None, post: Post | None = None) -> list[Check]:
    """The tier of language checks: a grammar service (``post``), or Chinese grammar here and, with a dictionary, English spelling."""
    if post is not None:
        return [lambda t, c: service_findings(t, c, post)]
    return [lambda t, c: language.spelling(t, c, dictionary)] * (dictionary is not None) + [language.chinese_grammar]


def audit(
    t: Tables, rules: list[Rule], config: Config | None = None, dictionary: DataFrame | None = None, parity: bool = True, post: Post | None = None, isolate: bool = False, on_progress: Callable[[str, int, int], None] | None = None,
) -> DataFrame:
    """All findings, de-duplicated: (findings columns, dedup_key, place).

    config gives vocabulary and glossary (``sources.vocabulary``); the rules override its settings. A check that can't be
    planned becomes a SYS-ERROR finding. So does, with ``isolate``, one that fails while it runs: each is then run
    by itself and persisted, where otherwise the whole audit is one plan. ``on_progress`` is told (name, number, of how many) before
    each check.
    """
    c = configure(rules, config)
    steps: list[tuple[str, Callable[[], DataFrame | None]]] = [(_name(check), lambda check=check: check(t, c)) for check in [*NATIVE, *language_checks(dictionary, post), *LANGUAGE]]
    steps += [(f"规则 '{rule.rule_id}'", lambda rule=rule: rule_findings(t, rule, c, parity)) for rule in rules]
    parts = []
    for i, (name, step) in enumerate(steps):
        if on_progress:
            on_progress(name, i, len(steps))
        found = None
        try:
            found = step()
            if found is not None:
                found.schema  # noqa: B018  analysis errors show here
                if isolate:
                    found = found.persist()
                    found.count()
        except (Exception if isolate else (PySparkException, ValueError, TypeError)) as e:
            if found is not None and isolate:
                found.unpersist()
            found = _system_error(t, f"{name} 执行失败: {e}"[:2000], str(e), "请检查文档内容或规则配置", check=name, error=str(e)[:500])
        if found is not None:
            parts.append(found)
    if on_progress:
        on_progress("完成", len(steps), len(steps))
    return deduplicate(union(parts))
