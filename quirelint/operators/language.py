"""Checks of mixed scripts, vocabulary, glossary terms, Chinese grammar and spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelint.functions.text import CJK_LATIN, LATIN_CHINESE_PUNCTUATION, LATIN_CJK, LONG_ENGLISH_WORD, bound, first_matches, is_blank, is_technical, language_segments, matches, window
from quirelint.model import Tables
from quirelint.operators.findings import findings, page_label
from quirelint.plans.rules import Config

# fixed values: pattern, message, rule, severity, characters of context
MIXED = [
    (LATIN_CJK, "英文和中文之间建议加空格", "FMT-MIXED-001", "info", 10),
    (CJK_LATIN, "中文和英文之间建议加空格", "FMT-MIXED-002", "info", 10),
    (LATIN_CHINESE_PUNCTUATION, "英文后不应使用中文标点符号", "FMT-MIXED-003", "warning", 5),
]
# fixed values: Chinese grammar, pattern and message
GRAMMAR = [
    ("的的", "重复用词: '的的'"),
    ("了了", "重复用词: '了了'"),
    ("是是", "重复用词: '是是'"),
    ("在在", "重复用词: '在在'"),
    ("仔细的", "应为 '仔细地' (副词用'地')"),
    ("认真的", "根据语境可能应为 '认真地' (副词用'地')"),
    ("很快的", "应为 '很快地' (副词用'地')"),
    ("做的好", "应为 '做得好' (补语用'得')"),
    ("说的对", "应为 '说得对' (补语用'得')"),
    ("再.{0,15}?在", "注意区分 '再'(again/further) 和 '在'(at/in)"),
    ("在.{0,15}?再", "注意区分 '在'(at/in) 和 '再'(again/further)"),
    ("做功", "半导体语境中通常用 '做功'；但如果指'作为功'应写 '作功'"),
    ("约[^左右]{0,20}左右", "语义重复: '约' 和 '左右' 不能同时使用"),
    ("大约[^左右]{0,20}左右", "语义重复: '大约' 和 '左右' 不能同时使用"),
    ("大概[^左右]{0,20}左右", "语义重复: '大概' 和 '左右' 不能同时使用"),
    ("超过[^以上]{0,20}以上", "语义重复: '超过' 和 '以上' 不能同时使用"),
    ("至少[^以上]{0,20}以上", "语义重复: '至少' 和 '以上' 不能同时使用"),
    ("通过.{0,20}?了", "欧化句式: 避免 '通过...了' 结构，改用直接陈述"),
    ("被.{0,20}?所", "欧化句式: 避免 '被...所...' 结构"),
    ("，，+", "重复逗号"),
    ("。。+", "重复句号"),
    ("、、+", "重复顿号"),
    ("良率.{0,10}?底(?![部层])", "可能为'良率低'之误 ('底' vs '低')"),
    ("异质.{0,10}?结合", "半导体语境中应为 '异质集成' 而非 '异质结合'"),
]
SHORTEST, MOST_WORDS = {"en": 2, "zh": 5}, 100


def _numbered(found, i: int):
    """Matches with the number of their pattern."""
    return F.transform(found, lambda x: F.named_struct(F.lit("i"), F.lit(i), F.lit("start"), x["start"], F.lit("m"), x["m"]))


def _without(found, near: str | None, radius: int = 60):
    """Matches that have no match of ``near`` around them."""
    return found if near is None else F.filter(found, lambda x: ~window("text", x["start"], x["start"] + F.length(x["m"]), radius).rlike(near))


def _pages(t: Tables) -> DataFrame:
    return t.page_text.where(~is_blank("all_text"))


def mixed_matches(text: str, pattern: str, radius: int):
    """struct(n, contexts and parts of the first five matches)."""
    around = lambda x: window(text, x["start"], x["start"] + F.length(x["m"]), radius)
    return bound(first_matches(text, pattern, 5), lambda x: F.named_struct(F.lit("n"), F.coalesce(x["n"], F.lit(0)), F.lit("contexts"), F.transform(x["found"], around), F.lit("parts"), x["found"]["m"]))


def mixed_formatting(t: Tables, c: Config) -> DataFrame:
    """FMT-MIXED: scripts that touch, Chinese punctuation after Latin; a finding a page and pattern."""
    checks = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(message).alias("text"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), mixed_matches("all_text", pattern, r).alias("x")) for i, (pattern, message, rule, severity, r) in enumerate(MIXED)))
    rows = _pages(t).select("doc_id", "page_index", "page_number", F.explode(checks).alias("c")).select("doc_id", "page_index", "page_number", "c.*").where("x.n > 0")
    spaced = F.transform("x.parts", lambda m: F.concat(F.lit("「"), m, F.lit("」→ 「"), F.substring(m, 1, 1), F.lit(" "), F.substring(m, 2, 1), F.lit("」")))
    marks = F.transform("x.parts", lambda m: F.concat(F.lit("将「"), F.substring(m, 2, 1), F.lit("」改为对应的英文标点")))
    advice = F.array_join(F.slice(F.array_distinct(F.when(F.col("rule") == "FMT-MIXED-003", marks).otherwise(spaced)), 1, 3), "; ")
    out = findings(
        rows, "format", "", "", F.concat("text", F.lit(" ("), F.col("x.n").cast("string"), F.lit(" 处)")), page=F.col("page_index"), context=F.substring(F.array_join("x.contexts", " | "), 1, 150), suggestion=advice,
        location=page_label(), metadata=F.to_json(F.struct(F.col("x.n").alias("match_count"), "rule")), seq=["page_index", "i"],
    )
    i = F.element_at("seq", 2) + 1
    return out.withColumn("severity", F.element_at(F.array(*(F.lit(x[3]) for x in MIXED)), i)).withColumn("rule_id", F.element_at(F.array(*(F.lit(x[2]) for x in MIXED)), i))


def rejected_words(t: Tables, c: Config) -> DataFrame:
    """VOCAB-REJECT: a word off limits is somewhere on the page; one finding a word and page."""
    if not c.rejected:
        return findings(t.documents.limit(0), "language", "warning", "VOCAB-REJECT", F.lit(""))
    hits = F.array_compact(F.array(*(F.when(F.col("all_text").rlike(pattern), F.struct(F.lit(i).alias("i"), F.lit(word).alias("word"), F.lit(reason).alias("reason"))) for i, (word, pattern, reason) in enumerate(c.rejected))))
    rows = _pages(t).select("doc_id", "page_index", "page_number", F.explode(hits).alias("h")).select("*", "h.*")
    return findings(rows, "language", "warning", "VOCAB-REJECT", F.format_string("使用了应避免的词汇: 「%s」— %s", "word", "reason"), page=F.col("page_index"), context=F.substring("word", 1, 150), suggestion=F.lit("请使用更正式或更准确的表达"), location=page_label(), seq=["page_index", "i"])


def glossary_terms(t: Tables, c: Config) -> DataFrame:
    """TERM-<category>: a discouraged wording without the preferred one within 60 characters; notes are read once more."""
    if not c.glossary:
        return findings(t.documents.limit(0), "terminology", "warning", "", F.lit(""))
    pages = _pages(t)
    texts = pages.select("doc_id", "page_index", page_label().alias("label"), F.col("all_text").alias("text"), F.lit(0).alias("part"))
    notes = pages.where("notes <> ''").select("doc_id", "page_index", F.concat(page_label(), F.lit(" (备注)")).alias("label"), F.col("notes").alias("text"), F.lit(1).alias("part"))
    # one literal pattern a term, so that each is compiled once
    hits = [_numbered(_without(matches("text", g["pattern"]), g["near"]), i) for i, g in enumerate(c.glossary)]
    rows = texts.unionByName(notes).select("doc_id", "page_index", "label", "part", F.explode(F.concat(*hits)).alias("h")).select("*", "h.*")
    pick = lambda k: F.element_at(F.array(*(F.lit(g[k]) for g in c.glossary)), F.col("i") + 1)
    rows = rows.withColumns({"rule": F.concat(F.lit("TERM-"), pick("category")), "grave": pick("severity"), "advice": pick("advice"), "note": pick("context"), "category": pick("category")})
    out = findings(
        rows, "terminology", "", "", F.format_string("术语用法不规范: 「%s」", "m"), page=F.col("page_index"), context=F.substring("m", 1, 150), suggestion=F.col("advice"), location=F.col("label"),
        metadata=F.to_json(F.struct(F.col("category").alias("glossary"), F.col("note").alias("context_note"))), seq=["page_index", "part", "i", "start"],
    )
    i = F.element_at("seq", 3) + 1
    return out.withColumn("rule_id", F.concat(F.lit("TERM-"), F.element_at(F.array(*(F.lit(g["category"]) for g in c.glossary)), i))).withColumn("severity", F.element_at(F.array(*(F.lit(g["severity"]) for g in c.glossary)), i))


def segments(t: Tables) -> DataFrame:
    """(doc_id, page_index, page_number, seg, text, lang) of segments long enough to check."""
    rows = _pages(t).select("doc_id", "page_index", "page_number", F.posexplode(language_segments("all_text")).alias("seg", "s")).select("doc_id", "page_index", "page_number", "seg", "s.text", "s.lang")
    return rows.where(F.length(F.trim("text")) >= F.when(F.col("lang") == "en", SHORTEST["en"]).otherwise(SHORTEST["zh"]))


def chinese_grammar(t: Tables, c: Config) -> DataFrame:
    """PY-ZH-GRAMMAR, less words that the vocabulary accepts."""
    hits = [_numbered(matches("text", "(?U)" + p), i) for i, (p, _) in enumerate(GRAMMAR)]
    rows = segments(t).where("lang = 'zh'").select("doc_id", "page_index", "page_number", "seg", "text", F.explode(F.concat(*hits)).alias("h")).select("*", "h.*")
    rows = rows.where(~F.lower("m").isin(list(c.accepted))) if c.accepted else rows
    message = F.element_at(F.array(*(F.lit(m) for _, m in GRAMMAR)), F.col("i") + 1)
    context = F.substring(window("text", F.col("start"), F.col("start") + F.length("m"), 10), 1, 120)
    return findings(rows, "language", "error", "PY-ZH-GRAMMAR", message, page=F.col("page_index"), context=context, location=page_label(), metadata=F.to_json(F.struct(F.lit("zh").alias("language"), F.lit("GRAMMAR").alias("category"))), seq=["page_index", "seg", "i", "start"])


def _candidates():
    """The first 100 distinct plain words of a segment, in small letters."""
    words = F.filter(F.regexp_extract_all("text", F.lit(LONG_ENGLISH_WORD), F.lit(0)), lambda w: ~is_technical(w))
    return F.slice(F.array_distinct(F.transform(words, F.lower)), 1, MOST_WORDS)


def spelling_candidates(t: Tables) -> DataFrame:
    """(doc_id, page_index, page_number, seg, text, word): the first 100 distinct plain words of a segment, in small letters."""
    return segments(t).where("lang = 'en'").select("doc_id", "page_index", "page_number", "seg", "text", F.explode(_candidates()).alias("word"))


def spelling(t: Tables, c: Config, dictionary: DataFrame) -> DataFrame:
    """PY-SPELL: words not in ``dictionary`` (word) and not accepted; every whole occurrence is a finding. Up to three words one edit away are named."""
    known = dictionary.select(F.lower("word").alias("word")).distinct()
    # every occurrence of a candidate, found once a segment
    spots = bound(_candidates(), lambda words: F.filter(matches("text", LONG_ENGLISH_WORD), lambda x: F.array_contains(words, F.lower(x["m"]))))
    spots = F.transform(spots, lambda x: F.named_struct(F.lit("word"), F.lower(x["m"]), F.lit("m"), x["m"], F.lit("start"), x["start"], F.lit("context"), F.substring(window("text", x["start"], x["start"] + F.length(x["m"]), 20), 1, 120)))
    rows = segments(t).where("lang = 'en'").select("doc_id", "page_index", "page_number", "seg", F.explode(spots).alias("x")).select("doc_id", "page_index", "page_number", "seg", "x.*")
    rows = (rows.where(~F.col("word").isin(list(c.accepted))) if c.accepted else rows).join(known, "word", "left_anti")
    unknown = rows.select("word").distinct()
    # words one edit apart agree when one letter of each is dropped: an equi-join instead of a cross join
    def dropped(df: DataFrame, name: str) -> DataFrame:
        less = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.col("word").substr(F.lit(1), i - 1), F.col("word").substr(i + 1, F.lit(1 << 20))))
        return df.withColumn("key", F.explode(F.array_append(less, F.col("word")))).select(F.col("word").alias(name), "key")

    near = dropped(unknown, "word").join(dropped(known, "right"), "key").where(F.levenshtein("word", "right") <= 2).select("word", "right").distinct()
    near = near.groupBy("word").agg(F.array_join(F.slice(F.array_sort(F.collect_set("right")), 1, 3), ", ").alias("near"))
    rows = rows.join(near, "word", "left")
    return findings(
        rows, "language", "error", "PY-SPELL", F.format_string("可能的拼写错误: '%s'", "word"), page=F.col("page_index"), context=F.col("context"), suggestion=F.when(F.col("near").isNotNull(), F.concat(F.lit("建议改为: "), "near")),
        location=page_label(), metadata=F.to_json(F.struct(F.lit("en").alias("language"), F.lit("MISSPELLING").alias("category"))), seq=["page_index", "seg", "start"],
    )
