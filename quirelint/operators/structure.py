"""Checks of titles, headings, numbering, captions, sections and layouts. Each takes (tables, config) and gives findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelint.functions.text import ENGLISH_TITLE_WORD, TRAILING_PUNCTUATION, cjk_count, is_blank, matches, strip
from quirelint.model import Tables, page_number
from quirelint.operators.findings import findings, page_label
from quirelint.plans.rules import Config

# fixed values: what counts as a reference to, and as a caption of, a figure or table
REFERENCE = r"(?dUiu)(?:图|Fig\.?|Figure|表|Table|Tab\.?)\s*(\d+)(?![-–—]\d)"
FIGURE, TABLE = r"(?iu)^(?:图|Fig)", r"(?iu)^(?:表|Table|Tab)"
CAPTION = r"(?dUiu)(?:Fig\.?|Figure|图|Table|Tab\.?|表)\s*(\d+)\s*[:：\-—–]\s*"


def title_slide(t: Tables, c: Config) -> DataFrame:
    """STR-001: the first page has neither a title layout nor a title nor large text."""
    first = t.pages.where("format = 'pptx' and page_index = 0")
    titles = t.elements.where("page_index = 0 and type is not null and is_title").select("doc_id")
    body = t.paragraphs.where("page_index = 0").where(~is_blank("text")).select("doc_id", "flat_idx", "para_idx")
    frames = t.elements.where("page_index = 0 and type = 'text_frame'").select("doc_id", "flat_idx")
    large = t.runs.where("page_index = 0").where(F.col("font_size") >= c.min_title_font_size).join(body, ["doc_id", "flat_idx", "para_idx"], "left_semi").join(frames, ["doc_id", "flat_idx"], "left_semi").select("doc_id")
    bad = first.where(~F.coalesce(F.col("layout_name").contains("标题"), F.lit(False))).join(titles.union(large), "doc_id", "left_anti")
    name = F.coalesce(F.when(F.col("layout_name") != "", F.col("layout_name")), F.lit("未知版式"))
    return findings(
        bad, "structure", "error", "STR-001", F.lit('未检测到标题页（第一页版式不是"标题幻灯片"，也无标题占位符或大号标题文本）'), page=F.lit(0),
        suggestion=F.lit('建议第一页使用"标题幻灯片"版式，包含文档标题和作者信息'), location=F.concat(F.lit("第 1 页 ["), name, F.lit("]")),
    )


def heading_jumps(levels: DataFrame, by: list[str], order: list) -> DataFrame:
    """Rows whose level is more than one below that of the row before, with ``previous``."""
    previous = F.lag("level").over(W.partitionBy(*by).orderBy(*order))
    return levels.where("level is not null").withColumn("previous", previous).where(F.col("level") > F.col("previous") + 1)


def heading_levels(t: Tables, c: Config) -> DataFrame:
    """STR-003: a heading skips a level, outside slides (slides' levels are indents)."""
    rows = heading_jumps(t.frames.where("format <> 'pptx'"), ["doc_id", "page_index"], ["flat_idx", "para_idx"])
    return findings(
        rows, "structure", "warning", "STR-003", F.format_string("标题层级跳级: 从 H%d 跳到 H%d", "previous", "level"), page=F.col("page_index"), context=F.substring("text", 1, 100),
        suggestion=F.format_string("建议在 H%d 和 H%d 之间插入 H%d 级别的标题", "previous", "level", F.col("previous") + 1), location=page_label(), seq=["page_index", "flat_idx", "para_idx"],
    )


def references(t: Tables) -> DataFrame:
    """(doc_id, page_index, page_number, start, m, n, kind) of references to figures and tables."""
    found = t.page_text.select("doc_id", "page_index", "page_number", F.explode(matches("all_text", REFERENCE)).alias("x")).select("doc_id", "page_index", "page_number", "x.*")
    kind = F.when(F.col("m").rlike(FIGURE), "图").when(F.col("m").rlike(TABLE), "表")
    n = F.expr("try_cast(regexp_extract(m, '(?U)([0-9]+)', 1) as bigint)")
    return found.select("*", n.alias("n"), kind.alias("kind")).where("kind is not null and n is not null")


def sequence_faults(items: DataFrame, by: list[str], order: list, number: str = "n") -> DataFrame:
    """Adds previous and fault: repeated, skipped or back; every item becomes the one before the next."""
    w = W.partitionBy(*by)
    along = w.orderBy(*order)
    rows = items.withColumn("previous", F.lag(number).over(along)).withColumn("occurrence", F.row_number().over(W.partitionBy(*by, number).orderBy(*order)))
    fault = F.when(F.col("occurrence") > 1, "repeated").when(F.col(number) > F.col("previous") + 1, "skipped").when(F.col(number) < F.col("previous") + 1, "back")
    return rows.withColumn("fault", F.when(F.col("previous").isNotNull() | (F.col("occurrence") > 1), fault)).where("fault is not null").drop("occurrence")


def figure_numbering(t: Tables, c: Config) -> DataFrame:
    """STR-002: numbers of figures or tables repeat, skip or go back."""
    rows = sequence_faults(references(t), ["doc_id", "kind"], ["page_index", "start"])
    expected = F.col("previous") + 1
    message = (
        F.when(F.col("fault") == "repeated", F.format_string("%s编号重复: %s 出现多次", "kind", "m"))
        .when(F.col("fault") == "skipped", F.format_string("%s编号不连续: 期望 %s%d，实际 %s（跳过了 %d 个编号）", "kind", "kind", expected, "m", F.col("n") - expected))
        .otherwise(F.format_string("%s编号倒退: 期望 ≥ %s%d，实际 %s", "kind", "kind", expected, "m"))
    )
    return findings(rows, "structure", "error", "STR-002", message, page=F.col("page_index"), context=F.substring("m", 1, 150), location=page_label(), seq=[F.when(F.col("kind") == "图", 0).otherwise(1), "page_index", "start"])


def fingerprint(caption: Column | str) -> Column:
    """Digits as N, one kind of colon and dash, no white space."""
    x = F.col(caption) if isinstance(caption, str) else caption
    for pattern, by in ((r"(?U)\d+", "N"), ("[：:]", ":"), (r"[—–\-]", "-"), (r"(?U)\s+", "")):
        x = F.regexp_replace(x, pattern, by)
    return x


def caption_format(t: Tables, c: Config) -> DataFrame:
    """STR-007: captions of several forms in one document."""
    found = t.page_text.select("doc_id", "page_index", F.explode(matches("all_text", CAPTION)).alias("x")).select("doc_id", "page_index", "x.*")
    forms = found.groupBy("doc_id", fingerprint("m").alias("form")).agg(F.min_by("m", F.struct("page_index", "start")).alias("example"))
    docs = forms.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("form", "example"))).alias("x")).where(F.size("x") >= 2)
    return findings(
        docs, "structure", "warning", "STR-007", F.format_string("检测到 %d 种不同的图表标题格式: %s", F.size("x"), F.array_join("x.form", ", ")),
        context=F.substring(F.array_join(F.transform("x.example", strip), " | "), 1, 150), suggestion=F.lit("建议统一图表标题格式，全文使用同一种格式（如'图N：'或'Fig. N: '）"), location=F.lit("全文"),
        metadata=F.to_json(F.struct(F.size("x").alias("format_count"), F.col("x.form").alias("formats"))),
    )


def required_sections(t: Tables, c: Config) -> DataFrame:
    """CON-002: a section is in no title or heading and nowhere in the text."""
    if not c.required_sections:
        return findings(t.documents.limit(0), "structure", "error", "CON-002", F.lit(""))
    headings = t.frames.where((F.col("is_title") | F.col("level").isNotNull()) & ~is_blank("text"))
    headings = headings.groupBy("doc_id").agg(F.collect_set(F.lower(strip("text"))).alias("titles"))
    text = t.document_text.join(headings, "doc_id", "left")
    section = F.posexplode(F.array(*map(F.lit, c.required_sections))).alias("i", "section")
    rows = text.select("doc_id", F.lower("all_text").alias("body"), F.coalesce("titles", F.array().cast("array<string>")).alias("titles"), section)
    low = F.lower("section")
    rows = rows.where(~F.col("body").contains(low) & ~F.exists("titles", lambda x: x.contains(low)))
    return findings(rows, "structure", "error", "CON-002", F.concat(F.lit("缺少必须的章节: "), "section"), suggestion=F.format_string("建议添加「%s」章节", "section"), location=F.lit("全文"), seq=["i"])


def single_layout(pages: DataFrame, by: str = "doc_id", layout: str = "layout_name") -> DataFrame:
    """(by, layout, pages) of groups with one layout, which is known."""
    name = F.coalesce(F.when(F.col(layout) != "", F.col(layout)), F.lit("未知"))
    return pages.groupBy(by).agg(F.min(name).alias("layout"), F.max(name).alias("last"), F.count("*").alias("pages")).where("layout = last and layout <> '未知'").drop("last")


def layout_variety(t: Tables, c: Config) -> DataFrame:
    """STR-008: all slides use one layout."""
    rows = single_layout(t.pages.where("format = 'pptx'"))
    return findings(
        rows, "structure", "info", "STR-008", F.format_string("所有幻灯片使用同一版式「%s」，建议根据内容类型使用不同版式", "layout"), context=F.format_string("共 %d 页，版式: %s", "pages", "layout"),
        suggestion=F.lit("建议根据内容类型使用不同版式（如标题页、内容页、章节页等）"), location=F.lit("全文"),
    )


def conclusions(t: Tables, c: Config) -> DataFrame:
    """CON-004: a slide has no keyword, fewer than three paragraphs besides its title, and no notes; some layouts are exempt."""
    layout = F.lower(strip("layout_name"))
    exempt = F.coalesce(F.exists(F.array(*map(F.lit, c.exempt_layouts)), lambda x: layout.contains(F.lower(x))), F.lit(False)) if c.exempt_layouts else F.lit(False)
    body = t.frames.where("format = 'pptx' and not coalesce(is_title, false)").where(~is_blank("text")).groupBy("doc_id", "page_index").agg(F.count("*").alias("n"))
    text = t.page_text.select("doc_id", "page_index", "page_number", "all_text")
    pages = t.pages.where("format = 'pptx'").join(text, ["doc_id", "page_index"]).join(body, ["doc_id", "page_index"], "left")
    keyword = F.exists(F.array(*map(F.lit, c.conclusion_keywords)), lambda k: F.lower("all_text").contains(F.lower(k))) if c.conclusion_keywords else F.lit(False)
    rows = pages.where(~exempt & ~keyword & (F.coalesce("n", F.lit(0)) < 3) & is_blank("notes"))
    return findings(
        rows, "structure", "error", "CON-004", F.lit("该页缺少结论或关键要点"), page=F.col("page_index"), context=F.when(is_blank("all_text"), "(空白页)").otherwise(F.substring("all_text", 1, 100)),
        suggestion=F.lit("每页应包含明确的结论句或 Key Takeaway，或确保有足够的内容元素"), location=page_label(), seq=["page_index"],
    )


def _titles(t: Tables) -> DataFrame:
    """Non-blank paragraphs of title elements, by flag or shape name, of any type."""
    element = t.elements.where("type is not null").where(F.coalesce("is_title", F.lit(False)) | F.coalesce(F.lower("shape_name").contains("title"), F.lit(False)))
    number = t.pages.select("doc_id", "page_index", page_number().alias("page_number"))
    rows = t.paragraphs.join(element.select("doc_id", "page_index", "flat_idx", "is_title"), ["doc_id", "page_index", "flat_idx"]).join(number, ["doc_id", "page_index"])
    return rows.where(~is_blank("text")).withColumn("title", strip("text"))


def title_length(t: Tables, c: Config) -> DataFrame:
    """STR-004: a title of too many English words or Chinese characters."""
    rows = _titles(t).withColumn("en", F.regexp_count("title", F.lit(ENGLISH_TITLE_WORD))).withColumn("zh", cjk_count("title"))
    rows = rows.where((F.col("en") > c.max_english_words) | (F.col("zh") > c.max_chinese_chars_title))
    return findings(
        rows, "structure", "warning", "STR-004", F.format_string("标题过长: %d 英文词 / %d 中文字", "en", "zh"), page=F.col("page_index"), context=F.substring("title", 1, 100),
        suggestion=F.lit(f"建议标题控制在 {c.max_english_words} 英文词或 {c.max_chinese_chars_title} 中文字以内"), location=page_label(),
        metadata=F.to_json(F.struct(F.col("en").alias("english_words"), F.col("zh").alias("chinese_chars"))), seq=["page_index", "flat_idx", "para_idx"],
    )


def title_punctuation(t: Tables, c: Config) -> DataFrame:
    """STR-006: a title ends in punctuation."""
    rows = _titles(t).withColumn("mark", F.regexp_extract("title", TRAILING_PUNCTUATION, 0)).where("mark <> ''")
    return findings(
        rows, "structure", "info", "STR-006", F.format_string("标题末尾含有多余标点: 「%s」", "mark"), page=F.col("page_index"), context=F.substring("title", 1, 100), suggestion=F.lit("标题末尾不应使用标点符号，建议删除末尾的标点"),
        location=page_label(), metadata=F.to_json(F.struct(F.col("mark").alias("trailing_punctuation"))), seq=["page_index", "flat_idx", "para_idx"],
    )


def repeated(titles: DataFrame, by: list[str], title: str, page: str, order: list) -> DataFrame:
    """(by, title, pages) of titles on several places, pages in order."""
    grouped = titles.groupBy(*by, title).agg(F.array_sort(F.collect_list(F.struct(*order, page))).alias("x"))
    return grouped.where(F.size("x") > 1).withColumn("pages", F.col(f"x.{page}"))


def duplicate_titles(t: Tables, c: Config) -> DataFrame:
    """STR-005: titles that are equal but for case."""
    titles = _titles(t).where("is_title").withColumn("title", F.lower("title"))
    rows = repeated(titles, ["doc_id"], "title", "page_number", ["page_index", "flat_idx", "para_idx"]).withColumn("first", F.col("x")[0])
    return findings(
        rows, "structure", "error", "STR-005", F.format_string("重复标题: 「%s」在 %d 张幻灯片中出现", F.substring("title", 1, 50), F.size("x")), page=F.col("first.page_index"), context=F.substring("title", 1, 80),
        suggestion=F.lit("每张幻灯片的标题应独一无二，建议添加副标题或编号加以区分"), location=F.array_join(F.transform("pages", lambda p: F.format_string("第 %d 页", p)), ", "),
        metadata=F.to_json(F.struct(F.col("x.page_index").alias("pages"))), seq=["first.page_index", "first.flat_idx", "first.para_idx"],
    )
