"""Checks of fonts, sizes, lengths, positions, placeholders, bullets and contrast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelint.functions.text import bullet_class, cjk_count, contrast, count, is_blank, rounded, strip
from quirelint.model import Tables, page_number
from quirelint.operators.findings import findings, page_label
from quirelint.plans.rules import Config

# fixed values: a slide's size where the file names none, tolerances in points, bullet names
SLIDE_WIDTH, SLIDE_HEIGHT, OVERFLOW_TOLERANCE, ALIGNMENT_TOLERANCE = 960, 540, 5.0, 5.0
BULLET_NAMES = {"lettered": "字母(a) i.)", "numbered": "数字(1. 2.)", "symbol": "符号(•-*)"}


def _runs(t: Tables) -> DataFrame:
    frames = t.elements.where("type = 'text_frame'").select("doc_id", "page_index", "flat_idx", "is_title", "shape_name")
    number = t.pages.select("doc_id", "page_index", page_number().alias("page_number"))
    return t.runs.join(frames, ["doc_id", "page_index", "flat_idx"]).join(number, ["doc_id", "page_index"])


def _fonts(t: Tables) -> DataFrame:
    """A row for each run and script that names a font."""
    scopes = F.array(F.struct(F.col("font_name").alias("font"), F.lit("latin").alias("scope"), F.lit(0).alias("s")), F.struct(F.col("font_name_east_asia").alias("font"), F.lit("east_asia").alias("scope"), F.lit(1).alias("s")))
    rows = _runs(t).select("doc_id", "page_index", "page_number", "flat_idx", "para_idx", "run_idx", "text", F.explode(scopes).alias("f"))
    return rows.select("*", "f.*").drop("f").where("font <> ''")


def first_samples(order: list, value: Column, k: int) -> Column:
    """The first k values of a group in order; a group's rows are cut to k while they are combined only as far as Spark's
    min_by over k goes, so groups are kept per page."""
    return F.transform(F.slice(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))), 1, k), lambda x: x["v"])


def page_fonts(t: Tables, c: Config) -> DataFrame:
    """FMT-001: fonts off the list, a finding a page, font and script."""
    rows = _fonts(t).where(~F.col("font").isin(list(c.allowed_fonts)))
    order = ["flat_idx", "para_idx", "run_idx"]
    g = rows.groupBy("doc_id", "page_index", "page_number", "font", "scope").agg(F.count("*").alias("n"), first_samples(order, F.substring(F.coalesce("text", F.lit("")), 1, 50), 3).alias("samples"), F.min(F.struct(*order, "s")).alias("first"))
    label = F.when(F.col("scope") == "east_asia", "中文（eastAsia）字体").otherwise("西文（latin）字体")
    return findings(
        g, "format", "warning", "FMT-001", F.format_string("使用了非标准%s「%s」(%d 处)", label, "font", "n"), page=F.col("page_index"),
        context=F.concat(F.lit('"'), F.substring(F.array_join("samples", " | "), 1, 145), F.lit('"')), suggestion=F.lit("建议使用标准字体: " + ", ".join(c.allowed_fonts[:4])), location=page_label(),
        metadata=F.to_json(F.struct("font", F.col("n").alias("count"), F.col("scope").alias("font_scope"))), seq=["page_index", "first.flat_idx", "first.para_idx", "first.run_idx", "first.s"],
    )


def font_distribution(fonts: DataFrame, by: str, order: list) -> DataFrame:
    """(by, fonts: count of distinct (font, scope), top: the three most used, ties by first use)."""
    g = fonts.groupBy(by, "font", "scope").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    rows = g.groupBy(by).agg(F.count("*").alias("fonts"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "font", "scope", "n"))).alias("x"))
    return rows.select(by, "fonts", F.slice("x", 1, 3).alias("top"), F.col("x").alias("all"))


def document_fonts(t: Tables, c: Config) -> DataFrame:
    """FMT-001: too many fonts in a document."""
    rows = font_distribution(_fonts(t), "doc_id", ["page_index", "flat_idx", "para_idx", "run_idx", "s"]).where(F.col("fonts") > c.max_font_types)
    label = F.transform("top", lambda x: F.format_string("%s(%s)(%d次)", x["font"], F.when(x["scope"] == "east_asia", "中文").otherwise("西文"), x["n"]))
    shares = F.map_from_entries(F.transform("all", lambda x: F.struct(F.concat(x["font"], F.lit("/"), x["scope"]), x["n"])))
    return findings(
        rows, "format", "warning", "FMT-001", F.format_string("全文使用了 %d 种不同字体（含中英文作用域），建议统一为 2-3 种", "fonts"), suggestion=F.concat(F.lit("最常用的字体: "), F.array_join(label, ", ")),
        location=F.lit("全文"), metadata=F.to_json(F.struct(shares.alias("font_distribution"))),
    )


def font_sizes(t: Tables, c: Config) -> DataFrame:
    """FMT-002: sizes outside the range for titles or for other text."""
    (tl, th), (bl, bh) = c.title_size_range, c.body_size_range
    title = F.coalesce("is_title", F.lit(False))
    low, high = F.when(title, tl).otherwise(bl), F.when(title, th).otherwise(bh)
    size = F.col("font_size").cast("string")
    rows = _runs(t).where((F.col("font_size") < low) | (F.col("font_size") > high)).withColumn("small", F.col("font_size") < low)
    message = (
        F.when(title & F.col("small"), F.concat(F.lit("标题字号过小: "), size, F.lit(f"pt（建议 {tl}-{th}pt）"))).when(title, F.concat(F.lit("标题字号过大: "), size, F.lit(f"pt（建议 {tl}-{th}pt）")))
        .when(F.col("small"), F.concat(F.lit("正文字号偏小: "), size, F.lit(f"pt（建议 ≥ {bl}pt）"))).otherwise(F.concat(F.lit("正文字号过大: "), size, F.lit(f"pt（建议 ≤ {bh}pt）")))
    )
    advice = F.concat(F.when(title, "建议标题字号 ").otherwise("建议正文字号 "), F.when(F.col("small"), F.concat(F.lit("≥ "), low.cast("string"))).otherwise(F.concat(F.lit("≤ "), high.cast("string"))), F.lit("pt"))
    context = F.concat(F.lit('"'), F.substring(F.coalesce("text", F.lit("")), 1, 40), F.lit('" ('), size, F.lit("pt)"))
    return findings(rows, "format", "warning", "FMT-002", message, page=F.col("page_index"), context=context, suggestion=advice, location=page_label(), seq=["page_index", "flat_idx", "para_idx", "run_idx"])


def alignment_outliers(frames: DataFrame, by: list[str], order: list, tolerance: float = ALIGNMENT_TOLERANCE) -> DataFrame:
    """Frames whose top is far from the mean top of those with nearly the same left edge; adds cluster and mean_top."""
    rows = frames.where("left is not null")
    w = W.partitionBy(*by).orderBy("left", *order)
    gap = F.when(F.col("left") - F.lag("left").over(w) > tolerance, 1).otherwise(0)
    rows = rows.withColumn("gap", gap).withColumn("cluster", F.sum("gap").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("gap")
    cluster = W.partitionBy(*by, "cluster")
    rows = rows.withColumn("mean_top", F.avg("top").over(cluster)).withColumn("tops", F.count("top").over(cluster))
    return rows.where((F.col("tops") >= 2) & (F.abs(F.col("top") - F.col("mean_top")) > 2 * tolerance)).drop("tops")


def alignment(t: Tables, c: Config) -> DataFrame:
    """Text frames of one column at uneven heights (no rule id)."""
    number = t.pages.select("doc_id", "page_index", page_number().alias("page_number"))
    rows = alignment_outliers(t.elements.where("type = 'text_frame'"), ["doc_id", "page_index"], ["flat_idx"], c.alignment_tolerance).join(number, ["doc_id", "page_index"])
    name = F.coalesce(F.when(F.col("shape_name") != "", F.col("shape_name")), F.lit("文本框"))
    return findings(
        rows, "format", "info", None, F.lit("文本框垂直位置不一致，建议对齐"), page=F.col("page_index"), context=F.concat(F.lit('"'), name, F.lit('" top='), rounded(F.col("top")), F.lit("pt (同列其他 ~"), rounded(F.col("mean_top")), F.lit("pt)")),
        suggestion=F.lit("调整文本框 top 值使其与同列其他元素对齐"), location=page_label(), seq=["page_index", "cluster", "flat_idx"],
    )


def layout_reuse(pages: DataFrame, by: str = "doc_id", layout: str = "layout_name", mark: str = "标题") -> DataFrame:
    """(by, layout, uses) of marked layouts that are used more than once."""
    return pages.where(F.col(layout).contains(mark)).groupBy(by, F.col(layout).alias("layout")).agg(F.count("*").alias("uses")).where("uses > 1")


def title_layouts(t: Tables, c: Config) -> DataFrame:
    """A title layout on several pages (no rule id)."""
    rows = layout_reuse(t.pages)
    return findings(rows, "format", "info", None, F.format_string("标题版式「%s」被使用了 %d 次，建议只用于封面", "layout", "uses"), suggestion=F.lit("内容页请使用「标题和内容」或「仅内容」版式"), location=F.lit("全文"))


def paragraph_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("newlines", count(text, "\n")).withColumn("zh", cjk_count(text)).withColumn("en", count(text, "[a-zA-Z]"))


def paragraph_length(t: Tables, c: Config) -> DataFrame:
    """FMT-004: a paragraph of too many lines, Chinese characters or Latin letters."""
    rows = paragraph_counts(t.frames.where(~is_blank("text")))
    reasons = F.array_compact(F.array(
        F.when(F.col("newlines") >= c.max_explicit_newlines, F.format_string(f"显式换行 %d 行 (上限 {c.max_explicit_newlines})", "newlines")),
        F.when(F.col("zh") >= c.max_chinese_chars, F.format_string(f"中文字 %d 个 (上限 {c.max_chinese_chars})", "zh")),
        F.when(F.col("en") >= c.max_english_chars, F.format_string(f"英文字符 %d 个 (上限 {c.max_english_chars})", "en")),
    ))
    rows = rows.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    preview = F.concat(F.replace(F.substring("text", 1, 80), F.lit("\n"), F.lit("\\n")), F.when(F.length("text") > 80, "...").otherwise(""))
    return findings(
        rows, "format", "warning", "FMT-004", F.concat(F.lit("段落过长 (超过3行): "), F.array_join("reasons", "; ")), page=F.col("page_index"), context=preview, suggestion=F.lit("将长段落拆分为多个短段落或精简为要点列表 (bullet points)"),
        location=page_label(), metadata=F.to_json(F.struct(F.col("newlines").alias("newline_count"), F.col("zh").alias("chinese_chars"), F.length("text").alias("total_length"))), seq=["page_index", "flat_idx", "para_idx"],
    )


def overflow_issues(left: Column, top: Column, width: Column, height: Column, slide_width: Column, slide_height: Column, tolerance: float = OVERFLOW_TOLERANCE) -> Column:
    """Sides beyond the slide, as text; an unknown width or height leaves its side out."""
    size = lambda x, default: F.when(F.coalesce(x, F.lit(0.0)) == 0, F.lit(str(default))).otherwise(x.cast("string"))
    w, h = (F.when(F.coalesce(x, F.lit(0.0)) == 0, F.lit(float(d))).otherwise(x) for x, d in ((slide_width, SLIDE_WIDTH), (slide_height, SLIDE_HEIGHT)))
    return F.array_compact(F.array(
        F.when(left < -tolerance, F.concat(F.lit("left="), rounded(left), F.lit("pt"))),
        F.when(left + width > w + tolerance, F.concat(F.lit("right="), rounded(left + width), F.lit("pt > "), size(slide_width, SLIDE_WIDTH), F.lit("pt"))),
        F.when(top < -tolerance, F.concat(F.lit("top="), rounded(top), F.lit("pt"))),
        F.when(top + height > h + tolerance, F.concat(F.lit("bottom="), rounded(top + height), F.lit("pt > "), size(slide_height, SLIDE_HEIGHT), F.lit("pt"))),
    ))


def element_overflow(t: Tables, c: Config) -> DataFrame:
    """FMT-005: an element reaches beyond its slide."""
    size = t.documents.select("doc_id", F.expr("custom_properties['slide_width']").alias("sw"), F.expr("custom_properties['slide_height']").alias("sh"))
    number = t.pages.select("doc_id", "page_index", page_number().alias("page_number"))
    rows = t.elements.where("type is not null and left is not null and top is not null").join(size, "doc_id").join(number, ["doc_id", "page_index"])
    rows = rows.withColumn("issues", overflow_issues(*(F.col(x) for x in ("left", "top", "width", "height", "sw", "sh")))).where(F.size("issues") > 0)
    known = lambda x: F.coalesce(rounded(F.col(x)), F.lit("?"))
    name = F.coalesce(F.when(F.col("shape_name") != "", F.col("shape_name")), "type")
    context = F.concat(name, F.lit(" ("), rounded(F.col("left")), F.lit(","), rounded(F.col("top")), F.lit(","), known("width"), F.lit("x"), known("height"), F.lit(")"))
    return findings(rows, "format", "error", "FMT-005", F.concat(F.lit("元素超出页面边界: "), F.array_join("issues", "; ")), page=F.col("page_index"), context=F.substring(context, 1, 150), suggestion=F.lit("调整元素位置或大小，使其适应幻灯片边界"), location=page_label(), seq=["page_index", "flat_idx"])


def page_chars(t: Tables) -> DataFrame:
    """(doc_id, page_index, chars): paragraphs of text frames and cells of tables, without notes."""
    size = F.length("text").cast("long").alias("n")
    tables = t.elements.where("type = 'table'").select("doc_id", "page_index", "flat_idx")
    cells = t.cells.join(tables, ["doc_id", "page_index", "flat_idx"], "left_semi")
    frames = t.elements.where("type = 'text_frame'").select("doc_id", "page_index", "flat_idx")
    text = t.paragraphs.join(frames, ["doc_id", "page_index", "flat_idx"], "left_semi").select("doc_id", "page_index", size).unionByName(cells.select("doc_id", "page_index", size))
    return text.groupBy("doc_id", "page_index").agg(F.sum("n").alias("chars"))


def page_char_limit(t: Tables, c: Config) -> DataFrame:
    """FMT-003: too much text on a page."""
    number = t.pages.select("doc_id", "page_index", page_number().alias("page_number"))
    rows = page_chars(t).where(F.col("chars") > c.max_chars_per_page).join(number, ["doc_id", "page_index"])
    return findings(
        rows, "format", "warning", "FMT-003", F.format_string(f"单页文本量过大: %d 字 (上限 {c.max_chars_per_page})", "chars"), page=F.col("page_index"), context=F.format_string("共 %d 个字符", "chars"),
        suggestion=F.lit("精简文本内容或拆分为多页，确保每页信息密度合理"), location=page_label(), metadata=F.to_json(F.struct(F.col("chars").alias("total_chars"), F.lit(c.max_chars_per_page).alias("limit"))), seq=["page_index"],
    )


def low_contrast(cells: DataFrame, c: Config) -> DataFrame:
    """Cells with text and two valid colours whose contrast is under the limit for their size; adds ratio and least."""
    large = F.coalesce(F.col("font_size") >= c.large_text_threshold, F.lit(False))
    least = F.when(large, F.lit(float(c.large_text_min_contrast))).otherwise(F.lit(float(c.min_contrast)))
    rows = cells.where(~is_blank("text") & (F.col("fill_color") != "") & (F.col("font_color") != ""))
    return rows.withColumn("ratio", contrast("fill_color", "font_color")).withColumn("least", least).where("ratio < least")


def table_contrast(t: Tables, c: Config) -> DataFrame:
    """FMT-008: text of a cell hardly differs from its ground."""
    tables = t.elements.where("type = 'table'").select("doc_id", "page_index", "flat_idx")
    number = t.pages.select("doc_id", "page_index", page_number().alias("page_number"))
    rows = low_contrast(t.cells.join(tables, ["doc_id", "page_index", "flat_idx"], "left_semi"), c).join(number, ["doc_id", "page_index"])
    place = [F.col("row") + 1, F.col("col") + 1]
    limit = F.when(F.col("font_size") >= c.large_text_threshold, str(c.large_text_min_contrast)).otherwise(str(c.min_contrast))
    one = F.format_string("%.1f", F.bround("ratio", 1))
    return findings(
        rows, "format", "warning", "FMT-008", F.concat(F.lit("表格单元格文字与底色对比度不足: "), one, F.lit(":1 (阈值 "), limit, F.lit(":1)")), page=F.col("page_index"),
        context=F.concat(F.format_string("[%d行 %d列] ", *place), F.substring(strip("text"), 1, 85)), suggestion=F.concat(F.lit("深色底色配浅色文字、浅色底色配深色文字，确保对比度不低于 "), limit, F.lit(":1")),
        location=F.concat(page_label(), F.format_string(" [表格 第%d行 第%d列]", *place)), metadata=F.to_json(F.struct(F.array("row", "col").alias("cell"), "fill_color", "font_color", F.round("ratio", 2).alias("ratio"), F.col("least").alias("threshold"))),
        seq=["page_index", "flat_idx", "row", "col"],
    )


def empty_placeholders(t: Tables, c: Config) -> DataFrame:
    """FMT-006: a slide's placeholder without text."""
    filled = t.paragraphs.where(~is_blank("text")).select("doc_id", "page_index", "flat_idx")
    number = t.pages.select("doc_id", "page_index", page_number().alias("page_number"))
    rows = t.elements.where("format = 'pptx' and type = 'text_frame' and is_placeholder").join(filled, ["doc_id", "page_index", "flat_idx"], "left_anti").join(number, ["doc_id", "page_index"])
    kind = F.when(F.col("is_title"), "标题").when(F.col("is_body"), "正文").otherwise("通用")
    name = F.coalesce(F.when(F.col("shape_name") != "", F.col("shape_name")), F.lit("占位符"))
    return findings(
        rows, "format", "warning", "FMT-006", F.format_string("检测到空的%s占位符，建议填入内容或删除", kind), page=F.col("page_index"), context=F.format_string("%s (%s)", name, kind),
        suggestion=F.lit("在该占位符中填入相应内容，或从幻灯片版式中删除此占位符"), location=page_label(), metadata=F.to_json(F.struct("shape_name", kind.alias("placeholder_type"))), seq=["page_index", "flat_idx"],
    )


def bullet_mix(paragraphs: DataFrame, by: list[str], order: list, least: int = 2) -> DataFrame:
    """(by, x: (kind, first example) of each class of bullet) where there are several."""
    rows = paragraphs.withColumn("kind", bullet_class("text")).where(F.col("kind").isNotNull() & ~is_blank("text"))
    g = rows.groupBy(*by, "kind").agg(F.min_by("text", F.struct(*order)).alias("example"), F.count("*").alias("n"))
    return g.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("kind", strip(F.substring("example", 1, 50)).alias("example"), "n"))).alias("x")).where(F.size("x") >= least)


def bullet_consistency(t: Tables, c: Config) -> DataFrame:
    """FMT-007: several classes of bullets on a page."""
    rows = bullet_mix(t.frames, ["doc_id", "page_index", "page_number"], ["flat_idx", "para_idx"])
    names = F.create_map(*(F.lit(x) for kv in BULLET_NAMES.items() for x in kv))
    return findings(
        rows, "format", "info", "FMT-007", F.concat(F.lit("该页混用了多种项目符号样式: "), F.array_join(F.transform("x.kind", lambda k: F.element_at(names, k)), ", ")), page=F.col("page_index"),
        context=F.substring(F.array_join("x.example", " | "), 1, 150), suggestion=F.lit("建议统一该页的项目符号样式，选择一种并全文保持一致"), location=page_label(), metadata=F.to_json(F.struct(F.col("x.kind").alias("bullet_categories"))), seq=["page_index"],
    )
