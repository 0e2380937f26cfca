"""Registered queries over documents built from the driver's tables where these lack what a check looks for: numbered
figures, definitions of abbreviations, numbers with units, fonts, placeholders, Chinese sentences, files. Each with SQL over the same tables.

``order_pages``: a document an order, a page a line item. ``part_slides``: a slide deck a size, a shape and a run a part.
``defined``: documents in which some words are abbreviations and brackets.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirelint import sinks
from quirelint.functions.text import parenthesis_ranges
from quirelint.model import Tables, from_nested
from quirelint.operators import factual, findings, formatting, language, structure
from quirelint.plans.audit import audit, rule_findings
from quirelint.plans.rules import parse_rules
from quirelint.queries import CJK, CONFIG, EVENTS, LINES, ORDER, TITLES, event_findings, mixed_documents, query
from quirelint.repair import moves, run_fixes
from quirelint.sources import files, tables
from quirelint.sources.vocabulary import glossary

# --- documents built from line items


def order_pages(spark: SparkSession, sf_dir: str, text: Column) -> Tables:
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER))
    rows = tables.load(spark, sf_dir, "lineitem").withColumn("page_number", number).withColumn("page_index", F.col("page_number") - 1).withColumns({"doc_id": F.col("l_orderkey").cast("string"), "format": F.lit("md"), "slide_number": F.col("page_number"), "all_text": text})
    page_text = rows.select("doc_id", "format", "page_index", "page_number", "all_text", F.lit(None).cast("string").alias("notes"))
    none = {t: tables.empty(spark, t) for t in ("elements", "paragraphs", "runs", "cells")}
    return Tables(tables.shaped(rows.select("doc_id", "format").distinct(), "documents"), tables.shaped(rows, "pages"), **none, text=page_text)


ITEMS = f"items AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS INTEGER) AS page, * FROM lineitem)"
def quantity() -> Column:
    return F.concat(F.lit("Quantity for "), "l_returnflag", F.lit(" is "), F.floor("l_quantity").cast("string"), F.lit(" kW in total"))


QUANTITIES = f"{ITEMS}, q AS (SELECT doc_id, page, l_returnflag AS flag, CAST(floor(l_quantity) AS INTEGER) AS q FROM items)"


@query(f"""WITH {QUANTITIES} SELECT doc_id, 'quantity for ' || lower(flag) || ' is N kw in total' AS key, count(*) AS n, count(DISTINCT q) AS "distinct" FROM q GROUP BY ALL""")
def con001_number_groups(spark, sf_dir):
    return factual.number_groups(order_pages(spark, sf_dir, quantity())).select("doc_id", "key", "n", "distinct")


@query(f"""WITH {QUANTITIES} SELECT doc_id, min(page) - 1 AS page_index, 'error' AS severity, 'Quantity for ' || flag || ' is ' || CAST(arg_min(q, page) AS VARCHAR) || ' kW in total' AS context,
'请确认正确的数值并统一修改:' || chr(10) || string_agg('  - 第 ' || CAST(page AS VARCHAR) || ' 页: ' || CAST(q AS VARCHAR) || ' kW', chr(10) ORDER BY page) AS suggestion FROM q GROUP BY doc_id, flag HAVING count(DISTINCT q) > 1""")
def con001_numeric_consistency(spark, sf_dir):
    return factual.numeric_consistency(order_pages(spark, sf_dir, quantity()), CONFIG).select("doc_id", "page_index", "severity", "context", "suggestion")


def by_flag(**texts: str) -> Column:
    return F.create_map(*(F.lit(x) for kv in texts.items() for x in kv))[F.col("l_returnflag")]


def figure() -> Column:
    return F.concat(F.lit("As "), by_flag(A="Fig. ", N="Table ", R="Figure "), (F.col("l_linenumber") + F.col("l_partkey") % 2).cast("string"), F.lit(" shows"))


def caption() -> Column:
    return F.concat(by_flag(A="Fig. ", N="Figure ", R="图"), F.col("l_linenumber").cast("string"), by_flag(A=": ", N=" - ", R="："), F.lit("what is seen"))


FIGURES = f"{ITEMS}, f AS (SELECT doc_id, page, CASE l_returnflag WHEN 'N' THEN '表' ELSE '图' END AS kind, CASE l_returnflag WHEN 'A' THEN 'Fig. ' WHEN 'N' THEN 'Table ' ELSE 'Figure ' END AS mark, l_linenumber + l_partkey % 2 AS n FROM items)"


@query(f"""WITH {FIGURES}, p AS (SELECT *, lag(n) OVER (PARTITION BY doc_id, kind ORDER BY page) AS previous, row_number() OVER (PARTITION BY doc_id, kind, n ORDER BY page) AS occ FROM f)
SELECT doc_id, page - 1 AS page_index, mark || CAST(n AS VARCHAR) AS context, CASE WHEN occ > 1 THEN kind || '编号重复: ' || mark || CAST(n AS VARCHAR) || ' 出现多次'
WHEN n > previous + 1 THEN kind || '编号不连续: 期望 ' || kind || CAST(previous + 1 AS VARCHAR) || '，实际 ' || mark || CAST(n AS VARCHAR) || '（跳过了 ' || CAST(n - previous - 1 AS VARCHAR) || ' 个编号）'
ELSE kind || '编号倒退: 期望 ≥ ' || kind || CAST(previous + 1 AS VARCHAR) || '，实际 ' || mark || CAST(n AS VARCHAR) END AS message FROM p WHERE occ > 1 OR n > previous + 1 OR n < previous + 1""")
def str002_figure_numbering(spark, sf_dir):
    return structure.figure_numbering(order_pages(spark, sf_dir, figure()), CONFIG).select("doc_id", "page_index", "context", "message")


@query(f"""WITH {ITEMS}, c AS (SELECT doc_id, page, CASE l_returnflag WHEN 'A' THEN 'Fig.N:' WHEN 'N' THEN 'FigureN-' ELSE '图N:' END AS form, CASE l_returnflag WHEN 'A' THEN 'Fig. ' || CAST(l_linenumber AS VARCHAR) || ':' WHEN 'N' THEN 'Figure ' || CAST(l_linenumber AS VARCHAR) || ' -' ELSE '图' || CAST(l_linenumber AS VARCHAR) || '：' END AS m FROM items),
g AS (SELECT doc_id, form, arg_min(m, page) AS example FROM c GROUP BY ALL)
SELECT doc_id, '检测到 ' || CAST(count(*) AS VARCHAR) || ' 种不同的图表标题格式: ' || string_agg(form, ', ' ORDER BY form) AS message, string_agg(example, ' | ' ORDER BY form) AS context FROM g GROUP BY doc_id HAVING count(*) >= 2""")
def str007_caption_format(spark, sf_dir):
    return structure.caption_format(order_pages(spark, sf_dir, caption()), CONFIG).select("doc_id", "message", "context")


# --- abbreviations and brackets


REPLACED = ((" the ", " TSV ("), (". ", ") "), (" of ", " LIC "), (" in ", " （GaN "))


def defined_text(column: str) -> Column:
    text = F.col(column)
    for a, b in REPLACED:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def defined(spark: SparkSession, sf_dir: str) -> Tables:
    t = tables.documents(spark, sf_dir)
    return replace(t, text=t.text.withColumn("all_text", defined_text("all_text")))


def _sql_replaced(text: str) -> str:
    for a, b in REPLACED:
        text = f"replace({text}, '{a}', '{b}')"
    return text


def _places(name: str, pattern: str) -> str:
    """(doc_id, m, pos) of a pattern's matches in ``t``: the text is split at marks before each, and lengths are summed up."""
    pieces = f"string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1))"
    return f"""{name} AS (SELECT doc_id, t, k, split_part(piece, chr(2), 1) AS m, CAST(pos AS BIGINT) AS pos FROM (SELECT *, sum(length(piece) - CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos
FROM (SELECT doc_id, t, unnest({pieces}) AS piece, generate_subscripts({pieces}, 1) AS k FROM d)) WHERE k > 1)"""


BODY = "SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS body FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY doc_id"
DEFINED = f"""d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_sql_replaced("body")} AS t FROM ({BODY})),
{_places("bracket", "[（()）]")}, e AS (SELECT *, m IN (')', '）') AS closes, sum(CASE WHEN m IN (')', '）') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS n_closed FROM bracket),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM e WHERE NOT closes), j AS (SELECT *, i + max(n_closed - i) OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM o),
ranges AS (SELECT j.doc_id, j.pos AS a, c.pos AS b FROM j JOIN (SELECT *, n_closed - 1 AS nth FROM e WHERE closes) AS c ON c.doc_id = j.doc_id AND c.nth = j.nth)"""


@query(f"WITH {DEFINED} SELECT doc_id, count(*) AS n, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM ranges GROUP BY doc_id")
def parenthesis_pairs(spark, sf_dir):
    rows = defined(spark, sf_dir).page_text.select("doc_id", F.explode(parenthesis_ranges("all_text")).alias("r"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("r.a").alias("a"), F.sum("r.b").alias("b"))


OCCURRENCES = rf"""{DEFINED}, {_places("word", r"[\p{L}\p{M}\p{N}_]+")}, w AS (SELECT doc_id, m, pos, regexp_extract(substr(t, pos + length(m) + 1, 80), '^\s*\([^)]+\)') AS gloss FROM word WHERE regexp_full_match(m, '[A-Z]{{2,8}}') AND m NOT IN ({', '.join(map(repr, factual.COMMON_WORDS))})),
around AS (SELECT w.doc_id, w.pos, min(a) AS a FROM w JOIN ranges ON ranges.doc_id = w.doc_id AND a < w.pos AND w.pos < b GROUP BY ALL),
x AS (SELECT w.doc_id, m AS abbr, w.pos, coalesce(CASE WHEN gloss <> '' THEN w.pos + length(m) + strpos(gloss, '(') - 1 END, a) AS site FROM w LEFT JOIN around ON around.doc_id = w.doc_id AND around.pos = w.pos),
g AS (SELECT doc_id, abbr, count(*) AS total, count(DISTINCT site) AS definitions, arg_min(site IS NOT NULL, pos) AS at_once FROM x GROUP BY ALL)"""


def _abbreviations(spark, sf_dir, check):
    return check(defined(spark, sf_dir), CONFIG).select("doc_id", "message", "location")


@query(f"WITH {OCCURRENCES} SELECT doc_id, abbr, total, definitions FROM g")
def con003_definitions(spark, sf_dir):
    return defined(spark, sf_dir).abbreviations.select("doc_id", "abbr", "total", "definitions")


@query(f"WITH {OCCURRENCES} SELECT doc_id, '缩写「' || abbr || '」首次出现时未给出全称' AS message, '第 1 页' AS location FROM g WHERE NOT at_once")
def con003_undefined_at_first(spark, sf_dir):
    return _abbreviations(spark, sf_dir, factual.first_defined)


@query(f"WITH {OCCURRENCES} SELECT doc_id, '缩写「' || abbr || '」已定义但未再次使用，定义可能是多余的' AS message, '第 1 页' AS location FROM g WHERE (at_once OR definitions > 0) AND total <= definitions")
def con003a_defined_never_used(spark, sf_dir):
    return _abbreviations(spark, sf_dir, factual.defined_never_used)


@query(f"WITH {OCCURRENCES}, s AS (SELECT doc_id, abbr, string_agg('第 1 页', '、') AS places FROM x WHERE site IS NOT NULL GROUP BY ALL) SELECT doc_id, '缩写「' || abbr || '」被重复定义了 ' || CAST(definitions AS VARCHAR) || ' 次' AS message, places AS location FROM g JOIN s USING (doc_id, abbr) WHERE definitions >= 2")
def con003b_multiply_defined(spark, sf_dir):
    return _abbreviations(spark, sf_dir, factual.multiply_defined)


@query(f"WITH {OCCURRENCES} SELECT doc_id, '缩写「' || abbr || '」在第 1 页使用，但在第 1 页才给出定义' AS message, '第 1 页 (使用) → 第 1 页 (定义)' AS location FROM g WHERE definitions > 0 AND NOT at_once")
def con003c_used_before_defined(spark, sf_dir):
    return _abbreviations(spark, sf_dir, factual.used_before_defined)


TERMS = """
# 术语规则
## TERM-001: plain words
- 严重度: info
- 模式: "of the"
- 建议: by
## TERM-002: capitals
- 模式: 'The [a-z]+'
- 大小写敏感: true
"""
BRACKETED = """
# 术语规则
## TERM-003: outside brackets
- 严重度: nonsense
- 模式: LIC [a-z]
- 排除括号内: true
"""


def _rules(t: Tables, text: str) -> DataFrame:
    return findings.union([rule_findings(t, rule, CONFIG) for rule in parse_rules(text)])


@query("""WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'TERM-001' AS rule_id, 'info' AS severity, 'plain words' AS message, unnest(regexp_extract_all(text, '(?i)of the')) AS context, 'by' AS suggestion FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'TERM-002', 'warning', 'capitals', unnest(regexp_extract_all(text, 'The [a-z]+')), '' FROM documents) SELECT *, count(*) AS n FROM m GROUP BY ALL""")
def term_rules(spark, sf_dir):
    rows = _rules(tables.documents(spark, sf_dir), TERMS)
    return rows.groupBy("doc_id", "rule_id", "severity", "message", F.substring("context", 1, 100).alias("context"), "suggestion").agg(F.count("*").alias("n"))


@query(f"""WITH {DEFINED}, {_places("lic", "(?i)LIC [a-z]")} SELECT doc_id, 'TERM-003' AS rule_id, 'info' AS severity, m AS context, count(*) AS n FROM lic WHERE NOT EXISTS (SELECT 1 FROM ranges WHERE ranges.doc_id = lic.doc_id AND lic.pos >= a + 1 AND lic.pos + length(m) <= b) GROUP BY ALL""")
def term_outside_brackets(spark, sf_dir):
    return _rules(defined(spark, sf_dir), BRACKETED).groupBy("doc_id", "rule_id", "severity", "context").agg(F.count("*").alias("n"))


# --- slides built from parts


def part_slides(spark: SparkSession, sf_dir: str) -> Tables:
    k = F.col("p_partkey")
    text = F.when(k % 11 == 0, " ").when(k % 6 == 0, F.concat(F.lit("- "), "p_name")).when(k % 6 == 1, F.concat("p_name", F.lit("。"))).when(k % 6 == 2, F.concat("p_name", F.lit("中x"))).otherwise(F.col("p_name"))
    rows = tables.load(spark, sf_dir, "part").select(
        F.col("p_size").cast("string").alias("doc_id"), F.lit("pptx").alias("format"), (k % 7).cast("int").alias("page_index"), (k % 7 + 1).cast("int").alias("slide_number"), k.cast("int").alias("flat_idx"), F.lit(0).alias("depth"), F.lit("text_frame").alias("type"),
        F.lit(0).alias("para_idx"), F.lit(0).alias("run_idx"), text.alias("text"), F.when(k % 3 == 0, "Arial").otherwise(F.col("p_brand")).alias("font_name"), F.when(k % 4 == 0, F.col("p_type")).alias("font_name_east_asia"), (k % 40 + 8).cast("double").alias("font_size"),
        (k % 5 == 0).alias("is_title"), (k % 3 == 1).alias("is_body"), (k % 2 == 0).alias("is_placeholder"), F.when(k % 4 == 1, F.lit("Box")).alias("shape_name"),
        (F.col("p_retailprice") - 950).alias("left"), (k % 700 - 50).cast("double").alias("top"), (k % 300).cast("double").alias("width"), (k % 90).cast("double").alias("height"),
    )
    size = F.create_map(F.lit("slide_width"), F.lit(960.0), F.lit("slide_height"), F.lit(540.0))
    docs = rows.select("doc_id", "format").distinct().withColumn("custom_properties", size)
    pages = rows.select("doc_id", "format", "page_index", "slide_number").distinct()
    return Tables(tables.shaped(docs, "documents"), tables.shaped(pages, "pages"), tables.shaped(rows, "elements"), tables.shaped(rows, "paragraphs"), tables.shaped(rows, "runs"), tables.empty(spark, "cells"))


SLIDES = """r AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS doc_id, CAST(p_partkey % 7 AS INTEGER) AS page_index, CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 6 = 0 THEN '- ' || p_name WHEN p_partkey % 6 = 1 THEN p_name || '。' WHEN p_partkey % 6 = 2 THEN p_name || '中x' ELSE p_name END AS text,
CASE WHEN p_partkey % 3 = 0 THEN 'Arial' ELSE p_brand END AS latin, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS east, CAST(p_partkey % 40 + 8 AS DOUBLE) AS size, p_partkey % 5 = 0 AS title, p_partkey % 3 = 1 AS body, p_partkey % 2 = 0 AS holder, CASE WHEN p_partkey % 4 = 1 THEN 'Box' END AS shape,
p_retailprice - 950 AS l, CAST(p_partkey % 700 - 50 AS DOUBLE) AS t, CAST(p_partkey % 300 AS DOUBLE) AS w, CAST(p_partkey % 90 AS DOUBLE) AS h FROM part)"""
ALLOWED = "('微软雅黑', 'Arial', 'Calibri', 'Noto Sans SC')"


@query(f"""WITH {SLIDES}, f AS (SELECT *, latin AS font, '西文（latin）字体' AS label FROM r UNION ALL SELECT *, east, '中文（eastAsia）字体' FROM r WHERE east IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, font, label ORDER BY k) AS i FROM f WHERE font NOT IN {ALLOWED})
SELECT doc_id, page_index, '使用了非标准' || label || '「' || font || '」(' || CAST(count(*) AS VARCHAR) || ' 处)' AS message, '"' || substr(string_agg(substr(text, 1, 50), ' | ' ORDER BY k) FILTER (WHERE i <= 3), 1, 145) || '"' AS context FROM o GROUP BY doc_id, page_index, font, label""")
def fmt001_page_fonts(spark, sf_dir):
    return formatting.page_fonts(part_slides(spark, sf_dir), CONFIG).select("doc_id", "page_index", "message", "context")


@query(f"""WITH {SLIDES}, b AS (SELECT *, CASE WHEN title THEN 28 ELSE 12 END AS low, CASE WHEN title THEN 40 ELSE 22 END AS high FROM r)
SELECT doc_id, page_index, CASE WHEN title AND size < low THEN '标题字号过小: ' || CAST(size AS VARCHAR) || 'pt（建议 28-40pt）' WHEN title THEN '标题字号过大: ' || CAST(size AS VARCHAR) || 'pt（建议 28-40pt）' WHEN size < low THEN '正文字号偏小: ' || CAST(size AS VARCHAR) || 'pt（建议 ≥ 12pt）' ELSE '正文字号过大: ' || CAST(size AS VARCHAR) || 'pt（建议 ≤ 22pt）' END AS message,
'"' || substr(text, 1, 40) || '" (' || CAST(size AS VARCHAR) || 'pt)' AS context, CASE WHEN title THEN '建议标题字号 ' ELSE '建议正文字号 ' END || CASE WHEN size < low THEN '≥ ' || CAST(low AS VARCHAR) ELSE '≤ ' || CAST(high AS VARCHAR) END || 'pt' AS suggestion FROM b WHERE size < low OR size > high""")
def fmt002_font_sizes(spark, sf_dir):
    return formatting.font_sizes(part_slides(spark, sf_dir), CONFIG).select("doc_id", "page_index", "message", "context", "suggestion")


@query(f"""WITH {SLIDES}, p AS (SELECT *, CASE WHEN title THEN '标题' WHEN body THEN '正文' ELSE '通用' END AS kind FROM r WHERE holder AND trim(text) = '')
SELECT doc_id, page_index, '检测到空的' || kind || '占位符，建议填入内容或删除' AS message, coalesce(shape, '占位符') || ' (' || kind || ')' AS context FROM p""")
def fmt006_empty_placeholders(spark, sf_dir):
    return formatting.empty_placeholders(part_slides(spark, sf_dir), CONFIG).select("doc_id", "page_index", "message", "context")


@query(f"""WITH {SLIDES}, s AS (SELECT *, CASE WHEN latin NOT IN {ALLOWED} THEN '微软雅黑' ELSE latin END AS new_font, CASE WHEN size > 0 AND size < 12 THEN 12.0 ELSE size END AS new_size,
CASE WHEN east IS NULL THEN CASE WHEN latin NOT IN {ALLOWED} THEN '微软雅黑' END WHEN east NOT IN {ALLOWED} THEN '微软雅黑' ELSE east END AS new_east, regexp_replace(regexp_replace(text, '([{CJK}])([a-zA-Z0-9])', '\\1 \\2', 'g'), '([a-zA-Z0-9])([{CJK}])', '\\1 \\2', 'g') AS spaced FROM r),
x AS (SELECT *, regexp_replace(CASE WHEN title THEN regexp_replace(spaced, '[。，、.!,;；：…—]+$', '') ELSE spaced END, '^(\\s*)[-*](\\s)', '\\1•\\2') AS new_text FROM s),
c AS (SELECT *, CAST(new_font <> latin AS INTEGER) + CAST(new_east IS DISTINCT FROM east AS INTEGER) + CAST(new_size <> size AS INTEGER) + CAST(new_text <> text AS INTEGER) AS fixes FROM x) SELECT doc_id, CAST(k AS INTEGER) AS flat_idx, new_font, new_east, new_size, new_text, fixes FROM c WHERE fixes > 0""")
def fix_runs(spark, sf_dir):
    return run_fixes(part_slides(spark, sf_dir), CONFIG).select("doc_id", "flat_idx", "new_font", "new_east", "new_size", "new_text", "fixes")


@query(f"""WITH {SLIDES}, a AS (SELECT *, greatest(l, 0.0) AS l0, greatest(t, 0.0) AS t0 FROM r), b AS (SELECT *, CASE WHEN l0 + w > 960 THEN greatest(0.0, 960 - w) ELSE l0 END AS l1, CASE WHEN t0 + h > 540 THEN greatest(0.0, 540 - h) ELSE t0 END AS t1 FROM a)
SELECT doc_id, CAST(k AS INTEGER) AS flat_idx, round(l1, 6) AS new_left, round(t1, 6) AS new_top FROM b WHERE l <> l1 OR t <> t1""")
def fix_moves(spark, sf_dir):
    return moves(part_slides(spark, sf_dir)).select("doc_id", "flat_idx", F.round("new_left", 6).alias("new_left"), F.round("new_top", 6).alias("new_top"))


@query("WITH l AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Blank' ELSE role END AS layout FROM conversations) SELECT CAST(conv_id AS VARCHAR) AS doc_id, '共 ' || CAST(count(*) AS VARCHAR) || ' 页，版式: ' || min(layout) AS context, 'info' AS severity FROM l GROUP BY conv_id HAVING count(DISTINCT layout) = 1 AND min(layout) <> ''")
def str008_single_layout(spark, sf_dir):
    t = tables.decks(spark, sf_dir)
    blank = F.when(F.col("doc_id").cast("long") % 3 == 0, "Blank").otherwise(F.col("layout_name"))
    return structure.layout_variety(replace(t, pages=t.pages.withColumn("layout_name", blank)), CONFIG).select("doc_id", "context", "severity")


@query(rf"""WITH {LINES}, b AS (SELECT doc_id, CASE WHEN starts_with(line, 'The ') THEN '- ' || substr(line, 5) WHEN starts_with(line, 'And ') THEN '  * ' || substr(line, 5) ELSE line END AS line FROM lines) SELECT doc_id, regexp_replace(line, '^(\s*)[-*](\s)', '\1•\2') AS fixed FROM b WHERE regexp_matches(line, '^\s*[-*]\s')""")
def fix_bullets(spark, sf_dir):
    from quirelint.repair import one_bullet

    text = F.regexp_replace(F.regexp_replace("text", "^The ", "- "), "^And ", "  * ")
    rows = tables.documents(spark, sf_dir).paragraphs.withColumn("text", text)
    return rows.select("doc_id", "text", one_bullet(F.col("text")).alias("fixed")).where("fixed <> text").drop("text")


# --- languages


ZH = ((" the ", "，仔细的的了了在"), (" and ", "很快的约三左右。。"), (" of ", "通过它了，，"))


def chinese(spark: SparkSession, sf_dir: str) -> Tables:
    t = tables.documents(spark, sf_dir)
    text = F.col("all_text")
    for a, b in ZH:
        text = F.replace(text, F.lit(a), F.lit(b))
    return replace(t, text=t.text.withColumn("all_text", text))


MIXED_BODY = f"d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(replace(body, 'th', '中'), 'er', '，') AS t FROM ({BODY}))"


def _mixed_sql() -> str:
    parts, unions = [MIXED_BODY], []
    for i, (pattern, (_, _, rule, _, radius)) in enumerate(zip((f"([a-zA-Z0-9])([{CJK}])", f"([{CJK}])([a-zA-Z0-9])", "([a-zA-Z0-9])([，。；：！？])"), language.MIXED, strict=True)):
        said = "'将「' || substr(m, 2, 1) || '」改为对应的英文标点'" if rule.endswith("3") else "'「' || m || '」→ 「' || substr(m, 1, 1) || ' ' || substr(m, 2, 1) || '」'"
        parts.append(_places(f"p{i}", pattern))
        parts.append(f"f{i} AS (SELECT *, substr(t, greatest(pos - {radius}, 0) + 1, pos + 2 + {radius} - greatest(pos - {radius}, 0)) AS around, {said} AS said FROM p{i} WHERE k <= 6)")
        parts.append(f"s{i} AS (SELECT doc_id, string_agg(said, '; ' ORDER BY k) AS suggestion FROM (SELECT doc_id, said, min(k) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY min(k)) AS nth FROM f{i} GROUP BY doc_id, said) WHERE nth <= 3 GROUP BY doc_id)")
        unions.append(f"SELECT doc_id, '{rule}' AS rule_id, c AS context, suggestion FROM (SELECT doc_id, substr(string_agg(around, ' | ' ORDER BY k), 1, 150) AS c FROM f{i} GROUP BY doc_id) JOIN s{i} USING (doc_id)")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(unions)}"


@query(_mixed_sql())
def fmt_mixed_contexts(spark, sf_dir):
    return language.mixed_formatting(mixed_documents(spark, sf_dir), CONFIG).select("doc_id", "rule_id", "context", "suggestion")


NEAR = """
category: near
terms:
  - {pattern: 'of the', preferred: 'by', severity: info}
  - {pattern: 'and', preferred: 'to', context: also}
"""


@query(rf"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, body AS t FROM ({BODY})), {_places("p0", "(?i)of the")}, {_places("p1", "(?i)and")},
a AS (SELECT *, 'info' AS severity, 'by' AS word FROM p0 UNION ALL SELECT *, 'warning', 'to' FROM p1), w AS (SELECT *, substr(t, greatest(pos - 60, 0) + 1, pos + length(m) + 60 - greatest(pos - 60, 0)) AS around FROM a)
SELECT doc_id, severity, m AS context, word AS suggestion, count(*) AS n FROM w WHERE NOT regexp_matches(around, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])' || word || '($|[^\p{{L}}\p{{M}}\p{{N}}_])') GROUP BY ALL""")
def glossary_near(spark, sf_dir):
    """Wordings without the preferred one within 60 characters."""
    rows = language.glossary_terms(tables.documents(spark, sf_dir), replace(CONFIG, glossary=tuple(glossary(NEAR))))
    return rows.groupBy("doc_id", "severity", "context", "suggestion").agg(F.count("*").alias("n"))


def _chinese_sql() -> str:
    text = "body"
    for a, b in ZH:
        text = f"replace({text}, '{a}', '{b}')"
    patterns = ", ".join(f"{{'p': '{p}', 'm': '{m.replace(chr(39), chr(39) * 2)}'}}" for p, m in language.GRAMMAR if "(?!" not in p)
    return f"""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all({text}, '[A-Za-z][^{CJK}]*|[^A-Za-z]+')) AS piece FROM ({BODY})), z AS (SELECT * FROM s WHERE NOT regexp_matches(piece, '^[A-Za-z]') AND length(trim(piece)) >= 5), r AS (SELECT *, unnest([{patterns}]) AS r FROM z),
f AS (SELECT doc_id, r.m AS message, unnest(regexp_extract_all(piece, r.p)) AS found FROM r) SELECT doc_id, message, count(*) AS n FROM f GROUP BY ALL"""


@query(_chinese_sql())
def py_zh_grammar(spark, sf_dir):
    """Chinese grammar; the one pattern with a look-ahead (of 良率 and 底) has no match here."""
    return language.chinese_grammar(chinese(spark, sf_dir), CONFIG).groupBy("doc_id", "message").agg(F.count("*").alias("n"))


@query(rf"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(body, '^[^A-Za-z]+', '') AS text FROM ({BODY})),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS m, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+'), 1) AS i FROM t), l AS (SELECT *, lower(m) AS word FROM w WHERE regexp_full_match(m, '[a-zA-Z]{{4,}}')),
c AS (SELECT doc_id, word, min(i) AS i FROM l WHERE NOT (m = upper(m) OR (length(regexp_replace(m, '[^A-Z]', '', 'g')) >= 2 AND regexp_matches(m, '[a-z]'))) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM c),
known AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark)
SELECT l.doc_id, '可能的拼写错误: ''' || word || '''' AS message, count(*) AS n FROM l JOIN k USING (doc_id, word) WHERE nth <= 100 AND word NOT IN (SELECT word FROM known) GROUP BY ALL""")
def py_spell(spark, sf_dir):
    """Spelling, with the words of the benchmark as dictionary."""
    words = tables.load(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return language.spelling(tables.documents(spark, sf_dir), CONFIG, words).groupBy("doc_id", "message").agg(F.count("*").alias("n"))


# --- files, reports, batches


def _file(column: str = "text") -> Column:
    return F.translate(F.coalesce(column, F.lit("")), "#|`~*+-_0123456789:﻿", "")


@query(r"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) || '.md' AS doc_id, string_split(regexp_replace(translate(coalesce(text, ''), '#|`~*+-_0123456789:' || chr(65279), ''), '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM t), b AS (SELECT *, regexp_matches(line, '\S') AS filled, coalesce(lag(regexp_matches(line, '\S')) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM l)
SELECT doc_id, greatest(count(*) FILTER (WHERE filled AND NOT before), 1) AS elements, coalesce(sum(len(regexp_extract_all(line, '\S+'))), 0)::INTEGER AS words FROM b GROUP BY doc_id""")
def source_markdown(spark, sf_dir):
    """Documents as Markdown files without marks: an element for each run of lines."""
    rows = tables.load(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.encode(_file(), "utf-8").alias("content"))
    t = from_nested(files.parse(rows))
    return t.elements.groupBy("doc_id").agg(F.count("*").alias("elements")).join(t.documents.select("doc_id", F.col("word_count").alias("words")), "doc_id")


@query("SELECT CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '.ppt' ELSE '.docx' END AS source_path, CASE WHEN doc_id % 2 = 0 THEN 'ValueError: no parser for .ppt' ELSE 'BadZipFile: File is not a zip file' END AS error FROM documents")
def source_errors(spark, sf_dir):
    """Files of old or broken formats become rows of errors."""
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".ppt").otherwise(".docx"))
    rows = tables.load(spark, sf_dir, "documents").select(name.alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    return from_nested(files.parse(rows)).errors.select("source_path", "error")


@query(f"""WITH {LINES}, x AS (SELECT doc_id, sum(length(line)) AS n FROM lines GROUP BY doc_id HAVING sum(length(line)) > 200)
SELECT doc_id, coalesce(CAST(n > 200 AS BIGINT), 0) AS total_findings, coalesce(CAST(n > 200 AS BIGINT), 0) AS warnings, coalesce(CAST(n > 200 AS BIGINT), 0) AS by_type, CASE WHEN n > 200 THEN '单页文本量过大: ' || CAST(n AS VARCHAR) || ' 字 (上限 200)' END AS message FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents) LEFT JOIN x USING (doc_id)""")
def json_reports_read_back(spark, sf_dir):
    t = tables.documents(spark, sf_dir)
    t = replace(t, documents=t.documents.withColumn("source_path", F.col("doc_id")))
    found = findings.deduplicate(findings.union([formatting.page_char_limit(t, CONFIG)]))
    documents, items = sinks.read_json(sinks.json_reports(t, found))
    documents = documents.select(F.col("source_file").alias("doc_id"), "total_findings", "warnings", F.coalesce(F.aggregate(F.map_values("by_type"), F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0)).alias("by_type"))
    return documents.join(items.select(F.col("source_file").alias("doc_id"), "message"), "doc_id", "left")


@query(f"""WITH {TITLES}, x AS (SELECT host, count(*) FILTER (WHERE regexp_matches(title, '[。，、.!,;；：…—]+$')) AS n FROM titles GROUP BY host)
SELECT (SELECT count(DISTINCT host) FROM titles) AS documents, (SELECT count(*) FROM titles) AS pages, 0 AS error, sum(n)::BIGINT AS warning, 0 AS info, sum(n)::BIGINT AS total FROM x""")
def batch_totals(spark, sf_dir):
    t = tables.sites(spark, sf_dir)
    return findings.batch_totals(t.pages, structure.title_punctuation(t, CONFIG).withColumn("severity", F.lit("warning")))


KEYED = f"{EVENTS}, r AS (SELECT *, CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS g FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type, coalesce(rule_id, ''), coalesce(page_index, -1), context ORDER BY g DESC, event_id) AS n FROM r)"


@query(f"WITH {KEYED} SELECT event_id, severity FROM k WHERE n = 1 AND severity IN ('error', 'warning') AND event_id % 5 <> 0 AND event_id % 7 <> 0")
def filter_exempt(spark, sf_dir):
    """Findings less those exempt by either of two lists."""
    found = findings.deduplicate(event_findings(spark, sf_dir))
    exempt = findings.exempted(found.where("event_id % 5 = 0"), found.where("event_id % 7 = 0"))
    return findings.filtered(found, exempt=exempt).select("event_id", "severity")


@query(f"""WITH {KEYED} SELECT doc_id, event_id, row_number() OVER (PARTITION BY doc_id ORDER BY g DESC, event_id) AS nth FROM k WHERE n = 1""")
def ordered_findings(spark, sf_dir):
    """Errors, warnings, then the rest, each as found."""
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy(-findings.rank(), "seq"))
    return findings.deduplicate(event_findings(spark, sf_dir)).select("doc_id", "event_id", nth.cast("long").alias("nth"))


SLIDE_RULES = "# 格式规则\n## FMT-006: p\n- 严重度: error\n- 检查: empty_placeholder\n## X-1: no such\n- 检查: nothing_known\n"


@query(f"""WITH {SLIDES}, f AS (SELECT doc_id, page_index, latin AS font, '西文（latin）字体' AS label FROM r WHERE latin NOT IN {ALLOWED} UNION ALL SELECT doc_id, page_index, east, '中文（eastAsia）字体' FROM r WHERE east NOT IN {ALLOWED}), docs AS (SELECT count(DISTINCT doc_id) AS n FROM r)
SELECT 'SYS-ERROR' AS rule_id, 'error' AS severity, n FROM docs UNION ALL SELECT 'FMT-006', 'error', count(*) FROM (SELECT DISTINCT doc_id, page_index, coalesce(shape, '占位符') || CASE WHEN title THEN '标题' WHEN body THEN '正文' ELSE '通用' END FROM r WHERE holder AND trim(text) = '')
UNION ALL SELECT 'FMT-002', 'warning', count(*) FROM (SELECT DISTINCT doc_id, page_index, substr(text, 1, 40), size FROM r WHERE size < CASE WHEN title THEN 28 ELSE 12 END OR size > CASE WHEN title THEN 40 ELSE 22 END)""")
def audit_slides(spark, sf_dir):
    """The whole audit of slides, with a rule for a check that nothing registered; counts of three of its rules."""
    out = audit(part_slides(spark, sf_dir), parse_rules(SLIDE_RULES))
    return out.where(F.col("rule_id").isin("SYS-ERROR", "FMT-006", "FMT-002")).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))
