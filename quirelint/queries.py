"""The registered queries of the audit operators over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelint.functions import text as tx
from quirelint.model import Tables
from quirelint.operators import factual, findings, formatting, language, structure
from quirelint.plans.audit import audit
from quirelint.plans.rules import Config, parse_rules
from quirelint.repair import without_end_marks
from quirelint.sources import tables
from quirelint.sources.vocabulary import glossary, rejected
from quirelint.streaming.audits import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CONFIG = Config()
SECTIONS = ("the", "und", "introduction")
REJECTED = ["stupid # rude", "idiot # rude", "(?:moron|loser)s? # rude"]
RULES = """
# 格式规则
## FMT-003: page text
- 严重度: warning
- 检查: per_page_char_limit
- 最大字数: 200
# 内容规则
## CON-002: sections
- 章节: [the, und, introduction]
## CON-003: abbreviations
- 严重度: error
- 检查: abbreviation_first_defined
# 结构规则
## STR-002: numbering
- 严重度: error
- 检查: figure_numbering_sequential
"""
GLOSSARY = """
category: plain
terms:
  - {pattern: 'license[ds]?', preferred: 'permit (LIC)', context: wording}
  - {pattern: 'under the', preferred: 'by', severity: info}
"""

CJK = "一-鿿㐀-䶿豈-﫿"
#: the text with Chinese characters in it, which the tables have none of
MIXED_SQL = "replace(replace(text, 'th', '中'), 'er', '，')"
LINES = "lines AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"
TITLES = "titles AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, page_id, trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS title FROM pages)"
WORDS = r"words AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')) AS w FROM documents)"
EVENTS = "f AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity, event_type AS type, CASE WHEN event_id % 3 = 0 THEN 'R-' || CAST(event_id % 7 AS VARCHAR) END AS rule_id, CAST(CASE WHEN event_id % 5 > 0 THEN event_id % 11 END AS INTEGER) AS page_index, props AS context, event_id FROM events)"


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def mixed(column: str = "text"):
    return F.replace(F.replace(F.col(column), F.lit("th"), F.lit("中")), F.lit("er"), F.lit("，"))


def mixed_documents(spark: SparkSession, sf_dir: str) -> Tables:
    t = tables.documents(spark, sf_dir)
    return replace(t, text=t.text.withColumn("all_text", mixed("all_text")))


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of findings."""
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    rule = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("R-"), (F.col("event_id") % 7).cast("string")))
    page = F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 11).cast("int")
    return tables.load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("type"), severity.alias("severity"), rule.alias("rule_id"), page.alias("page_index"), F.col("props").alias("context"), F.array(F.col("event_id").cast("int")).alias("seq"), "event_id",
    )


# --- page and paragraph checks


@query(f"""WITH {LINES} SELECT doc_id, 0 AS page_index, '单页文本量过大: ' || CAST(sum(length(line)) AS VARCHAR) || ' 字 (上限 200)' AS message, 'warning' AS severity
FROM lines GROUP BY doc_id HAVING sum(length(line)) > 200""")
def fmt003_page_char_limit(spark, sf_dir):
    return formatting.page_char_limit(tables.documents(spark, sf_dir), CONFIG).select("doc_id", "page_index", "message", "severity")


@query(f"""WITH {LINES}, c AS (SELECT doc_id, line, length(regexp_replace(line, '[^a-zA-Z]', '', 'g')) AS en FROM lines)
SELECT doc_id, '段落过长 (超过3行): 英文字符 ' || CAST(en AS VARCHAR) || ' 个 (上限 300)' AS message, substr(line, 1, 80) || CASE WHEN length(line) > 80 THEN '...' ELSE '' END AS context FROM c WHERE en >= 300""")
def fmt004_paragraph_length(spark, sf_dir):
    return formatting.paragraph_length(tables.documents(spark, sf_dir), CONFIG).select("doc_id", "message", "context")


@query(rf"""WITH {LINES}, k AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^\s*[•◦▪▸◆\-*]\s') THEN 'symbol' WHEN regexp_matches(line, '^\s*(?:\d+[\.\)]\s|\(\d+\)\s|[①②③④⑤⑥⑦⑧⑨⑩]\s)') THEN 'numbered'
WHEN regexp_matches(line, '^\s*(?:[a-zA-Z][\.\)]\s|\([a-zA-Z]\)\s)') THEN 'lettered' END AS kind FROM lines WHERE trim(line) <> '') SELECT doc_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL""")
def fmt007_bullet_classes(spark, sf_dir):
    rows = formatting.bullet_mix(tables.documents(spark, sf_dir).paragraphs, ["doc_id"], ["para_idx"], least=1)
    return rows.select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.kind", "x.n")


@query(f"""WITH {TITLES}, c AS (SELECT *, length(regexp_extract_all(title, '[a-zA-Z]+(?:''[a-z]+)?')) AS en, 0 AS zh FROM titles)
SELECT host AS doc_id, CAST(page_id AS INTEGER) AS page_index, '标题过长: ' || CAST(en AS VARCHAR) || ' 英文词 / 0 中文字' AS message, substr(title, 1, 100) AS context FROM c WHERE en > 10""")
def str004_title_length(spark, sf_dir):
    return structure.title_length(tables.sites(spark, sf_dir), CONFIG).select("doc_id", "page_index", "message", "context")


@query(f"""WITH {TITLES}, g AS (SELECT host, lower(title) AS t, count(*) AS n, min(page_id) AS p, string_agg('第 ' || CAST(page_id + 1 AS VARCHAR) || ' 页', ', ' ORDER BY page_id) AS places FROM titles WHERE title <> '' GROUP BY 1, 2 HAVING count(*) > 1)
SELECT host AS doc_id, CAST(p AS INTEGER) AS page_index, '重复标题: 「' || substr(t, 1, 50) || '」在 ' || CAST(n AS VARCHAR) || ' 张幻灯片中出现' AS message, places AS location FROM g""")
def str005_duplicate_title(spark, sf_dir):
    return structure.duplicate_titles(tables.sites(spark, sf_dir), CONFIG).select("doc_id", "page_index", "message", "location")


@query(f"""WITH {TITLES}, m AS (SELECT *, regexp_extract(title, '[。，、.!,;；：…—]+$') AS mark FROM titles)
SELECT host AS doc_id, CAST(page_id AS INTEGER) AS page_index, '标题末尾含有多余标点: 「' || mark || '」' AS message FROM m WHERE mark <> ''""")
def str006_title_punctuation(spark, sf_dir):
    return structure.title_punctuation(tables.sites(spark, sf_dir), CONFIG).select("doc_id", "page_index", "message")


@query(f"""WITH {TITLES} SELECT page_id, regexp_replace(title, '[。，、.!,;；：…—]+$', '') AS fixed FROM titles WHERE regexp_matches(title, '[。，、.!,;；：…—]+$')""")
def fix_title_punctuation(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "pages").select("page_id", tx.strip(tables.title("html")).alias("title"))
    return rows.withColumn("fixed", without_end_marks(F.col("title"))).where("fixed <> title").drop("title")


@query(f"""WITH m AS (SELECT doc_id, {MIXED_SQL} AS t FROM documents) SELECT doc_id, md5(regexp_replace(regexp_replace(t, '([{CJK}])([a-zA-Z0-9])', '\\1 \\2', 'g'), '([a-zA-Z0-9])([{CJK}])', '\\1 \\2', 'g')) AS fixed FROM m""")
def fix_spacing(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select("doc_id", F.md5(tx.space_mixed(mixed())).alias("fixed"))


# --- ordered checks


ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber AS level, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS previous FROM lineitem) SELECT l_orderkey, level, previous FROM p WHERE level > previous + 1""")
def str003_heading_jumps(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "lineitem").withColumn("level", F.col("l_linenumber"))
    return structure.heading_jumps(rows, ["l_orderkey"], ORDER).select("l_orderkey", "level", "previous")


@query(f"""WITH p AS (SELECT l_orderkey, l_partkey, l_linenumber AS n, lag(l_linenumber) OVER w AS previous, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(ORDER)}) AS occ FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)})),
x AS (SELECT *, CASE WHEN occ > 1 THEN 'repeated' WHEN n > previous + 1 THEN 'skipped' WHEN n < previous + 1 THEN 'back' END AS fault FROM p) SELECT l_orderkey, l_partkey, n, previous, fault FROM x WHERE fault IS NOT NULL""")
def str002_sequence_faults(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "lineitem").withColumn("n", F.col("l_linenumber"))
    return structure.sequence_faults(rows, ["l_orderkey"], ORDER).select("l_orderkey", "l_partkey", "n", "previous", "fault")


@query("""WITH e AS (SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE) * 2000, 3) AS l, round(CAST(embedding[2] AS DOUBLE) * 2000, 3) AS t FROM embeddings),
g AS (SELECT *, CASE WHEN l - lag(l) OVER (PARTITION BY label ORDER BY l, vec_id) > 5 THEN 1 ELSE 0 END AS gap FROM e),
c AS (SELECT *, sum(gap) OVER (PARTITION BY label ORDER BY l, vec_id ROWS UNBOUNDED PRECEDING) AS cluster FROM g),
m AS (SELECT *, avg(t) OVER (PARTITION BY label, cluster) AS mean, count(t) OVER (PARTITION BY label, cluster) AS n FROM c)
SELECT vec_id, CAST(cluster AS BIGINT) AS cluster, round(mean, 4) AS mean_top FROM m WHERE n >= 2 AND abs(t - mean) > 10""")
def fmt_alignment_outliers(spark, sf_dir):
    at = lambda i: F.round(F.col("embedding")[i].cast("double") * 2000, 3)
    rows = tables.load(spark, sf_dir, "embeddings").select("vec_id", "label", at(0).alias("left"), at(1).alias("top"))
    return formatting.alignment_outliers(rows, ["label"], ["vec_id"]).select("vec_id", "cluster", F.round("mean_top", 4).alias("mean_top"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 2000 AS l, CAST(embedding[2] AS DOUBLE) * 2000 AS t, abs(CAST(embedding[3] AS DOUBLE)) * 4000 AS w, abs(CAST(embedding[4] AS DOUBLE)) * 4000 AS h FROM embeddings),
n AS (SELECT vec_id, CAST(l < -5 AS INTEGER) + CAST(l + w > 965 AS INTEGER) + CAST(t < -5 AS INTEGER) + CAST(t + h > 545 AS INTEGER) AS sides FROM e) SELECT * FROM n WHERE sides > 0""")
def fmt005_element_overflow(spark, sf_dir):
    at = lambda i, k: F.col("embedding")[i].cast("double") * k
    none = F.lit(None).cast("double")
    issues = formatting.overflow_issues(at(0, 2000), at(1, 2000), F.abs(at(2, 1)) * 4000, F.abs(at(3, 1)) * 4000, none, none)
    return tables.load(spark, sf_dir, "embeddings").select("vec_id", F.size(issues).alias("sides")).where("sides > 0")


# --- layouts, fonts, colours


@query("""WITH g AS (SELECT p_size, p_brand, p_type, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY n DESC, first) AS k, count(*) OVER (PARTITION BY p_size) AS fonts FROM g)
SELECT p_size, fonts, string_agg(p_brand || '/' || p_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY ALL""")
def fmt001_font_distribution(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "part").select("p_size", "p_partkey", F.col("p_brand").alias("font"), F.col("p_type").alias("scope"))
    top = F.transform("top", lambda x: F.concat(x["font"], F.lit("/"), x["scope"], F.lit(":"), x["n"].cast("string")))
    return formatting.font_distribution(rows, "p_size", ["p_partkey"]).select("p_size", "fonts", F.array_join(top, ",").alias("top"))


@query("SELECT conv_id, role AS layout, count(*) AS uses FROM conversations WHERE contains(role, 'user') GROUP BY ALL HAVING count(*) > 1")
def fmt_layout_reuse(spark, sf_dir):
    return formatting.layout_reuse(tables.load(spark, sf_dir, "conversations"), "conv_id", "role", "user")


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'STR-001' AS rule_id, '第 1 页 [' || role || ']' AS location FROM conversations WHERE turn = 0 AND NOT contains(role, '标题')")
def str001_title_slide(spark, sf_dir):
    return structure.title_slide(tables.decks(spark, sf_dir), CONFIG).select("doc_id", "rule_id", "location")


@query("""WITH p AS (SELECT conv_id, turn, role, text, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS n FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INTEGER) AS page_index, '第 ' || CAST(turn + 1 AS VARCHAR) || ' 页' AS location FROM p WHERE NOT contains(lower(coalesce(text, '')), 'answer') AND NOT contains(lower(coalesce(text, '')), 'the') AND n < 3 AND NOT contains(lower(role), 'system')""")
def con004_conclusions(spark, sf_dir):
    c = replace(CONFIG, conclusion_keywords=("answer", "The"), exempt_layouts=("System",))
    return structure.conclusions(tables.decks(spark, sf_dir), c).select("doc_id", "page_index", "location")


@query("""WITH c AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS a, (p_partkey * 104729 + 255) % 16777216 AS b FROM part),
s AS (SELECT p_partkey, [(a // 65536) / 255.0, (a // 256) % 256 / 255.0, a % 256 / 255.0] AS x, [(b // 65536) / 255.0, (b // 256) % 256 / 255.0, b % 256 / 255.0] AS y FROM c),
l AS (SELECT p_partkey, list_transform(x, lambda v: CASE WHEN v <= 0.03928 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END) AS x, list_transform(y, lambda v: CASE WHEN v <= 0.03928 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END) AS y FROM s),
m AS (SELECT p_partkey, 0.2126 * x[1] + 0.7152 * x[2] + 0.0722 * x[3] AS x, 0.2126 * y[1] + 0.7152 * y[2] + 0.0722 * y[3] AS y FROM l),
r AS (SELECT p_partkey, (greatest(x, y) + 0.05) / (least(x, y) + 0.05) AS ratio FROM m) SELECT p_partkey, round(ratio, 6) AS ratio FROM r WHERE ratio < 4.5""")
def fmt008_contrast(spark, sf_dir):
    colour = lambda k, d: F.lpad(F.hex((F.col("p_partkey") * k + d) % 16777216), 6, "0")
    cells = tables.load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), colour(7919, 0).alias("fill_color"), colour(104729, 255).alias("font_color"), F.lit(None).cast("double").alias("font_size"))
    return formatting.low_contrast(cells, CONFIG).select("p_partkey", F.round("ratio", 6).alias("ratio"))


# --- words, abbreviations, numbers


@query(f"""WITH {WORDS}, a AS (SELECT doc_id, w FROM words WHERE regexp_full_match(w, '[A-Z]{{2,8}}') AND w NOT IN ({', '.join(repr(w) for w in factual.COMMON_WORDS)}))
SELECT doc_id, w AS abbr, count(*) AS total FROM a GROUP BY ALL""")
def con003_abbreviations(spark, sf_dir):
    return tables.documents(spark, sf_dir).abbreviations.select("doc_id", "abbr", "total")


@query(f"""WITH {WORDS}, a AS (SELECT DISTINCT doc_id, w FROM words WHERE regexp_full_match(w, '[A-Z]{{2,8}}') AND w NOT IN ({', '.join(repr(w) for w in factual.COMMON_WORDS)}))
SELECT doc_id, '缩写「' || w || '」首次出现时未给出全称' AS message, '建议首次出现时写为「' || w || ' (全称)」格式' AS suggestion FROM a""")
def con003_first_defined(spark, sf_dir):
    return factual.first_defined(tables.documents(spark, sf_dir), CONFIG).select("doc_id", "message", "suggestion")


@query(f"""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lower(coalesce(text, '')) AS t, unnest({list(SECTIONS)!r}) AS section FROM documents)
SELECT doc_id, '缺少必须的章节: ' || section AS message, 'error' AS severity FROM s WHERE NOT contains(t, section)""")
def con002_required_sections(spark, sf_dir):
    return structure.required_sections(tables.documents(spark, sf_dir), replace(CONFIG, required_sections=SECTIONS)).select("doc_id", "message", "severity")


@query(r"""WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, unnest([{'w': 'stupid', 'p': '(?i)(?:^|[^\p{L}\p{M}\p{N}_])stupid(?:$|[^\p{L}\p{M}\p{N}_])'}, {'w': 'idiot', 'p': '(?i)(?:^|[^\p{L}\p{M}\p{N}_])idiot(?:$|[^\p{L}\p{M}\p{N}_])'}, {'w': '(?:moron|loser)s?', 'p': '(?i)(?:moron|loser)s?'}]) AS r FROM documents)
SELECT doc_id, '使用了应避免的词汇: 「' || r.w || '」— rude' AS message FROM h WHERE regexp_matches(text, r.p)""")
def vocabulary_reject(spark, sf_dir):
    return language.rejected_words(tables.documents(spark, sf_dir), replace(CONFIG, rejected=rejected(REJECTED))).select("doc_id", "message")


@query(rf"""WITH {WORDS}, l AS (SELECT doc_id, w FROM words WHERE regexp_full_match(w, '[a-zA-Z]{{4,}}')), t AS (SELECT doc_id, w, w = upper(w) OR (length(regexp_replace(w, '[^A-Z]', '', 'g')) >= 2 AND regexp_matches(w, '[a-z]')) AS technical FROM l)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE technical) AS technical FROM t GROUP BY doc_id""")
def technical_tokens(spark, sf_dir):
    words = F.explode(F.regexp_extract_all("all_text", F.lit(tx.LONG_ENGLISH_WORD), F.lit(0))).alias("w")
    rows = tables.documents(spark, sf_dir).page_text.select("doc_id", words)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(tx.is_technical("w")).alias("technical"))


@query(rf"""WITH words AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all(regexp_replace(text, '^[^A-Za-z]+', ''), '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS w FROM documents), l AS (SELECT doc_id, w FROM words WHERE regexp_full_match(w, '[a-zA-Z]{{4,}}') AND NOT (w = upper(w) OR (length(regexp_replace(w, '[^A-Z]', '', 'g')) >= 2 AND regexp_matches(w, '[a-z]'))))
SELECT doc_id, least(100, count(DISTINCT lower(w))) AS n FROM l GROUP BY doc_id""")
def spelling_candidates(spark, sf_dir):
    return language.spelling_candidates(tables.documents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT doc_id, {MIXED_SQL} AS t FROM documents), s AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-z][^{CJK}]*|[^A-Za-z]+')) AS p FROM m), k AS (SELECT doc_id, p, regexp_matches(p, '^[A-Za-z]') AS en FROM s WHERE regexp_matches(p, '\\S'))
SELECT doc_id, CASE WHEN en THEN 'en' ELSE 'zh' END AS lang, count(*) AS n, sum(length(p))::BIGINT AS chars FROM k GROUP BY ALL""")
def language_segments(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "documents").select("doc_id", F.explode(tx.language_segments(mixed())).alias("s"))
    return rows.groupBy("doc_id", F.col("s.lang").alias("lang")).agg(F.count("*").alias("n"), F.sum(F.length("s.text").cast("long")).alias("chars"))


def _mixed_sql(pattern: str, message: str, rule: str, severity: str) -> str:
    return f"SELECT doc_id, '{rule}' AS rule_id, '{severity}' AS severity, '{message} (' || CAST(length(regexp_extract_all(t, '{pattern}')) AS VARCHAR) || ' 处)' AS message FROM m WHERE regexp_matches(t, '{pattern}')"


@query(
    f"WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {MIXED_SQL} AS t FROM documents) "
    + " UNION ALL ".join(_mixed_sql(p, *rest[:3]) for p, rest in zip((f"([a-zA-Z0-9])([{CJK}])", f"([{CJK}])([a-zA-Z0-9])", "([a-zA-Z0-9])([，。；：！？])"), (x[1:] for x in language.MIXED), strict=True))
)
def fmt_mixed(spark, sf_dir):
    return language.mixed_formatting(mixed_documents(spark, sf_dir), CONFIG).select("doc_id", "rule_id", "severity", "message")


@query("""WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all(text, '(?i)license[ds]?')) AS m FROM documents), u AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all(text, '(?i)under the')) AS m FROM documents),
a AS (SELECT doc_id, m, 'warning' AS severity FROM h UNION ALL SELECT doc_id, m, 'info' FROM u) SELECT doc_id, severity, '术语用法不规范: 「' || m || '」' AS message, count(*) AS n FROM a WHERE severity = 'warning' GROUP BY ALL""")
def glossary_terms(spark, sf_dir):
    """Terms of a glossary; for the second term only texts without the preferred word near it count, which SQL's patterns can't tell."""
    terms = tuple(t for t in glossary(GLOSSARY) if t["severity"] == "warning")
    rows = language.glossary_terms(tables.documents(spark, sf_dir), replace(CONFIG, glossary=terms))
    return rows.groupBy("doc_id", "severity", "message").agg(F.count("*").alias("n"))


# --- findings


@query("SELECT doc_id, 'language|R|0|' || substr(md5(substr(text, 1, 120)), 7, 2) || substr(md5(substr(text, 1, 120)), 5, 2) || substr(md5(substr(text, 1, 120)), 3, 2) || substr(md5(substr(text, 1, 120)), 1, 2) AS key FROM documents")
def dedup_key(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select("doc_id", tx.dedup_key(F.lit("language"), F.lit("R"), F.lit(0), F.col("text")).alias("key"))


@query(f"""WITH {EVENTS}, r AS (SELECT *, CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS g FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type, coalesce(rule_id, ''), coalesce(page_index, -1), context ORDER BY g DESC, event_id) AS n FROM r)
SELECT doc_id, event_id, severity, type, rule_id, page_index FROM k WHERE n = 1""")
def dedup_findings(spark, sf_dir):
    return findings.deduplicate(event_findings(spark, sf_dir)).select("doc_id", "event_id", "severity", "type", "rule_id", "page_index")


@query(f"WITH {EVENTS} SELECT doc_id, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS total FROM f GROUP BY doc_id")
def severity_counts(spark, sf_dir):
    return findings.severity_counts(event_findings(spark, sf_dir), "doc_id")


@query(f"WITH {EVENTS} SELECT type, count(*) AS n FROM f GROUP BY type")
def type_counts(spark, sf_dir):
    return findings.type_counts(event_findings(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT coalesce('p' || CAST(page_index + 1 AS VARCHAR), '?') AS page, count(*) AS n FROM f GROUP BY 1")
def page_counts(spark, sf_dir):
    return findings.page_counts(event_findings(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT severity, type, count(*) AS n FROM f GROUP BY GROUPING SETS ((severity), (type), ())")
def severity_grouping_sets(spark, sf_dir):
    return findings.grouping_sets(event_findings(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT doc_id, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM f GROUP BY doc_id")
def severity_pivot(spark, sf_dir):
    return findings.pivot(event_findings(spark, sf_dir))


@query(f"WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY event_id) AS place FROM f) SELECT event_id, severity, place FROM r WHERE (severity = 'error' AND place <= 10) OR (severity = 'warning' AND place <= 5)")
def top_findings(spark, sf_dir):
    rows = findings.top(event_findings(spark, sf_dir), {"error": 10, "warning": 5}, ["event_id"])
    return rows.select("event_id", "severity", F.col("place").cast("long").alias("place"))


@query(f"WITH {EVENTS} SELECT event_id, severity, type FROM f WHERE severity IN ('error', 'warning') AND type IN ('error', 'purchase') AND (rule_id IS NULL OR rule_id NOT IN ('R-1', 'R-2')) AND (page_index IS NULL OR page_index + 1 NOT IN (3, 4))")
def filter_findings(spark, sf_dir):
    return findings.filtered(event_findings(spark, sf_dir), None, ["error", "purchase"], ["R-1", "R-2"], [3, 4]).select("event_id", "severity", "type")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts_by_hour(spark, sf_dir):
    return windowed_counts(tables.load(spark, sf_dir, "events"), "ts", "event_type")


# --- the whole audit


ABBREVIATED = f"a AS (SELECT DISTINCT doc_id, w FROM words WHERE regexp_full_match(w, '[A-Z]{{2,8}}') AND w NOT IN ({', '.join(repr(w) for w in factual.COMMON_WORDS)}))"
#: how many findings of the rules in RULES and of native checks each document has
RULE_COUNTS = rf"""{LINES}, {WORDS}, {ABBREVIATED}, low AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lower(coalesce(text, '')) AS t FROM documents),
counted AS (SELECT doc_id, 'FMT-003' AS rule_id, 'warning' AS severity, 1 AS n FROM lines GROUP BY doc_id HAVING sum(length(line)) > 200
UNION ALL SELECT doc_id, 'FMT-004', 'warning', count(DISTINCT substr(line, 1, 80) || CASE WHEN length(line) > 80 THEN '...' ELSE '' END) FROM lines WHERE length(regexp_replace(line, '[^a-zA-Z]', '', 'g')) >= 300 GROUP BY doc_id
UNION ALL SELECT doc_id, 'CON-002', 'error', 1 FROM low WHERE NOT (contains(t, 'the') AND contains(t, 'und') AND contains(t, 'introduction')) UNION ALL SELECT doc_id, 'CON-003', 'error', count(*) FROM a GROUP BY doc_id)"""


@query(f"WITH {RULE_COUNTS} SELECT rule_id, severity, sum(n)::BIGINT AS n FROM counted GROUP BY ALL")
def audit_documents(spark, sf_dir):
    """Findings by rule, of all rules and native checks; numbering (STR-002) and Chinese grammar find nothing in the tables."""
    return audit(tables.documents(spark, sf_dir), parse_rules(RULES)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query(rf"""WITH {RULE_COUNTS}, term AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all(text, '(?i)license[ds]?')) AS m, 'warning' AS severity, text, 'permit' AS near FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), unnest(regexp_extract_all(text, '(?i)under the')), 'info', text, 'by' FROM documents),
found AS (SELECT * FROM counted UNION ALL SELECT doc_id, 'TERM-plain', severity, count(DISTINCT m) FROM term GROUP BY doc_id, severity
UNION ALL SELECT doc_id, 'VOCAB-REJECT', 'warning', count(*) FROM ({{VOCABULARY}}) GROUP BY doc_id) SELECT doc_id, rule_id, severity, n::BIGINT AS n FROM found""".replace("{VOCABULARY}", SQL["vocabulary_reject"]))
def audit_findings(spark, sf_dir):
    """All findings of all rules, words and terms on documents, by document and rule; SQL also counts terms with the preferred wording near them, which larger tables have."""
    c = replace(CONFIG, rejected=rejected(REJECTED), glossary=tuple(glossary(GLOSSARY)))
    return audit(tables.documents(spark, sf_dir), parse_rules(RULES), c).groupBy("doc_id", "rule_id", "severity").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT conv_id, turn, lower(role) AS role, lower(coalesce(text, '')) AS t, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS n FROM conversations),
l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations),
f AS (SELECT 'STR-001' AS rule_id, 'error' AS severity, count(*) AS n FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0 AND NOT contains(role, '标题'))
UNION ALL SELECT 'CON-004', 'error', count(*) FROM (SELECT DISTINCT conv_id, turn FROM p WHERE n < 3 AND len(list_filter(['结论', '小结', '总结', '要点', '关键', '建议', '展望', 'summary', 'conclusion', 'key', 'takeaway', 'recommend'], lambda k: contains(t, k))) = 0 AND len(list_filter(['标题幻灯片', 'title', 'titelfolie', '封面', 'タイトル', 'cover'], lambda k: contains(role, k))) = 0)
UNION ALL SELECT 'FMT-004', 'warning', count(*) FROM (SELECT DISTINCT conv_id, turn, substr(line, 1, 80) || CASE WHEN length(line) > 80 THEN '...' ELSE '' END FROM l WHERE length(regexp_replace(line, '[^a-zA-Z]', '', 'g')) >= 300))
SELECT rule_id, CASE WHEN severity = 'error' THEN n ELSE 0 END AS error, CASE WHEN severity = 'warning' THEN n ELSE 0 END AS warning, 0::BIGINT AS info, n AS total FROM f WHERE n > 0""")
def audit_decks(spark, sf_dir):
    """Conversations as slide decks under the rules for slides."""
    rules = parse_rules("# 结构规则\n## STR-001: t\n- 严重度: error\n- 检查: first_slide_has_title_layout\n## STR-008: l\n- 严重度: info\n- 检查: slide_structure_consistency\n## CON-004: c\n- 严重度: error\n- 检查: every_slide_has_conclusion\n")
    return findings.severity_counts(audit(tables.decks(spark, sf_dir), rules), "rule_id")
