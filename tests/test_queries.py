"""A selection of registered queries against DuckDB on small tables made here."""

import datetime

import pytest

from quirelint import built_queries, queries  # noqa: F401  the first registers its queries with the second

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    texts = ["Über the license NASA stupid\nLine two is here, " + "word " * 80, "• one\n1. two\n- three", None, "", "iPhone GaN und THE introduction\n" + "e" * 310, "the other, under the tree"]
    docs = [(i, t) for i, t in enumerate(texts * 3)]
    pages = [(i, f"https://h{i % 2}.org/{i}", f"<html><h1>{t}</h1></html>") for i, t in enumerate(["Title.", "title.", "A " * 12, "plain", "Plain", "plain"])]
    talks = [(c, t, r, x) for c in range(5) for t, (r, x) in enumerate([("user", "one\ntwo"), ("user" if c else "system", "The answer"), ("user", "a\nb\nc")][: 1 + c % 3])]
    events = [(i, datetime.datetime(2024, 1, 1, i % 24), i % 4, ["error", "view", "purchase"][i % 3], '{"k": %d}' % (i % 2)) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, props string").write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("documents", "pages", "conversations", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return path, con


NAMES = """fmt003_page_char_limit fmt004_paragraph_length fmt007_bullet_classes str004_title_length str005_duplicate_title str006_title_punctuation fix_bullets fix_spacing str008_single_layout str001_title_slide con004_conclusions
con003_abbreviations con002_required_sections vocabulary_reject technical_tokens language_segments fmt_mixed glossary_terms dedup_findings severity_grouping_sets severity_pivot top_findings filter_findings audit_documents""".split()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    path, con = tables
    df = queries.QUERIES[name](spark, path)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(columns).collect())
    assert got == sorted(map(str, con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()))
