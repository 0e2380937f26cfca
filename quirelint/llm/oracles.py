"""DuckDB SQL for the queries of this subpackage that SQL can express, over the whole tables.

Windows are whole strings here, grouped and joined as such, without hashes, seeds, indexes or bounds: nothing
of the operators' methods is used. Rows are numbered, so that repeated ids stay apart. ``op8``'s
last column lists base spans only: SQL can't take key structures apart, and the tables hold no key or signed token, which
the query's result shows.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SMALL = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

SEED_EXTEND = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
t AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
windows AS (SELECT r, doc_id, p, array_to_string(w[p:p + 49], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 48)) AS p FROM d)),
least AS (SELECT x, min(doc_id) AS m FROM windows GROUP BY x),
hit AS (SELECT r, p FROM windows JOIN least USING (x) WHERE m < doc_id),
seen AS (SELECT t.r, word, pos, max(p) OVER (PARTITION BY t.r ORDER BY pos) AS last FROM t LEFT JOIN hit ON t.r = hit.r AND p = pos),
kept AS (SELECT r, count(*) FILTER (WHERE last >= pos - 49) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE last IS NULL OR last < pos - 49) AS left_over FROM seen GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

# pieces of 500 bytes with what their windows reach into are only there because substr counts from a string's start
INTERVAL_EXPANSION = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, doc_id, c, length(h) // 2 AS n, substr(h, 1000 * c + 1, 1098) AS piece FROM (SELECT *, unnest(range(0, (length(h) + 999) // 1000)) AS c FROM d)),
t AS (SELECT r, doc_id, 500 * c + i AS pos, n, substr(piece, 2 * i - 1, 100) AS x FROM (SELECT *, unnest(range(1, least(500, n - 500 * c) + 1)) AS i FROM pieces)),
windows AS (SELECT r, doc_id, pos AS p, x FROM t WHERE pos <= n - 49),
least AS (SELECT x, min(doc_id) AS m FROM windows GROUP BY x),
hit AS (SELECT r, p FROM windows JOIN least USING (x) WHERE m < doc_id),
seen AS (SELECT t.r, substr(x, 1, 2) AS byte, pos, coalesce(max(p) OVER (PARTITION BY t.r ORDER BY pos) >= pos - 49, false) AS gone FROM t LEFT JOIN hit ON t.r = hit.r AND p = pos),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY pos), false) AS starts FROM seen),
kept AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (WHERE NOT gone) AS left_over FROM runs GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

SIGNATURE_TREES = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({SMALL}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[p:p + 4], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_have AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s AS a JOIN s AS b USING (x) WHERE a.r <> b.r AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY a.r, b.r),
links AS (SELECT a, b FROM both_have JOIN n AS k ON k.r = a JOIN n AS m ON m.r = b WHERE 100 * i >= 75 * (k.n + m.n - i)),
reached AS (SELECT r AS a, r AS b FROM d UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
least AS (SELECT a, min(doc_id) AS component_id FROM reached JOIN d ON d.r = reached.b GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN least ON least.a = d.r
"""

PREFIX_JOIN = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({SMALL}, '{ALNUM}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({SMALL}, '{ALNUM}') AS w FROM benchmark),
items AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM items),
windows AS (SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS x FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes)),
hit AS (SELECT r, p, windows.k, item FROM windows JOIN items USING (x)),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = f"(?:{'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _found(kind: str, place: int, pattern: str, least: str) -> str:
    """Matches with their places: the text is split at marks before each, and lengths are summed up."""
    pieces = f"string_split(regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2), '  '), '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1))"
    return f"""SELECT r, '{kind}' AS kind, {place} AS place, m, first FROM (
SELECT r, k, split_part(piece, chr(2), 1) AS m, sum(length(piece) - CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first
FROM (SELECT r, unnest({pieces}) AS piece, generate_subscripts({pieces}, 1) AS k FROM d)) WHERE k > 1 AND {least}"""


SECRET_SPANS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
f AS ({_found("assign", 0, ASSIGN, f"length(regexp_extract(m, '{ASSIGN}', 1)) >= 6")} UNION ALL {_found("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")} UNION ALL {_found("hex", 2, "[0-9a-f]+", "length(m) >= 24")}),
g AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || CAST(first AS BIGINT) || ':' || CAST(first + length(m) AS BIGINT), ',' ORDER BY first, place) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""

SQL = {"op2_seed_extend": SEED_EXTEND, "op4_interval_expansion": INTERVAL_EXPANSION, "op6_signature_trees": SIGNATURE_TREES, "op7_prefix_join": PREFIX_JOIN, "op8_secret_spans": SECRET_SPANS}
