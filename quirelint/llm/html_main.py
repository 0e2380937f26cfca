"""HTML extraction with site template removal.

A page is parsed into elements, each with a hash of its whole subtree, and blocks of text. All subtrees of the
body are counted per host in Spark, navigation, footers and adverts too, and those recurring on ``needed`` pages are deleted
first. Markup is a prior: a subtree that it names as no article text (by tag, class, id or role) needs only
``LEAST_NAMED`` pages, one inside an article element a quarter of its host's, any other as many as ``needed`` says, and what is named so
but recurs nowhere (a reader's comment, a host of one page) goes as well. Of what is left, the largest article is the page's content if it holds over half of the text,
else the largest main element that does, else the body.

Copies of an article mustn't turn it into a template, so pages are told apart by all they hold outside
the subtree: a subtree's count is that of the distinct sums of the other blocks' hashes. Near copies
differ in these sums too; what isn't named and is counted often enough is therefore counted again by the least hash of
five words in the blocks that don't recur, which near copies mostly share, and deleted if that
count is enough too and at least half of the first, however much else recurs on the same pages.

A null html counts as empty and gives an empty text; a null url or one without a host makes up one
host of its own; repeated rows give equal rows; other columns are not read; an empty table gives an empty one;
the time for a very long or deeply nested page grows with its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PUNCT, arrow_map, checkpoint, table, type_of, windows

#: Pages on which a subtree that markup doesn't name has to recur: half of a small host's, ``LEAST`` at least; then MIN_PAGES; then SHARE of the host's. One in an article: IN_ARTICLE of the host's too. One that it names: LEAST_NAMED.
LEAST, MIN_PAGES, SHARE, IN_ARTICLE, LEAST_NAMED = 3, 10, 0.01, 0.25, 2
#: More subtrees than these are joined by host rather than broadcast; with more hosts than these, all pages are read again.
BROADCAST_ROWS, BROADCAST_HOSTS = 4_000_000, 200_000

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ROOTS = ("article", "main")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: elements that show no text of the page
UNSEEN = {"head", "script", "style", "noscript", "template", "textarea", "input", "iframe", "object", "embed", "svg", "canvas", "audio", "video", "map", "datalist"}
#: prior: elements whose contents are seldom article text
OUT = {"nav", "footer", "aside", "form", "button", "select", "option", "optgroup", "label", "fieldset", "math", "dialog", "menu"}
#: prior: what a class or id says of an element that isn't article text
NAMES = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login|share|sharing|social|related|recommended|recommendations|more-stories|teaser|teasers|sidebar|side-bar|widget|widgets|menu|menus|nav|navbar|navigation|breadcrumb|breadcrumbs|pagination|pager|toolbar|footer|site-header|page-header|masthead|topbar|comment|comments|commentlist|disqus|reply|replies|respond|form|search|skip-link|print-only|hidden|sr-only)(?:$|[-_ 0-9])",
    re.I,
)
#: prior
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: an opening tag ends these open elements, up to the nearest of the second set
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_SCOPE = {"article", "aside", "body", "button", "div", "section", "td", "th", "table", "li", "blockquote", "main", "header", "footer", "nav", "html", "figure", "form", "object"}


def is_named(attrs: str) -> bool:
    """Whether attributes say of an element that it isn't article text."""
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id") and NAMES.search(value):
            return True
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Element:
    """article, main: the outermost such element around; out: what the prior says of it, with names and with names inside articles only."""

    __slots__ = ("article", "hash", "header", "heading", "inside", "main", "name", "out", "parent", "parts", "unseen")

    def __init__(self, name: str, parent: _Element | None, attrs: str = "") -> None:
        self.name, self.parent, self.parts, self.hash, self.inside = name, parent, [], 0, 0
        if parent is None:
            self.article = self.main = None
            self.unseen = self.header = self.heading = False
            self.out = (False, False)
            return
        self.article = parent.article or (self if name == "article" else None)
        self.main = parent.main or (self if name == "main" else None)
        self.heading = parent.heading or name in HEADINGS
        self.header = parent.header or name == "header"
        self.unseen = parent.unseen or name in UNSEEN
        around = parent.article or parent.main
        out = name in OUT or name == "header" and not around  # an article's own header holds its headings
        named = not out and bool(attrs) and not attrs.isspace() and name not in ("html", "body", "article", "main") and is_named(attrs)
        self.out = (parent.out[0] or out or named, parent.out[1] or out or named and around is not None)


class Page:
    """elements in the order of their tags, with hashes of their subtrees and (``inside``) sums of the hashes of the blocks in them; blocks: (text, innermost element)."""

    def __init__(self, page: str) -> None:
        self.elements: list[_Element] = []
        self.blocks: list[tuple[str, _Element]] = []
        self._parse(page)
        self.own = [xxhash.xxh3_64_intdigest(text) for text, _ in self.blocks]
        for x, (_, e) in zip(self.own, self.blocks, strict=True):
            e.inside += x
        for e in reversed(self.elements[1:]):
            e.parent.inside += e.inside

    def _parse(self, page: str) -> None:
        at_element = _Element("", None)
        self.elements.append(at_element)
        is_open: Counter = Counter()
        blocks, buffer = self.blocks, []

        def flush() -> None:
            if buffer:
                text = " ".join(html.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    blocks.append((text, at_element))
                    at_element.parts.append(text)

        def close(to: _Element) -> None:
            nonlocal at_element
            while True:
                if at_element.name in BLOCK:
                    flush()
                done, at_element = at_element, at_element.parent
                is_open[done.name] -= 1
                done.hash = xxhash.xxh3_64_intdigest("\0".join((done.name, *done.parts))) >> 3
                if done.name in BLOCK or done.parts:
                    at_element.parts.append(f"\1{done.hash}")
                if done is to:
                    return

        def innermost(names: set[str], scope: set[str]) -> _Element | None:
            if not any(is_open[x] for x in names):
                return None
            e = at_element
            while e.parent is not None:
                if e.name in names:
                    return e
                if e.name in scope:
                    return None
                e = e.parent
            return None

        pos, n = 0, len(page)
        while pos < n:
            m = TAG.search(page, pos)
            text = page[pos : m.start() if m else n]
            if text and not at_element.unseen:
                buffer.append(text)
            if m is None:
                break
            pos = m.end()
            if m["cdata"] and not at_element.unseen:
                buffer.append(html.escape(m["cdata"]))
            if m["name"] is None:
                continue
            name = m["name"].lower()
            if m["end"]:
                e = innermost({name}, set())
                if e is not None:
                    close(e)
                continue
            if name == "br":
                buffer.append("\n") if not at_element.unseen else None
                continue
            if name in BLOCK:
                if p := innermost({"p"}, P_SCOPE):
                    close(p)
                if name in HEADINGS and at_element.name in HEADINGS:
                    close(at_element)
                flush()
            if name in ENDS:
                names, scope = ENDS[name]
                while e := innermost(names, scope):
                    close(e)
            if name in VOID:
                continue
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I).search(page, pos)
                if end is None:
                    break
                pos = page.find(">", end.end()) + 1 or n
                continue
            at_element = _Element(name, at_element, m["attrs"])
            is_open[name] += 1
            self.elements.append(at_element)
        flush()
        while at_element.parent is not None:
            close(at_element)

    def subtrees(self) -> dict[int, int]:
        """Ids of the subtrees that hold blocks, with the sum of the hashes of the blocks in them."""
        out: dict[int, int] = {}
        for e in self.elements:
            if e.inside and e.name in BLOCK and e.name not in ("html", "body"):
                h = subtree_id(e)
                out[h] = out.get(h, 0) + e.inside
        return out

    def left(self, gone: set[int]) -> list[tuple[str, _Element]]:
        """Blocks outside the subtrees."""
        if not gone:
            return self.blocks
        deleted = set()
        for e in self.elements[1:]:
            if e.parent in deleted or e.name in BLOCK and subtree_id(e) in gone:
                deleted.add(e)
        return [(text, e) for text, e in self.blocks if e not in deleted]

    def content(self, gone: set[int] | frozenset = frozenset(), prior: bool = True) -> list[str]:
        """Blocks of the page's content: without those of the subtrees and, with ``prior``, without what markup names, in the article.

        A wrapper around everything may be named like a side part: where nothing is left, names count inside articles only.
        """
        found = self.left(gone)
        if not prior:
            return [text for text, _ in found]
        for weight in (0, 1):
            rest = [(text, e) for text, e in found if not e.out[weight] and (e.heading or not e.header)]
            if rest:
                break
        for kind in ROOTS:
            size = Counter()
            for text, e in rest:
                if root := getattr(e, kind):
                    size[root] += len(text)
            if size:
                root, most = size.most_common(1)[0]
                if 2 * most > sum(len(text) for text, _ in rest):
                    return [text for text, e in rest if getattr(e, kind) is root]
        return [text for text, _ in rest]


NEUTRAL, NAMED, ARTICLE = 0, 1, 2


def subtree_id(e: _Element) -> int:
    """The hash, and in the last two bits the prior."""
    return e.hash << 2 | (NAMED if e.out[0] else ARTICLE if e.parent.article else NEUTRAL)


SPACE = 1 << 63


def _subtrees(batches):
    for batch in batches:
        hosts, hashes, rest = [], [], []
        for host, raw in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(raw or "")
            inside, whole = page.subtrees(), sum(page.own)
            hosts += [host] * (1 + len(inside))
            hashes += [-1, *inside]
            rest += [whole % SPACE, *((whole - x) % SPACE for x in inside.values())]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(rest, pa.int64())], ["host", "subtree", "rest"])


def least_windows(texts: list[str]) -> np.ndarray:
    """The least hash of five neighbouring words of each text; of all of a shorter one, 0 without any."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = WORD_PUNCT.cut(data, np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64))
    at, found = windows(WORD_PUNCT.hashes(data, starts, ends), first, 5)
    row = np.repeat(np.arange(len(raw)), np.diff(first))[at]
    least = np.full(len(raw), np.uint64(2**64 - 1))
    np.minimum.at(least, row, found)
    for k in np.flatnonzero(np.bincount(row, minlength=len(raw)) == 0):
        least[k] = xxhash.xxh3_64_intdigest(raw[k]) if raw[k] else 0
    return (least >> np.uint64(1)).astype(np.int64)


def _key(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host)


class Marked:
    """Subtrees of hosts: a broadcast sorted array of their keys, or a column with those of the row's host."""

    def __init__(self, found: DataFrame) -> None:
        self.found = found.select("host", "subtree")
        self.keys = None
        if found.count() <= BROADCAST_ROWS:
            rows = self.found.toPandas()
            of = {h: _key(h) for h in rows["host"].unique()}
            keys = np.array([of[h] for h in rows["host"]], np.uint64) + rows["subtree"].to_numpy(np.uint64)
            self.keys = found.sparkSession.sparkContext.broadcast(np.sort(keys))

    def beside(self, rows: DataFrame) -> DataFrame:
        if self.keys is not None:
            return rows.withColumn("subtrees", F.lit(None).cast("array<bigint>"))
        return rows.join(self.found.groupBy("host").agg(F.collect_set("subtree").alias("subtrees")), "host", "left")

    def test(self):
        """A function of a host, its subtrees' column and a page: the page's marked subtrees."""
        keys = self.keys

        def marked(host: str, own: list[int] | None, page: Page) -> set[int]:
            seen = list(page.subtrees())
            if keys is None:
                return set(own or ()).intersection(seen)
            if not seen or not len(keys.value):
                return set()
            wanted = np.array(seen, np.uint64) + np.uint64(_key(host))
            at = np.minimum(np.searchsorted(keys.value, wanted), len(keys.value) - 1)
            return {seen[k] for k in np.flatnonzero(keys.value[at] == wanted)}

        return marked


def _parts(batch, marked):
    """(host, page, marked subtrees)."""
    for host, raw, own in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "subtrees")), strict=True):
        page = Page(raw or "")
        yield host, page, marked(host, own, page)


def _again(marked):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [(host, g, " ".join(text for text, e in page.left(g) if not e.out[0])) for host, page, g in _parts(batch.slice(at, 500), marked)]
                least = least_windows([text for *_, text in found])
                rows = [(host, h, x) for (host, hs, _), x in zip(found, least.tolist(), strict=True) for h in hs]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["host", "subtree", "least"])

    return run


def needed(pages: Column, min_pages: int = MIN_PAGES, share: float = SHARE) -> Column:
    small = F.greatest(F.lit(LEAST), F.least(F.ceil(pages / 2), F.lit(min_pages)))
    return F.greatest(small, F.ceil(pages * share))


def _distinct(seen: DataFrame, of: str) -> DataFrame:
    return seen.groupBy("host", "subtree", of).agg(F.lit(1).alias("one")).groupBy("host", "subtree").agg(F.count("*").alias("n"))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, subtree) of the recurring subtrees."""
    seen = arrow_map(pages.select("host", "html"), _subtrees, "host string, subtree long, rest long")
    counts = checkpoint(_distinct(seen, "rest").where((F.col("subtree") == -1) | (F.col("n") >= LEAST_NAMED)))
    found = counts.where("subtree <> -1")
    prior = F.col("subtree").bitwiseAND(F.lit(3).cast("long"))
    named = found.where(prior == NAMED).select("host", "subtree")
    whole = counts.where("subtree = -1").select("host", F.col("n").alias("pages"))
    bar = needed(F.col("pages"), min_pages, share)
    in_article = F.greatest(bar, F.ceil(F.col("pages") * IN_ARTICLE))
    many = found.where(prior != NAMED).join(whole, "host").withColumn("needed", F.when(prior == ARTICLE, in_article).otherwise(bar)).where("n >= needed")
    many = checkpoint(many.select("host", "subtree", F.col("n").alias("rests"), "needed"))
    if many.isEmpty():
        return named
    marks = Marked(many)
    hosts, there = many.select("host").distinct(), pages.select("host", "html")
    if hosts.count() <= BROADCAST_HOSTS:  # never dealt by host, one of which may hold a third of all pages
        there = there.join(F.broadcast(hosts), "host", "left_semi")
    again = arrow_map(marks.beside(there), _again(marks.test()), "host string, subtree long, least long")
    return named.unionByName(_distinct(again, "least").join(many, ["host", "subtree"]).where("n >= needed AND 2 * n >= rests").select("host", "subtree"))


def _texts(keep: list[str], marked, prior: bool):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = ["\n".join(page.content(gone, prior)) for _, page, gone in _parts(part, marked)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return run


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, prior: bool = True) -> DataFrame:
    """(page_id, url, text); without ``prior`` all that the page shows but for recurring subtrees."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    marks = Marked(checkpoint(templates(rows, min_pages, share)))
    return arrow_map(marks.beside(rows), _texts(["page_id", "url"], marks.test(), prior), f"page_id {type_of(pages, 'page_id')}, url string, text string")


def op5_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
