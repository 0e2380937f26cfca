"""Operators on whole corpora, against brute force."""

import random
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa

from quirelint.llm import contam, html_main, repeats, resample, substrings, suffixes


def corpus(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(400)]
    passages = [rng.choices(vocab, k=rng.randint(30, 90)) for _ in range(4)]
    rows: list[tuple] = [(900, None), (901, ""), (902, "short"), (None, " ".join(passages[0])), (903, "aa " * 300), (904, "aa " * 200 + "b"), (905, "x" * 400), (899, "x" * 120)]
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(5, 150))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i, "\n ".join([" ".join(words[:40]), " ".join(words[40:])])))
    for i in range(25):  # copies and near copies
        words = (rows[8 + i % 5][1] or "").split()
        if i % 2:
            words[rng.randrange(len(words))] = "edit"
        rows.append((100 + i, " ".join(words)))
    return rows + [rows[10], rows[10]]


def brute(rows, split, length, join):
    seen: dict = {}
    for i, t in rows:
        s = split(t)
        for p in range(len(s) - length + 1):
            if i is not None:
                key = tuple(s[p : p + length])
                seen[key] = min(seen.get(key, i), i)
    out = []
    for i, t in rows:
        s, gone = split(t), set()
        for p in range(len(s) - length + 1):
            if i is not None and seen[tuple(s[p : p + length])] < i:
                gone.update(range(p, p + length))
        out.append((str(i), len(s), len(gone), join([x for p, x in enumerate(s) if p not in gone])))
    return sorted(out)


def removed(df):
    return sorted((str(r.id), r.n, sum(s.b - s.a for s in r.spans), r.kept) for r in df.collect())


def words(t):
    return (t or "").encode().split()


def test_substrings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH", 1 << 10)
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, batch int")
        assert removed(substrings.dedup(docs)) == brute(rows, words, 50, b" ".join)
    assert substrings.dedup(docs.where("false")).count() == 0


def test_suffixes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH", 1 << 12)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, lambda t: (t or "").encode(), 50, bytes)
    assert removed(suffixes.dedup(docs)) == want
    assert suffixes.dedup(docs.where("false")).count() == 0


def test_interval_expansion():
    rng = random.Random(5)
    for k in range(60):
        raw = bytes(rng.choices([b"ab", b"abc", b"a\xff", b"abcdefgh"][k % 4], k=rng.randint(1, 300)))
        raw += raw[: rng.randint(0, len(raw))] + b"\xff\xfe"
        for length in (1, 3, 12, 50):
            order, common = suffixes.borders(np.frombuffer(raw, np.uint8), length)
            assert [raw[p : p + length] for p in order] == sorted(raw[p : p + length] for p in order)
            for a, b, n in zip(order, order[1:], common[1:], strict=False):
                same = next((j for j in range(length) if raw[a + j : a + j + 1] != raw[b + j : b + j + 1]), length)
                assert n == same


def test_nothing_goes_without_the_index(spark, monkeypatch):
    """With the answers of the index set to no, nothing that several batches hold is removed."""
    monkeypatch.setattr(repeats, "BATCH", 1 << 8)
    docs = spark.createDataFrame([(i, f"copied {'passage of words ' * 9}") for i in range(40)], "doc_id long, text string")
    assert sum(len(r.spans) for r in suffixes.dedup(docs).collect()) == 39
    off = repeats.Symbols(50, 25, lambda block: np.full(int(block.n.sum()), 2**63 - 1))
    one_each = docs.withColumn("doc_id", docs.doc_id * 1)
    entries, n = repeats.deal(one_each, "doc_id", "text")
    alone = entries.groupBy("batch").count().where("count = 1").count()
    assert n >= 8 and sum(len(r.spans) == 0 for r in repeats.removed(docs, off).collect()) >= max(alone, entries.select("batch").distinct().count())


def test_hot_anchors(spark, monkeypatch):
    """Windows of an anchor with many different runs are dealt one by one, in blocks of some texts."""
    monkeypatch.setattr(repeats, "BATCH", 1 << 9)
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "BLOCK", 1 << 10)
    rng = random.Random(21)
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, " ".join([rng.choice("xyz"), rng.choice("xyz"), *rng.choices("uvw", k=rng.randint(0, 12)), common, *rng.choices("pq", k=rng.randint(0, 14))])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(substrings.dedup(docs)) == brute(rows, words, 50, b" ".join)
    assert removed(suffixes.dedup(docs)) == brute(rows, lambda t: (t or "").encode(), 50, bytes)


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_symbols_are_compared(spark):
    """Words and texts whose polynomial hashes modulo 2**64 are equal, though they differ in every letter."""
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rest = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([x, *rest])), (2, " ".join([y, *rest])), (3, " ".join([*rest[:20], x, *rest[20:]])), (4, " ".join([*rest[:20], y, *rest[20:]])), (5, x), (6, y), (7, "e" + x), (8, "e" + y)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(substrings.dedup(docs)) == brute(rows, words, 50, b" ".join)
    assert removed(suffixes.dedup(docs)) == brute(rows, lambda t: (t or "").encode(), 50, bytes)


def test_one_id_is_spread(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH", 1 << 8)
    docs = spark.createDataFrame([(7, f"text {i} of one id") for i in range(400)], "doc_id long, text string")
    texts, n = repeats.deal(docs, "doc_id", "text")
    assert n >= 8 and texts.select("batch").distinct().count() >= 8


def test_runs_do_not_depend_on_the_order_of_rows(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choices(["ab", "c", "def", "g"], k=rng.randint(1, 200)))) for i in range(40)]
    for symbols in (suffixes.SYMBOLS, repeats.Symbols(20, 8, None, substrings.WORDS)):
        found = set()
        for seed in range(4):
            random.Random(seed).shuffle(rows)
            batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["id", "text"])
            r = repeats.batch_runs(batch, symbols)
            found.add(tuple(sorted((rows[row][0], *x) for row, *x in zip(r.row, r.start.tolist(), r.n.tolist(), r.at.tolist(), r.content.tolist(), strict=True))))
        assert len(found) == 1


def test_winnowing_covers_every_window(monkeypatch):
    rng = random.Random(6)
    for letters in ("abcdefgh", "ab", "a"):
        codes = np.array([hash(x) % 2**63 for x in rng.choices(letters, k=500)], np.uint64)
        first = np.array([0, 0, 49, 99, 300, 500])
        for piece in (10**6, 60):
            monkeypatch.setattr(repeats, "PIECE", piece)
            r = repeats.find_runs(codes, first, 50, 25)
            got = [(a, s + i) for a, s, k in zip(r.row.tolist(), r.start.tolist(), r.n.tolist(), strict=True) for i in range(k)]
            assert sorted(got) == [(a, s) for a in range(5) for s in range(first[a + 1] - first[a] - 49)]
            assert ((r.at >= r.n - 1) & (r.at <= 25)).all()


def test_pieces_hash_alike(monkeypatch):
    from quirelint.llm import common

    data = np.frombuffer(b"one two  three four five six seven eight nine ten eleven " * 20, np.uint8)
    offs = np.array([0, 100, 100, len(data)])
    starts, ends, first = common.WORDS.cut(data, offs)
    whole = common.WORDS.hashes(data, starts, ends)
    at, grams = common.windows(whole, first, 5)
    monkeypatch.setattr(common, "PIECE", 37)
    assert (common.WORDS.hashes(data, starts, ends) == whole).all()
    again, pieces = common.windows(whole, first, 5)
    assert (again == at).all() and (pieces == grams).all()


def test_prefix_join(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)] + ["É", "the"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 25)))) for i in range(30)] + [(100, None), (101, "?!"), (7, "Fresh wORDS, here"), (None, "no-id item")]
    rows = [(900, None), (901, ""), (902, "FRESH--words... here fresh words here"), (903, "a no id item!"), (904, "fresh words"), (905, "fresh"), (906, "words here")]
    for i in range(200):
        w = rng.choices(vocab, k=rng.randint(0, 60))
        if i % 3 == 0:
            w[5:5] = items[rng.randrange(30)][1].upper().split()[: rng.randint(3, 25)]
        rows.append((i, ", ".join(w)))
    rows += rows[7:9]
    docs, bench = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, spans string"), spark.createDataFrame(items, "item_id long, text string")
    want = []
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    for i, t in rows:
        d, hit, found = cut(t), set(), set()
        for item, text in items:
            w = cut(text)
            k = min(10, len(w))
            for s in range(len(w) - k + 1 if w else 0):
                for p in range(len(d) - k + 1):
                    if d[p : p + k] == w[s : s + k]:
                        hit.update(range(p, p + k))
                        found |= {str(item)} - {"None"}
        want.append((i, len(d), len(hit), sorted(found)))
    for block in (300_000, 90):
        got = [(r.doc_id, r.n_words, sum(s.b - s.a for s in r.spans), list(r["items"])) for r in contam.match(docs, bench, block=block).collect()]
        assert sorted(got) == sorted(want)
    assert contam.match(docs.where("false"), bench).count() == 0
    assert {r.n_words for r in contam.match(docs.limit(1), bench.where("false")).collect()} == {0}


def test_many_candidates_in_little_memory(monkeypatch):
    """Windows of two words only, that share few prefix words, and a long text of the same words."""
    import tracemalloc

    rng = random.Random(8)
    items = sorted({b" ".join(rng.choices([b"0", b"1"], k=10)) for _ in range(3000)})[:1022]
    index = contam.Index([(w, ["i"]) for w in items], lambda v: np.arange(len(v)))
    text = b" ".join(rng.choices([b"0", b"1"], k=40_000))
    data = np.frombuffer(text, np.uint8)
    starts, ends, first = contam.ALNUM_WORDS.cut(data, np.array([0, len(data)]))
    hashes = contam.ALNUM_WORDS.hashes(data, starts, ends)
    tracemalloc.start()
    found = {(int(b), int(e)) for begin, entry in index.matches(hashes, first, contam.WINDOW_BASE, contam.Lookup(index.prefix)) for b, e in zip(begin, entry, strict=True)}
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    tokens, known = text.split(), set(items)
    assert {b for b, _ in found} == {p for p in range(len(tokens) - 9) if b" ".join(tokens[p : p + 10]) in known}


def test_resampling(spark):
    rng = random.Random(4)
    good, bad = [f"g{i}" for i in range(200)], [f"b{i}" for i in range(30)]
    rows, labels = [(9000, None), (9001, "")], []
    for i in range(1500):
        junk = i % 5 == 0
        text = " ".join(rng.choices(good, k=rng.randint(20, 300)) + (rng.choices(bad, k=6) if junk else []))
        rows.append((i, text))
        if i % 2:
            labels.append((i, 1, int(junk)))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows + rows[:3]], "doc_id long, text string, kept int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in resample.classify(docs, marks).collect()}
    held_out = [(got[i], i % 5 != 0) for i in range(0, 1500, 2)]
    assert np.mean([a == b for a, b in held_out]) > 0.97
    again = {r.doc_id: r.kept for r in resample.classify(docs, marks).collect()}
    assert got == again and len(got) == 1502
    assert all(r.kept for r in resample.classify(docs, marks.where("false")).collect())
    assert resample.classify(docs.where("false"), marks).count() == 0


def test_resampling_small_table(spark):
    """So few target documents that no bucket is expected in more than 8.5 of them."""
    rng = random.Random(6)
    good, bad = [f"g{i}" for i in range(150)], [f"b{i}" for i in range(6)]
    rows = [(i, " ".join(rng.choices(good, k=rng.randint(40, 160)) + (bad if i % 10 == 0 else []))) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(160) if i // 10 % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in resample.classify(docs, marks).collect()}
    held_out = [i for i in range(160) if not i // 10 % 2]
    assert not any(got[i] for i in held_out if i % 10 == 0)
    assert np.mean([got[i] for i in held_out if i % 10]) > 0.9


def test_top_k(spark):
    keyed = spark.createDataFrame(pd.DataFrame({"key": [5, -3, 2**62, 5, -(2**63), 0]}))
    assert [resample.kth_greatest(keyed, k) for k in range(1, 8)] == [2**62, 5, 5, 0, -3, -(2**63), None]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>Menu</ul></nav>
<div class="ad">Buy</div><article><header><h1>Head &amp; tail</h1><span>by me</span></header><p><b>One<br>two &eacute;<p>Three   four
<div class="promo-box">{promo}</div><!-- <p>no</p> --><ul><li>a<li>b</ul><form>x</form><p title="a>b">five</article>
<section class="comments"><article><p>{long}</p></article></section><footer>&copy;</footer></body></html>"""


def test_main_text():
    content = lambda page: html_main.Page(page).content()
    assert content(PAGE.format(promo="p", long="c " * 500)) == ["Head & tail", "One two é", "Three four", "a", "b", "five"]
    assert content("") == [] and content("<p>") == [] and content("<p>only <i>this") == ["only this"]
    wrapped = '<body><div class="page with-sidebar"><nav>m</nav><article><p>x x</p><p class="ad">y</p></article><div class="comments"><article>c</article></div></div>'
    assert content(wrapped) == ["x x"]
    assert content("<body><div><p>x</div><p>y") == ["x", "y"]
    assert content("a <b 'unclosed> b <p>c")[-1:] == ["c"]
    assert content("<main><div>a long story in some words</div><article>short card</article></main>") == ["a long story in some words", "short card"]
    assert content("<body><article>part one</article><article>part two</article><nav>m</nav>") == ["part one", "part two"]


def test_deep_and_long_pages_take_linear_time():
    for make in (lambda n: "<div>a " * n, lambda n: "<div><span>" * n + "</x>" * n + "</p>" * n, lambda n: "<ul><li>x" * n, lambda n: "<p>word " * n):
        took = []
        for n in (10_000, 40_000):
            raw = make(n)
            began = time.process_time()
            page = html_main.Page(raw)
            page.content(set(list(page.subtrees())[:3]))
            took.append(time.process_time() - began)
        assert took[1] < 9 * took[0] + 0.3
    assert len(html_main.Page("<div>a " * 100_000).content()) == 100_000


def brute_templates(pages):
    """Per host the subtrees of each page as nested tuples, deleted by the stated bounds, without hashes or Spark."""
    def tuples(raw):
        page = html_main.Page(raw or "")
        children: dict = {}
        for text, e in page.blocks:
            children.setdefault(id(e), []).append(text)
        own: dict = {}
        for e in reversed(page.elements):
            own[id(e)] = (e.name, tuple(children.get(id(e), ())), tuple(own[id(c)] for c in page.elements if c.parent is e))
        return page, own

    def blocks_of(t):
        return list(t[1]) + [b for c in t[2] for b in blocks_of(c)]

    hosts: dict = {}
    for i, url, raw in pages:
        hosts.setdefault((url or "").split("/")[2] if url and "//" in url else "", []).append((i, *tuples(raw)))
    out = {}
    prior = lambda e: 1 if e.out[0] else 2 if e.parent is not None and e.parent.article else 0
    for found in hosts.values():
        seen: dict = {}
        for _, page, own in found:
            whole = sorted(b for b, _ in page.blocks)
            for e in page.elements:
                if e.name in html_main.BLOCK - {"html", "body"} and blocks_of(own[id(e)]):
                    rest = list(whole)
                    for b in blocks_of(own[id(e)]):
                        rest.remove(b)
                    seen.setdefault((own[id(e)], prior(e)), set()).add(tuple(rest))
        n = len({tuple(sorted(b for b, _ in page.blocks)) for _, page, _ in found})
        bar = max(3, min(-(-n // 2), 10), -(-n // 100))
        gone = {k for k, rests in seen.items() if len(rests) >= (bar, 2, max(bar, -(-n // 4)))[k[1]]}
        for i, page, own in found:
            text = []
            for b, e in page.blocks:
                x, keep = e, True
                while x is not None:
                    keep &= (own[id(x)], prior(x)) not in gone
                    x = x.parent
                if keep:
                    text.append(b)
            out[i] = "\n".join(text)
    return out


def test_recurring_subtrees_against_brute_force(spark):
    """Without the prior for what is left, over pages without near copies."""
    rng = random.Random(31)
    par = lambda: f"<p>{' '.join(rng.choices([f'w{k}' for k in range(900)], k=12))}</p>"
    pages = []
    for i in range(160):
        host = f"https://h{rng.choice([0, 0, 0, 1, 2])}.org/{i}"
        quarter = "<article>" * (i % 3 > 0)
        raw = f"<nav><ul><li>one<li>two {rng.choice('ab')}</ul></nav>{quarter}" + par() + rng.choice(["<div>Share it</div>", "<section><div>Share it</div><p>now</p></section>", ""]) + par()
        pages.append((i, host, raw + rng.choice(["<footer>end</footer>", '<div class="ad">buy</div>', "<div>tail</div>", par()])))
    pages += [(500 + i, f"https://single{i}.org/", "<nav>only here</nav><p>x") for i in range(3)] + [(600, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.extract(df, prior=False).collect()}
    want = brute_templates(pages)
    assert got == want
    assert sum("one" in t for t in got.values()) < 5 and sum("Share it" in t for t in got.values()) < 20 and got[500] == "only here\nx"
    with_prior = {r.page_id: r.text for r in html_main.extract(df).collect()}
    assert with_prior[500] == "x" and not any("buy" in t or "end" in t for t in with_prior.values())


def test_templates(spark):
    rng = random.Random(3)
    pages = []
    for i in range(60):
        host = "a.org" if i % 2 else "b.org"
        box = "<div><p>Follow us on every channel</p></div>" if host == "a.org" else ""
        own = "same article" if i % 10 == 1 else " ".join(rng.choices("abcdefgh", k=9))
        pages.append((i, f"https://{host}/{i}", f"<body><article><h1>{own}</h1>{box}<p>{own} text</article>"))
    copies = [(100 + i, f"http://c.org/{i}", "<article><p>one and</p><p>the same</p></article>") for i in range(30)]
    odd = [(200, None, None), (201, "x", "<p>loose"), (201, "x", "<p>loose")]
    df = spark.createDataFrame([(*p, "h") for p in pages + copies + odd], "page_id long, url string, html string, host string")
    got = [(r.page_id, r.text) for r in html_main.extract(df).orderBy("page_id").collect()]
    texts = dict(got)
    assert all("Follow" not in t for t in texts.values())
    assert all(texts[i].count("\n") == 1 for i in range(60)) and all(texts[100 + i] == "one and\nthe same" for i in range(30))
    assert got[-3:] == [(200, ""), (201, "loose"), (201, "loose")]
    assert html_main.extract(df.where("false")).count() == 0


def brute_components(rows):
    from quirelint.llm import jaccard  # noqa: F401

    sets = []
    for i, t in rows:
        w = (t or "").encode()
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and rows[x][0] is not None and rows[y][0] is not None and 100 * both >= 75 * len(sets[x] | sets[y]):
                label = [label[y] if k == label[x] else k for k in label]
    low: dict = {}
    for (i, _), k in zip(rows, label, strict=True):
        if i is not None:
            low[k] = min(low.get(k, i), i)
    return sorted((str(i), len(s), str(low.get(k) if i is not None else None)) for (i, _), s, k in zip(rows, sets, label, strict=True))


def near_rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(500)]
    rows: list[tuple] = [(5000, None), (5001, ""), (5002, "two words"), (5003, "TWO  words"), (None, "two words"), (5004, "one " * 50), (5005, "one " * 7)]
    for base in range(12):
        words = rng.choices(vocab, k=rng.choice([4, 12, 60, 200]))
        for c in range(rng.choice([1, 3, 30])):
            w = list(words)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((base * 100 + c, " ".join(w).lower() if c % 4 else "\t".join(w)))
    return rows + rows[9:11]


def test_signature_trees(spark, monkeypatch):
    from quirelint.llm import jaccard

    monkeypatch.setattr(repeats, "BATCH", 1 << 9)
    for seed, most in ((1, 2000), (2, 6)):
        rows = near_rows(seed)
        docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, cluster int")
        got = sorted((str(r.id), r.n, str(r.component)) for r in jaccard.near_duplicates(docs, max_sets=most).collect())
        assert got == brute_components(rows)
    assert jaccard.near_duplicates(docs.where("false")).count() == 0


def test_forest_prunes_exactly():
    from quirelint.llm import jaccard

    rng = np.random.default_rng(2)
    sets = []
    for _ in range(150):
        base = rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)
        for _ in range(rng.integers(1, 5)):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 2**63, len(base)).astype(np.uint64), base)))
    tree = jaccard.Tree(sets, np.zeros(len(sets), np.int64))
    found = {p for i, j in tree.pairs(75, lambda i, j: np.zeros(len(i), bool)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard.similar(sets[i], sets[j], 75)}
    assert want <= found and len(found) < len(sets) ** 2 / 10


def test_components(spark):
    from quirelint.llm import graph

    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(0, 400) if i % 50 != 49] + [(5, 300), (7, 7)] + [(rng.randint(500, 700), rng.randint(500, 700)) for _ in range(60)] + [(900, 1000 + i) for i in range(200)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    alone = {x for x in label if not any(x in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r.node: r.root for r in graph.components(df).collect()} == {k: v for k, v in label.items() if k not in alone}
    assert graph.components(df.where("false")).count() == 0


def test_components_read_edges_once_and_by_rounds_too(spark):
    from quirelint.llm import graph

    pairs = [(i, i + 3) for i in range(0, 60)] + [(100, 101), (101, 102), (200, 7)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.createDataFrame(pairs, "a long, b long").mapInArrow(counted, "a long, b long")
    one = {r.node: r.root for r in graph.components(edges).collect()}
    assert seen.value == len(pairs)  # links cost a join: their tasks run once
    assert one == {r.node: r.root for r in graph.components(edges, most=0).collect()}
    assert {one[i] for i in (0, 3, 60)} == {0} and one[1] == one[7] == one[200] == 1 and one[102] == 100



def test_templates_beside_templates(spark):
    """However much else recurs on a page, a footer of three blocks goes; near copies stay."""
    rng = random.Random(9)
    own = lambda: "".join(f"<p>{' '.join(rng.choices('abcdefghijklmnop', k=20))}</p>" for _ in range(8))
    foot = "<div><p>Imprint of the site</p><p>All rights kept</p><p>Call us now</p></div>"
    head = "".join(f"<div><p>Header block {k}</p></div>" for k in range(60))
    pages = [(i, f"https://many.org/{i}", f"<body>{head}{own()}{foot}") for i in range(31)]
    words = [rng.choices([f"w{k}" for k in range(500)], k=40) for _ in range(8)]
    for i in range(100, 140):  # near copies: a word of two paragraphs changed
        copy = [list(w) for w in words]
        for k in rng.sample(range(8), 2):
            copy[k][rng.randrange(40)] = f"edit{i}"
        pages.append((i, f"https://near.org/{i}", "<body>" + "".join(f"<p>{' '.join(w)}</p>" for w in copy)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in html_main.extract(df).collect()}
    assert all(texts[i].count("\n") == 7 and "Imprint" not in texts[i] and "Header" not in texts[i] for i in range(31))
    assert all(texts[i].count("\n") == 7 for i in range(100, 140))


def test_templates_of_small_hosts_and_sections(spark):
    rng = random.Random(12)
    own = lambda: f"<p>{' '.join(rng.choices([f'w{k}' for k in range(300)], k=30))}</p>"
    box = "<div><p>Notice of this section</p></div>"
    pages = [(i, f"https://small.org/{i}", f"<body>{box}{own()}{own()}") for i in range(4)]
    pages += [(i, f"https://large.org/{i}", f"<body>{box if i % 20 == 0 else ''}{own()}{own()}") for i in range(100, 500)]
    pages += [(i, f"https://pair.org/{i}", f"<body>{box if i < 602 else ''}{own()}{own()}") for i in range(600, 604)]
    texts = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i for i, t in texts.items() if "Notice" in t} == {600, 601} and all(t.count("\n") == 1 for i, t in texts.items() if i not in (600, 601))
