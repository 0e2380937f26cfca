"""Benchmark decontamination by a prefix-filtered set join.

Every run of ``k`` consecutive words of a benchmark item is a window (an item of fewer words is one
window). Shingles are ordered by rarity: a window's words are ranked by their counts over all
documents, and since containment must be complete, one prefix token suffices, the rarest. A
document word equal to a window's prefix token makes a candidate; the token's place in the window
gives the only possible start, which must leave the window inside the document (positional and
length bounds); hashes and then the words themselves are compared.

Windows are taken in blocks of ``BLOCK`` so that what a worker holds is bounded however large the
benchmark is; the documents are read once for each block's word counts and once for the match.

A null text has no words; null items and items without words have no window; items of equal id
count once; windows of items with a null id mark words but list no item; repeated documents give
equal rows; other columns are not read. Without windows nothing is hit; no documents, no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, WINDOW_BASE, Base, arrow_map, ship, slices, table, type_of

K, BLOCK, MASK_BITS = 10, 300_000, 22
#: candidates compared at a time
CANDIDATES = 1 << 18
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def _item_windows(k: int):
    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words((text or "").encode())
                found = {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary()), pa.array([item] * len(found), pa.string())], ["window", "item"])

    return run


def window_blocks(benchmark: DataFrame, k: int, block: int) -> Iterator[list[tuple[bytes, list[str]]]]:
    """Distinct windows with their items, ``block`` at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    found = arrow_map(items, _item_windows(k), "window binary, item string").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = ((bytes(r.window), list(r["items"])) for r in found.toLocalIterator())
    while part := list(itertools.islice(rows, block)):
        yield sorted(part)


def hash_words(joined: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all windows, and where each window's words start (and the end)."""
    data = np.frombuffer(b"\n".join(joined), np.uint8)
    offs = np.zeros(len(joined) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in joined], out=offs[1:])
    offs[-1] = len(data)
    starts, ends, first = ALNUM_WORDS.cut(data, offs)
    return ALNUM_WORDS.hashes(data, starts, ends), first


class Lookup:
    """Places of sorted 64-bit keys; most misses end at a bit table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.mask = np.zeros(1 << MASK_BITS, bool)
        self.mask[keys & np.uint64((1 << MASK_BITS) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in hashes, places in keys) of those that are keys."""
        at = np.flatnonzero(self.mask[hashes & np.uint64((1 << MASK_BITS) - 1)])
        place = np.searchsorted(self.keys, hashes[at])
        place[place == len(self.keys)] = 0
        same = self.keys[place] == hashes[at]
        return at[same], place[same]


def _counter(vocabulary):
    def run(batches):
        keys = Lookup(vocabulary.value)
        total = np.zeros(len(keys.keys), np.int64)
        for batch in batches:
            for _, data, offs in slices(batch, "text"):
                starts, ends, _ = ALNUM_WORDS.cut(data, offs)
                total += np.bincount(keys.find(ALNUM_WORDS.hashes(data, starts, ends))[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["place", "n"])

    return run


class Index:
    """Windows of a block by their prefix token."""

    def __init__(self, block: list[tuple[bytes, list[str]]], counts) -> None:
        """counts: token hashes (sorted, distinct) -> how often each occurs in the documents."""
        self.texts, self.items = [w for w, _ in block], [i for _, i in block]
        hashes, first = hash_words(self.texts)
        vocabulary, place = np.unique(hashes, return_inverse=True)
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.lexsort((vocabulary, counts(vocabulary)))] = np.arange(len(vocabulary))
        ranks, size = rank[place], np.diff(first)
        rarest = np.minimum.reduceat(ranks, first[:-1])
        is_rarest = np.flatnonzero(ranks == np.repeat(rarest, size))
        window = np.repeat(np.arange(len(size)), size)[is_rarest]
        window, once = np.unique(window, return_index=True)
        token_at = is_rarest[once]
        order = np.argsort(hashes[token_at], kind="stable")
        self.window, self.offset, self.size = window[order], (token_at - first[:-1][window])[order], size[order]
        self.hash = WINDOW_BASE.spans(WINDOW_BASE.sums(hashes), first[:-1][order], first[1:][order])
        prefix, start = np.unique(hashes[token_at][order], return_index=True)
        self.prefix, self.start, self.end = prefix, start, np.append(start[1:], len(order))

    def matches(self, hashes: np.ndarray, first: np.ndarray, base: Base, lookup: Lookup) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first word of each match, place in the index), by hashes; ``CANDIDATES`` at a time, a word's at least."""
        at, place = lookup.find(hashes)
        count = (self.end - self.start)[place]
        filled = np.cumsum(count)
        sums = base.sums(hashes)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(filled, (filled[a - 1] if a else 0) + CANDIDATES, "right")))
            n = count[a:b]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[place[a:b]], n)
            word = np.repeat(at[a:b], n)
            a = b
            begin = word - self.offset[entry]
            end = begin + self.size[entry]
            row = np.searchsorted(first, word, "right") - 1
            fits = (begin >= first[row]) & (end <= first[row + 1])
            begin, end, entry = begin[fits], end[fits], entry[fits]
            if len(begin):
                same = base.spans(sums, begin, end) == self.hash[entry]
                yield begin[same], entry[same]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _matcher(index):
    def run(batches):
        ix = index.value
        lookup = Lookup(ix.prefix)
        for batch in batches:
            for part, data, offs in slices(batch, "text"):
                starts, ends, first = ALNUM_WORDS.cut(data, offs)
                spans, items = part.column("spans").to_pylist(), [set(x) for x in part.column("items").to_pylist()]
                spans = [[(s["a"], s["b"]) for s in x] for x in spans]
                for begin, entry in ix.matches(ALNUM_WORDS.hashes(data, starts, ends), first, WINDOW_BASE, lookup):
                    row = np.searchsorted(first, begin, "right") - 1
                    touched = set()
                    for b, e, r in zip(begin.tolist(), entry.tolist(), row.tolist(), strict=True):
                        w, n = int(ix.window[e]), int(ix.size[e])
                        if b" ".join(words(data[starts[b] : ends[b + n - 1]].tobytes())) == ix.texts[w]:
                            spans[r].append((b - int(first[r]), b - int(first[r]) + n))
                            items[r].update(ix.items[w])
                            touched.add(r)
                    for r in touched:
                        spans[r] = merged(spans[r])
                columns = {"n_words": pa.array(np.diff(first), pa.int64()), "spans": pa.array([[{"a": a, "b": b} for a, b in x] for x in spans], SPANS), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([columns.get(c, part.column(c)) if c in columns else part.column(c) for c in part.schema.names], part.schema.names)

    return run


def match(docs: DataFrame, benchmark: DataFrame, k: int = K, block: int = BLOCK, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(the kept columns, n_words, spans of hit words [a, b), items): one row for each document."""
    spark = docs.sparkSession
    ship(spark)
    kinds = ", ".join(f"`{c}` {type_of(docs, c)}" for c in keep)
    rest = "n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>"
    out = docs.select(*keep, F.col(text_col).alias("__text"))
    none = [F.lit(None).cast(t).alias(n) if n == "n_words" else F.array().cast(t).alias(n) for n, t in (("n_words", "bigint"), ("spans", "array<struct<a:bigint,b:bigint>>"), ("items", "array<string>"))]
    out = out.select(*keep, F.col("__text").alias("text"), *none) if "text" not in keep else out.select(*keep, *none)
    have = f"{kinds}, {rest}" if "text" in keep else f"{kinds}, text string, {rest}"
    blocks = 0
    for part in window_blocks(benchmark, k, block):
        vocabulary = np.unique(hash_words([w for w, _ in part])[0])
        shared = spark.sparkContext.broadcast(vocabulary)
        counted = arrow_map(docs.select(F.col(text_col).alias("text")), _counter(shared), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
        total = np.zeros(len(vocabulary), np.int64)
        for r in counted.collect():  # a row at most for each word of the block
            total[r.place] = r.n
        out = arrow_map(out, _matcher(spark.sparkContext.broadcast(Index(part, lambda v, c=total: c))), have)
        blocks += 1
    if not blocks:
        out = arrow_map(out, _matcher(spark.sparkContext.broadcast(_Nothing())), have)
    return out.select(*keep, "n_words", "spans", "items")


class _Nothing:
    prefix = np.zeros(1, np.uint64)

    def matches(self, hashes, first, base, lookup):
        return iter(())


def op7_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
