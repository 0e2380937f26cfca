"""Suffix-array dedup: removes bytes covered by a 50-byte string that also starts in a document with a smaller id.

Blocks are the passages around shared anchors (``repeats``), all texts of a block joined by a separator.
Its suffixes are sorted by their first 50 bytes and more, which gives the Burrows-Wheeler transform. Common
prefixes of neighbours in that order are then derived by increasing value, breadth first: from the interval
[lo, hi) of suffixes that start with P, backward extension gives that of cP for every byte c before a suffix in it.
Values below 8 show in the keys of the sort. Extension from strings of n bytes finds the borders hi across which the common prefix is n bytes; an
interval that finds no new border isn't extended again, so each border costs its interval once and not once
a byte. Expansion stops at ``length``: across the borders never found 50 bytes or more are common. Longer
values are never derived: overlapping windows cover them. Whatever is removed lies between borders of this
index, in whole intervals of equal 50-byte strings; anchors only say which texts come into a block.

Null texts count as empty, texts under 50 bytes lose nothing, repeated rows of one id don't count
against each other, rows with a null id neither lose nor cause anything, and other columns are not read;
an empty table gives an empty one, and a very long text is hashed in pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import Block, Symbols, removed, within

LENGTH, K = 50, 20
#: never in UTF-8: after each text, and once after the last
SEPARATOR, END = 0xFF, 0xFE


#: bytes that one key of the first sort holds; keys of its ranks that one key of later sorts holds, RANK bits each
FIRST, TOGETHER, RANK = 8, 3, 21


def bounded_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes or more, by tripling from 8; and their first 8 bytes in that order."""
    n = len(text)
    padded = np.append(text, np.zeros(FIRST, np.uint8))
    key = np.ndarray(n, ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    size, initial = FIRST, key
    together, bits = (TOGETHER, RANK) if n < 1 << RANK else (2, 32)
    while True:
        order = np.argsort(key)
        if size >= depth:
            return order, initial[order]
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(np.uint64(1), (ordered[1:] != ordered[:-1]).astype(np.uint64)))
        if rank[order[-1]] == n:
            return order, initial[order]
        key = rank << np.uint64(bits * (together - 1))
        for j in range(1, together):
            if n > j * size:
                key[: n - j * size] |= rank[j * size :] << np.uint64(bits * (together - 1 - j))
        size *= together


def borders(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before it, ``length`` for as long or longer); text ends with a byte of its own.

    The keys of the first sort tell common prefixes of up to 7 bytes; from the strings of 8 bytes on they are found by extension.
    """
    n = len(text)
    order, keys = bounded_order(text, length)
    common = np.full(n + 1, length, np.int64)
    common[n] = common[0] = 0
    apart = keys[1:] ^ keys[:-1]
    at = np.flatnonzero(apart)
    short = np.zeros(len(at), np.int64)
    for j in range(1, FIRST):
        short += apart[at] < np.uint64(1) << np.uint64(8 * (FIRST - j))
    common[at + 1] = np.minimum(short, length)
    if length <= FIRST - 1:
        return order, common[:n]
    # intervals of strings of 8 bytes; those whose end was found last are extended
    bounds = np.append(0, np.append(at + 1, n))
    new = common[bounds[1:]] == FIRST - 1
    new[-1] = False
    size = np.diff(bounds)
    rows, interval = np.flatnonzero(np.repeat(new, size)), np.repeat(np.arange(len(size)), np.where(new, size, 0))
    initial = (keys >> np.uint64(8 * (FIRST - 1))).astype(np.uint8)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    before = inverse[order - 1]  # the row of the suffix one byte longer; that of the whole text has none
    owner, marked = np.zeros(n, np.int64), np.zeros(n, bool)
    for value in range(FIRST, length):
        go = order[rows] > 0
        to = before[rows[go]]
        if not len(to):
            break
        owner[to] = interval[go]
        if len(to) * 16 > n:
            marked[to] = True
            rows = np.flatnonzero(marked)
            marked[to] = False
        else:
            rows = np.sort(to)
        of, byte = owner[rows], initial[rows]
        last = np.append((of[1:] != of[:-1]) | (byte[1:] != byte[:-1]), True)
        ends = np.flatnonzero(last)
        hi = rows[ends] + 1
        new = common[hi] == length
        new[hi == n] = False
        common[hi[new]] = value
        size = np.diff(ends, prepend=-1)
        rows, interval = rows[np.repeat(new, size)], np.repeat(np.arange(len(size)), np.where(new, size, 0))
    return order, common[:n]


def smallest(block: Block) -> np.ndarray:
    """For each window of each text, in order: the smallest ``low`` of a text that has it."""
    sizes, n = block.size, block.n
    starts = np.cumsum(sizes) - sizes
    joined = np.full(len(block.texts) + len(sizes) + 1, SEPARATOR, np.uint8)
    joined[-1] = END
    joined[np.arange(len(block.texts)) + np.repeat(np.arange(len(sizes)), sizes)] = np.frombuffer(block.texts, np.uint8)
    order, common = borders(joined, block.length)
    owner = np.append(np.repeat(np.arange(len(sizes)), sizes + 1), len(sizes) - 1)
    heads = np.flatnonzero(common < block.length)
    least = np.minimum.reduceat(block.low[owner[order]], heads)
    out = np.empty(len(joined), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return out[np.repeat(starts + np.arange(len(sizes)), n) + within(n)]


SYMBOLS = Symbols(LENGTH, K, smallest)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, spans, kept) in bytes."""
    return removed(docs, SYMBOLS, id_col, text_col)


def op4_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"), (F.col("n") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
