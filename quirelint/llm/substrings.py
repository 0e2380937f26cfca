"""Substring dedup by seed and extend: removes words covered by 50 consecutive words that also start in a document with a smaller id.

Documents meet on winnowed anchors of 25 words (``repeats``). In a bucket the runs around a shared anchor
are extended both ways from it, word by word: after each step runs are in one class if the anchor and all
words so far are equal, to the left and to the right apart. A window of l words before the anchor and 25 - l
after it is repeated where runs agree in the class of l steps left and that of 25 - l steps right, so
all runs of an anchor are extended at once, never pair by pair. Neighbouring matches join to maximal
repeats of at least 50 words. Words are compared as such, not by hash.

Null texts count as empty, texts under 50 words lose nothing, repeated rows of one id don't count
against each other, rows with a null id neither lose nor cause anything, and other columns are not read;
an empty table gives an empty one, and a very long text is hashed in pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS, table
from .repeats import Block, Symbols, removed

LENGTH, K = 50, 25


def _refined(classes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Classes of equal (class, word)."""
    return np.unique(classes * (words.max() + 1) + words, return_inverse=True)[1] if len(words) else classes


def extend(block: Block) -> np.ndarray:
    """For each window of each run, in order: the smallest ``low`` of a run that has it."""
    numbers: dict[bytes, int] = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for w in block.texts.split(b" ")[:-1]], np.int64)
    count = block.n + block.length - 1
    first = np.cumsum(count) - count
    anchor, ends = first + block.at, first + count
    classes = np.zeros(len(count), np.int64)
    for step in range(block.k):
        classes = _refined(classes, words[anchor + step])
    most = block.length - block.k

    def steps(place) -> list[np.ndarray]:
        """After each step the classes, -1 where a run has ended."""
        out = [classes]
        for step in range(1, most + 1):
            at = place(step)
            on = np.flatnonzero((at >= first) & (at < ends))
            now = np.full(len(classes), -1)
            now[on] = _refined(out[-1][on], words[at[on]])
            out.append(now)
        return out

    left, right = steps(lambda step: anchor - step), steps(lambda step: anchor + block.k - 1 + step)
    out = np.empty(int(block.n.sum()), np.int64)
    offset = np.cumsum(block.n) - block.n
    for step in range(most + 1):
        window = block.at - step
        on = np.flatnonzero((window >= 0) & (window < block.n))
        if len(on):
            both = _refined(left[step][on], right[most - step][on])
            least = np.full(both.max() + 1, 2**63 - 1)
            np.minimum.at(least, both, block.low[on])
            out[offset[on] + window[on]] = least[both]
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """(id, n, spans, kept) in words; kept is UTF-8, words joined by one space."""
    return removed(docs, Symbols(length, k, extend, WORDS), id_col, text_col)


def op2_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
