"""Shared parts: reading tables, Arrow batches as byte arrays, vectorised token and window hashes.

Tokens are hashed without a Python loop. With S the running sum of code[byte] * B**position
(modulo 2**64, B odd), a token's hash is (S[end] - S[start]) * B**-start; windows of tokens
are hashed the same way over the token hashes. Sums modulo a power of two can be made to collide from 1,024
letters on, whatever B is, so tokens of ``LONG`` bytes or more get another hash. Batches are cut to whole rows of about
``SLICE_BYTES``, so memory follows the longest text, not the partition.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 500_000
#: bytes of an Arrow batch between Spark and its Python workers, where the session has the default of 64 MB
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: symbols hashed at a time, whatever the length of a text
PIECE = 2 * SLICE_BYTES
#: bytes from which a token is hashed by itself
LONG = 128
ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where they see the driver's files (else: --py-files), and keeps their batches small."""
    if spark.conf.get(BATCH_CONF) == "67108864b":
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def checkpoint(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Writes ``df`` to the session's checkpoint folder, so that lost executors cost no recomputation.

    The context's cleaner deletes it when nothing refers to it (``spark.cleaner.referenceTracking.cleanCheckpoints``). The cleaner learns that when
    the driver collects its garbage; with ``tidy`` it does so here, which also keeps its heap from growing over a query of many plans.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    if tidy:
        df.sparkSession._jvm.System.gc()
    return out


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where the session names none and runs on one machine (tests)."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="quirelint-")
        sc.setCheckpointDir(folder)
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store, with all that is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows: (rows, their UTF-8 bytes, byte offset of each row and of the end). Null: empty."""
    if not batch.num_rows:
        return
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1)
        to = min(to, len(texts))
        yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def splitmix(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Base:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, seed: int) -> None:
        self.b = (int(splitmix(1, seed)[0]) | 5) & ~2 & (2**64 - 1)
        self.inv = pow(self.b, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _powers(b: int, n: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0], have, step = 1, 1, b
        while have < n:  # doubling: b**(have + i) = b**have * b**i
            m = min(have, n - have)
            out[have : have + m] = out[:m] * np.uint64(step)
            have, step = have + m, step * step % 2**64
        return out

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = self._powers(self.b, n), self._powers(self.inv, n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Running sums, with 0 first."""
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], mixed; starts and ends may be slices of equal length."""
        return mix((sums[ends] - sums[starts]) * self.down[starts])


BYTES_BASE, WINDOW_BASE, SECOND_BASE = Base(11), Base(23), Base(37)


class Tokens:
    """How bytes form tokens. classes: byte -> 0 separator, else the token's kind; fold: byte -> byte."""

    def __init__(self, classes: np.ndarray, lower: bool) -> None:
        self.classes, self.lower = classes, lower
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
        self.codes = splitmix(256, 7)[fold]

    def cut(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token starts, token ends, index of each row's first token and of the end)."""
        kind, n = self.classes[data], len(data)
        edge = np.ones(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:n]) if n else None
        edge[offs] = True
        at = np.flatnonzero(edge)
        keep = kind[at[:-1]] > 0 if n else np.zeros(0, bool)
        starts, ends = at[:-1][keep], at[1:][keep]
        return starts, ends, np.searchsorted(starts, offs)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Long texts are hashed in pieces; a hash doesn't depend on where its token stands."""
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            sums = BYTES_BASE.sums(self.codes[data[base : ends[to - 1]]])
            out[at:to] = BYTES_BASE.spans(sums, starts[at:to] - base, ends[at:to] - base)
            at = to
        for i in np.flatnonzero(ends - starts >= LONG).tolist():
            token = data[starts[i] : ends[i]].tobytes()
            out[i] = xxhash.xxh3_64_intdigest(token.lower() if self.lower else token)
        return out + (ends - starts).astype(np.uint64)


def _classes(separators: list[int], punctuation: bool = False) -> np.ndarray:
    out = np.ones(256, np.uint8)
    out[separators] = 0
    if punctuation:
        out[[b for b in range(0x21, 0x80) if not chr(b).isalnum()]] = 2
    return out


SPACES = [0x20, *range(0x09, 0x0E)]
#: words [^\x20\x09-\x0D]+, as they are, and with A-Z lower-cased
WORDS = Tokens(_classes(SPACES), lower=False)
LOWER_WORDS = Tokens(_classes(SPACES), lower=True)
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased
ALNUM_WORDS = Tokens(_classes([b for b in range(0x80) if not chr(b).isalnum()]), lower=True)
#: words and runs of punctuation
WORD_PUNCT = Tokens(_classes([*range(0x21), 0x7F], punctuation=True), lower=True)


def windows(hashes: np.ndarray, first: np.ndarray, k: int, base: Base = WINDOW_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of k tokens inside one row: (index of its first token, hash)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row_end = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(np.arange(k, n + 1) <= row_end[: n - k + 1])
    out = np.empty(len(starts), np.uint64)
    for a in range(0, n - k + 1, PIECE):
        i, j = np.searchsorted(starts, (a, a + PIECE))
        part = starts[i:j] - a
        out[i:j] = base.spans(base.sums(hashes[a : a + PIECE + k - 1]), part, part + k)
    return starts, out


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def group_key(column) -> list:
    """Two independent 64-bit hashes of a text: equal texts have equal keys."""
    text = F.coalesce(column, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
