"""What the two substring operators share: repeated windows of ``length`` symbols across documents.

Seeds. Of the k-grams in a window the leftmost of smallest hash is its anchor (winnowing), so equal
windows have equal anchors at equal places. Consecutive windows with one anchor are a run. Documents
are dealt by id and text into batches of some MB. Each question that one batch can't answer alone goes
out packed by hash into buckets, and the answers come back as bits in the same order:

1. Which anchors are in several documents? Which are hot, with very many different runs?
2. Of every shared anchor each batch sends its different runs, symbols and all, with the smallest id
   that holds them. A bucket compares the runs of an anchor symbol by symbol (by extension from the
   anchor, ``substrings``; in a block index, ``suffixes``) and tells of each window whether a
   smaller id has it.

Hashes only bring runs together; nothing is removed unless its symbols were compared, in a bucket or,
for repeats inside a batch, as bytes. An entry is sent once a batch however often it occurs, so a hot
run costs a bucket one entry a batch. A hot anchor's windows are dealt one by one, by their own hash. The
texts are shuffled once, by batch; all steps read that exchange.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WINDOW_BASE, Tokens, arrow_map, ship, slices, splitmix

#: bytes of input that a batch has at least and at most, as the planner estimates them; between, a batch grows with the root of the input
BATCH, LARGEST = 1 << 20, 32 << 20
#: different runs of an anchor, beyond one a batch, from which its windows are dealt one by one
HOT = 4000
#: bytes of different runs that a bucket compares at a time, more only for one key
BLOCK = 1 << 19
#: symbols hashed at a time
PIECE = 1 << 16
BYTE_CODES = splitmix(256, 3)


@dataclass
class Symbols:
    """What a text's symbols are: bytes, or words if ``tokens`` is set; ``judge`` tells of each window in a ``Block`` the smallest id that has it."""

    length: int
    k: int
    judge: Callable[[Block], np.ndarray]
    tokens: Tokens | None = None

    def codes(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, index of each row's first symbol and of the end): bytes as they are, words as hashes."""
        if self.tokens is None:
            return data, offs
        starts, ends, first = self.tokens.cut(data, offs)
        return self.tokens.hashes(data, starts, ends), first


@dataclass
class Block:
    """Different runs to compare: their joined bytes (words joined by spaces, a space after each run), the bytes, windows, smallest id of each, and the anchor's place in it."""

    texts: bytes
    size: np.ndarray
    n: np.ndarray
    low: np.ndarray
    at: np.ndarray
    length: int
    k: int


@dataclass
class Runs:
    row: np.ndarray
    start: np.ndarray  # symbol of the row
    n: np.ndarray  # windows
    at: np.ndarray  # the anchor's first symbol, from the start
    anchor: np.ndarray
    content: np.ndarray  # a hash, to count different runs

    def take(self, which: np.ndarray) -> Runs:
        return Runs(*(x[which] for x in (self.row, self.start, self.n, self.at, self.anchor, self.content)))


def hashed(codes: np.ndarray) -> np.ndarray:
    return BYTE_CODES[codes] if codes.dtype == np.uint8 else codes


def smallest_of(grams: np.ndarray, w: int) -> np.ndarray:
    least, size = grams, 1
    while size < w:
        step = min(size, w - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return least


def anchors_of(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest of each w neighbours, place of the leftmost such)."""
    least, at, size = grams, np.arange(len(grams), dtype=np.int32), 1
    while size < w:
        step = min(size, w - size)
        left = least[:-step] <= least[step:]
        least, at = np.where(left, least[:-step], least[step:]), np.where(left, at[:-step], at[step:])
        size += step
    return least, at


def find_runs(codes: np.ndarray, first: np.ndarray, length: int, k: int) -> Runs:
    """Long input is taken in overlapping pieces. A run across two of them comes as two, which changes no answer: every window is still in one run."""
    n = len(codes)
    if n > PIECE + length:
        parts = []
        for a in range(0, n - length + 1, PIECE):
            part = codes[a : a + PIECE + length - 1]
            own = np.clip(first - a, 0, len(part))
            r = find_runs(part, own, length, k)
            r.start = r.start + own[r.row] + a - first[r.row]
            parts.append(r)
        return join_runs(parts)
    codes = hashed(codes)
    if n < length:
        return Runs(*(np.zeros(0, np.int64),) * 4, *(np.zeros(0, np.uint64),) * 2)
    sums = WINDOW_BASE.sums(codes)
    grams = (sums[k:] - sums[:-k]) * WINDOW_BASE.down[: n - k + 1]
    row_end = np.repeat(first[1:], np.diff(first))[: n - length + 1]
    ok = np.arange(length, n + 1) <= row_end

    def cut(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last windows of neighbours that are equal in ``by``."""
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (by[1:] != by[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | new[1:]
        return np.flatnonzero(new), np.flatnonzero(last)

    w = length - k + 1
    least = smallest_of(grams, w)
    start, stop = cut(least)
    at = (grams[start[:, None] + np.arange(w)] == least[start][:, None]).argmax(1) if len(start) else start
    bad = np.flatnonzero(stop > start + at)
    if len(bad):  # a gram twice in a window: neighbours of one smallest hash have several anchors
        place = np.zeros(len(ok), np.int64)
        place[start] = start + at
        place = place[np.maximum.accumulate(np.where(place > 0, np.arange(len(ok)), 0))]
        count = stop[bad] - start[bad] + 1
        size = count + w - 1
        offset = np.cumsum(size) - size
        far = start[bad] - offset  # from places in the joined stretches to places in the text
        found = anchors_of(grams[np.repeat(far, size) + np.arange(size.sum())], w)[1]
        step = within(count)
        place[np.repeat(start[bad], count) + step] = found[np.repeat(offset, count) + step] + np.repeat(far, count)
        start, stop = cut(place)
        at = place[start] - start
    row = np.searchsorted(first, start, "right") - 1
    return Runs(row, start - first[row], stop - start + 1, at, least[start], WINDOW_BASE.spans(sums, start, stop + length))


def join_runs(parts: list[Runs]) -> Runs:
    return Runs(*(np.concatenate(x) for x in zip(*((r.row, r.start, r.n, r.at, r.anchor, r.content) for r in parts), strict=True)))


def batch_runs(rows: pa.RecordBatch, symbols: Symbols) -> Runs:
    parts, at = [find_runs(np.zeros(0, np.uint64), np.zeros(1, np.int64), symbols.length, symbols.k)], 0
    # whole rows, a longer one alone: where pieces are cut mustn't depend on the order in which a batch's rows arrive
    for part, data, offs in slices(rows, "text", PIECE):
        r = find_runs(*symbols.codes(data, offs), symbols.length, symbols.k)
        r.row = r.row + at
        parts.append(r)
        at += part.num_rows
    return join_runs(parts)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def bucket_of(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    return (_mixed(hashes) % np.uint64(n_buckets)).astype(np.int64)


def by_bucket(hashes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order that puts hashes, sorted already, together by bucket; (bucket, from, to) in that order)."""
    if not len(hashes):
        return np.zeros(0, np.int64), []
    bucket = bucket_of(hashes, n_buckets)
    order = np.argsort(bucket, kind="stable")
    found, start = np.unique(bucket[order], return_index=True)
    return order, list(zip(found.tolist(), start.tolist(), np.append(start[1:], len(order)).tolist(), strict=True))


def pack(*flags: np.ndarray) -> bytes:
    return b"".join(np.packbits(f).tobytes() for f in flags)


def unpack(blob: bytes, n: int, k: int = 1) -> list[np.ndarray]:
    size = -(-n // 8)
    return [np.unpackbits(np.frombuffer(blob, np.uint8, size, j * size), count=n).astype(bool) for j in range(k)]


def within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[0] - 1, 0, 1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


#: a power of two as a byte, in eighths
def as_level(count: np.ndarray) -> np.ndarray:
    return np.round(8 * np.log2(count)).astype(np.uint8)


def level_of(code: np.ndarray) -> np.ndarray:
    return np.exp2(code / 8)


class Entries:
    """A batch's runs and what the answers so far say of them."""

    def __init__(self, table: pa.Table, answers: pa.Table | None, symbols: Symbols, n_buckets: int) -> None:
        self.symbols, self.n_buckets = symbols, n_buckets
        self.rows = self.batch(table)
        has_id = self.rows.column("id").is_valid().to_numpy(zero_copy_only=False)
        self.ids = self.rows.column("id").fill_null(0).to_numpy()
        runs = batch_runs(self.rows, symbols)
        self.runs = runs.take(has_id[runs.row])
        self.answers = self.by_step(answers)

    @staticmethod
    def batch(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], table.schema.names)

    @staticmethod
    def by_step(answers: pa.Table | None) -> dict[tuple[int, int], bytes]:
        if answers is None:
            return {}
        return {(s, b): x for s, b, x in zip(*(answers.column(c).to_pylist() for c in ("step", "bucket", "blob")), strict=True)}

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct anchors, how many different runs each has, whether an anchor is in several of the batch's documents)."""
        r = self.runs
        order = np.lexsort((r.content, r.anchor))
        a, c = r.anchor[order], r.content[order]
        new = np.append(True, a[1:] != a[:-1]) if len(a) else np.zeros(0, bool)
        other = new | np.append(True, c[1:] != c[:-1]) if len(a) else new
        at = np.flatnonzero(new)
        if not len(at):
            return a, np.zeros(0, np.int64), new
        ids = self.ids[r.row][order]
        return a[at], np.add.reduceat(other.astype(np.int64), at), np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at)

    def compare(self) -> None:
        """What is to be compared: pieces (a run with a shared anchor, or a window of one with a hot anchor) and the different texts among them."""
        r, length = self.runs, self.symbols.length
        anchors, place = np.unique(r.anchor, return_inverse=True)
        shared, hot = np.zeros(len(anchors), bool), np.zeros(len(anchors), bool)
        order, parts = by_bucket(anchors, self.n_buckets)
        for bucket, i, j in parts:
            shared[order[i:j]], hot[order[i:j]] = unpack(self.answers[1, bucket], j - i, 2)
        keep = shared[place]
        r, is_hot = r.take(keep), hot[place][keep]
        count = np.where(is_hot, r.n, 1)
        of, step = np.repeat(np.arange(len(count)), count), within(count)
        self.row, self.start, self.n = r.row[of], r.start[of] + step, np.where(is_hot, 1, r.n)[of]
        at, is_hot, anchor = (r.at[of] - step).tolist(), is_hot[of].tolist(), r.anchor[of].tolist()
        ends = (self.start + self.n + length - 1).tolist()
        starts, ids = self.start.tolist(), self.ids.tolist()
        seen: dict[bytes, int] = {}
        text_of, key, low, places, entry = [], [], [], [], np.empty(len(of), np.int64)
        bounds = np.flatnonzero(np.append(True, self.row[1:] != self.row[:-1])).tolist() if len(of) else []
        for a, b in itertools.pairwise([*bounds, len(of)]):
            row = int(self.row[a])
            cut, ident = self._cutter(row), ids[row]
            for i in range(a, b):
                text = cut(starts[i], ends[i])
                e = seen.setdefault(text, len(seen))
                entry[i] = e
                if e == len(text_of):
                    text_of.append(text)
                    key.append(xxhash.xxh3_64_intdigest(text) if is_hot[i] else anchor[i])
                    low.append(ident)
                    places.append(at[i])
                elif ident < low[e]:
                    low[e] = ident
        # an order that doesn't depend on that of the rows
        keys = np.array(key, np.uint64)
        bucket = bucket_of(keys, self.n_buckets) if len(keys) else np.zeros(0, np.int64)
        by_text = np.array(sorted(range(len(key)), key=text_of.__getitem__), np.int64)
        order = by_text[np.lexsort((keys[by_text], bucket[by_text]))]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.entry, self.bucket, self.key = rank[entry], bucket[order], keys[order]
        self.low, self.at = np.array(low, np.int64)[order], np.array(places, np.int64)[order]
        self.text = [text_of[e] for e in order.tolist()]
        self.windows = np.empty(len(order), np.int64)
        self.windows[self.entry] = self.n

    def _cutter(self, row: int) -> Callable[[int, int], bytes]:
        """A function that gives the symbols from a to b as bytes, words with one space between."""
        raw = self.rows.column("text")[row].as_buffer().to_pybytes()
        if self.symbols.tokens is None:
            return lambda a, b: raw[a:b]
        starts, ends, _ = self.symbols.tokens.cut(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        starts, ends = starts.tolist(), ends.tolist()
        return lambda a, b: b" ".join(raw[starts[a] : ends[b - 1]].split())

    def parts(self) -> list[tuple[int, int, int]]:
        """(bucket, first entry, last entry and one)."""
        found, start = np.unique(self.bucket, return_index=True)
        return [(b, *x) for b, x in zip(found.tolist(), itertools.pairwise([*start.tolist(), len(self.bucket)]), strict=False)]

    def covered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first symbol, end) of stretches of windows that smaller ids have."""
        told = [unpack(self.answers[2, b], int(self.windows[i:j].sum()))[0] for b, i, j in self.parts()]
        flags = np.concatenate(told) if told else np.zeros(0, bool)
        offset = np.cumsum(self.windows) - self.windows
        whole = self.ids[self.row] > self.low[self.entry]
        if len(offset):
            whole |= np.logical_and.reduceat(flags, offset)[self.entry]
        left = np.flatnonzero(~whole)
        n = self.n[left]
        step = within(n)
        hit = flags[np.repeat(offset[self.entry[left]], n) + step]
        row, start = np.repeat(self.row[left], n)[hit], (np.repeat(self.start[left], n) + step)[hit]
        row, start = np.append(self.row[whole], row), np.append(self.start[whole], start)
        end = start + np.append(self.n[whole], np.ones(int(hit.sum()), np.int64)) + self.symbols.length - 1
        return row, start, end


ASK = "bucket int, batch int, blob binary"
TELL = "batch int, step int, bucket int, blob binary"


def _ask(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    bucket, batch, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(bucket, pa.int32()), pa.array(batch, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "batch", "blob"])


def _of(table: pa.Table) -> int:
    return table.column("batch")[0].as_py()


def _ask_anchors(symbols: Symbols, n_buckets: int):
    def run(texts: pa.Table) -> pa.Table:
        anchors, count, several = Entries(texts, None, symbols, n_buckets).anchors()
        order, parts = by_bucket(anchors, n_buckets)
        return _ask([(b, _of(texts), anchors[order[i:j]].tobytes() + as_level(count[order[i:j]]).tobytes() + pack(several[order[i:j]])) for b, i, j in parts])

    return run


def _ask_windows(symbols: Symbols, n_buckets: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _ask([])
        e = Entries(texts, answers, symbols, n_buckets)
        e.compare()
        rows = []
        for b, i, j in e.parts():
            head = np.array([j - i], np.int64), e.key[i:j], e.low[i:j], np.array([len(x) for x in e.text[i:j]], np.uint32), e.windows[i:j].astype(np.uint32), e.at[i:j].astype(np.uint32)
            rows.append((b, _of(texts), b"".join(x.tobytes() for x in head) + b"".join(e.text[i:j])))
        return _ask(rows)

    return run


def _buckets(batches) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Rows sorted by bucket, a bucket at a time."""
    now, of, blobs = None, [], []
    for batch in batches:
        for bucket, sender, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "batch", "blob")), strict=True):
            if bucket != now and blobs:
                yield now, of, blobs
                of, blobs = [], []
            now = bucket
            of.append(sender)
            blobs.append(blob)
    if blobs:
        yield now, of, blobs


def _tell(step: int, bucket: int, of: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    n = len(of)
    return pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([step] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(blobs, pa.binary())], ["batch", "step", "bucket", "blob"])


def _answer(step: int, judge: Callable[[list[bytes]], list[bytes]]):
    def run(batches):
        for bucket, of, blobs in _buckets(batches):
            yield _tell(step, bucket, of, judge(blobs))

    return run


def _split(flags: list[np.ndarray], sizes: list[int]) -> list[bytes]:
    at = np.cumsum([0, *sizes])
    return [pack(*(f[a:b] for f in flags)) for a, b in zip(at[:-1], at[1:], strict=True)]


def count_in(size: int, width: int) -> int:
    """n with width n + ceil(n / 8) = size."""
    n = size * 8 // (8 * width + 1)
    while width * n + -(-n // 8) < size:
        n += 1
    return n


def shared_anchors(blobs: list[bytes]) -> list[bytes]:
    sizes = [count_in(len(x), 9) for x in blobs]
    anchors = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(blobs, sizes, strict=True)])
    more = np.concatenate([level_of(np.frombuffer(x, np.uint8, n, 8 * n)) for x, n in zip(blobs, sizes, strict=True)]) - 1
    several = np.concatenate([unpack(x[9 * n :], n)[0] for x, n in zip(blobs, sizes, strict=True)])
    _, place, count = np.unique(anchors, return_inverse=True, return_counts=True)
    many = count > 1
    many[place[several]] = True
    return _split([many[place], (np.bincount(place, more) > HOT)[place]], sizes)


def judged(symbols: Symbols):
    def judge(blobs: list[bytes]) -> list[bytes]:
        counts = [int(np.frombuffer(x, np.int64, 1)[0]) for x in blobs]
        field = lambda t, skip: np.concatenate([np.frombuffer(x, t, n, 8 + skip * n) for x, n in zip(blobs, counts, strict=True)])
        key, low = field(np.uint64, 0), field(np.int64, 8)
        size, n, at = (field(np.uint32, 16 + 4 * j).astype(np.int64) for j in range(3))
        texts = [memoryview(x)[8 + 28 * c :] for x, c in zip(blobs, counts, strict=True)]
        sender = np.repeat(np.arange(len(blobs)), counts)
        begin = np.cumsum(size) - size
        begin -= np.repeat(begin[np.cumsum([0, *counts[:-1]])], counts)
        windows_at = np.cumsum(n) - n
        flags = np.zeros(int(n.sum()), bool)
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])).tolist()
        sep = b"" if symbols.tokens is None else b" "
        sender, begin = sender.tolist(), begin.tolist()
        block: list[tuple[bytes, list[int]]] = []  # different texts, each with its entries
        held = 0

        def compare() -> None:
            # of equal texts one is compared, for the smallest id, and every window's smallest id is told to all
            first = np.array([x[0] for _, x in block])
            least = np.minimum.reduceat(low[np.concatenate([x for _, x in block])], np.cumsum([0] + [len(x) for _, x in block[:-1]]))
            smallest = symbols.judge(Block(b"".join(t + sep for t, _ in block), size[first], n[first], least, at[first], symbols.length, symbols.k))
            offset = np.cumsum(n[first]) - n[first]
            own = np.concatenate([x for _, x in block])
            of = np.repeat(np.arange(len(block)), [len(x) for _, x in block])
            step = within(n[own])
            flags[np.repeat(windows_at[own], n[own]) + step] = smallest[np.repeat(offset[of], n[own]) + step] < np.repeat(low[own], n[own])

        for a, b in itertools.pairwise([*heads, len(order)]):
            same: dict[bytes, list[int]] = {}
            for i, k in zip(order[a:b].tolist(), size[order[a:b]].tolist(), strict=True):
                same.setdefault(bytes(texts[sender[i]][begin[i] : begin[i] + k]), []).append(i)
            more = sum(map(len, same))
            if held and held + more > BLOCK:
                compare()
                block, held = [], 0
            block += same.items()
            held += more
        if block:
            compare()
        sent = np.add.reduceat(n, np.cumsum([0, *counts[:-1]]))
        return _split([flags], sent.tolist())

    return judge


def _finish(symbols: Symbols, n_buckets: int, keep):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return keep.empty()
        e = Entries(texts, answers, symbols, n_buckets)
        e.compare()
        return keep.table(e.rows, *merged(*e.covered()))

    return run


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches, in order."""
    if not len(row):
        return row, start, end
    wide = np.int64(end.max() + 1)
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    reach = np.maximum.accumulate(row * wide + end)
    new = np.append(True, (row * wide + start)[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
    return row[new], start[new], reach[last] - row[new] * wide


class Keep:
    """What is left of each row: (id, n symbols, spans removed, kept)."""

    SCHEMA = "id bigint, n bigint, spans array<struct<a:bigint,b:bigint>>, kept binary"
    SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def __init__(self, words: bool) -> None:
        self.words = words

    def empty(self) -> pa.Table:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), self.SPANS, pa.binary())], ["id", "n", "spans", "kept"])

    def table(self, rows: pa.RecordBatch, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
        bounds = np.searchsorted(row, np.arange(rows.num_rows + 1))
        spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["a", "b"]))
        n, kept = [], []
        starts, ends = start.tolist(), end.tolist()
        for r, text in enumerate(rows.column("text")):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            symbols = raw.split() if self.words else raw
            n.append(len(symbols))
            left, at = symbols[:0], 0
            for i in range(bounds[r], bounds[r + 1]):
                left += symbols[at : starts[i]]
                at = ends[i]
            left = left + symbols[at:] if at else symbols
            kept.append(b" ".join(left) if self.words else left)
        return pa.table([rows.column("id"), pa.array(n, pa.int64()), spans.cast(self.SPANS), pa.array(kept, pa.binary())], ["id", "n", "spans", "kept"])


def place_of(ident, text_hash, n: int):
    """The batch of a row, so that rows of one id are spread by their texts."""
    return F.pmod(F.xxhash64(ident, text_hash), F.lit(n)).cast("int")


def text_hash(text_col: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def deal(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The texts dealt into batches, and the number of batches and buckets."""
    total = float(str(docs.select(id_col, text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = int(min(2**31 - 1, max(8, total / min(LARGEST, max(BATCH, (850 * total) ** 0.5)))))
    ident = F.col(id_col).cast("long")
    return docs.select(place_of(ident, text_hash(text_col), n).alias("batch"), ident.alias("id"), F.col(text_col).alias("text")).repartition("batch"), n


def removed(docs: DataFrame, symbols: Symbols, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, spans, kept) of every row: spans of symbols covered by a window that also starts in a document with a smaller id."""
    ship(docs.sparkSession)
    texts, n = deal(docs, id_col, text_col)
    grouped = lambda: texts.groupBy("batch")

    def answers(asked: DataFrame, step: int, judge: Callable) -> DataFrame:
        return arrow_map(asked.repartition("bucket").sortWithinPartitions("bucket"), _answer(step, judge), TELL)

    def with_answers(told: DataFrame, fn: Callable, schema: str) -> DataFrame:
        return grouped().cogroup(told.groupBy("batch")).applyInArrow(fn, schema)

    told = answers(grouped().applyInArrow(_ask_anchors(symbols, n), ASK), 1, shared_anchors)
    more = answers(with_answers(told, _ask_windows(symbols, n), ASK), 2, judged(symbols))
    return with_answers(told.unionByName(more), _finish(symbols, n, Keep(symbols.tokens is not None)), Keep.SCHEMA)
