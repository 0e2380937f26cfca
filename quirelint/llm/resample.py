"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (single words and punctuation runs, the first ``STEM`` bytes of longer words, pairs of
neighbouring words, and a bucket each for runs of four and of eight equal tokens) give the chance that a document holds a bucket: the raw
one from all documents, the target one from labelled documents that are good and not toxic. A bucket's log ratio is
smoothed by one document and shrunk by what speaks for it, so none is cut off at a bar and small tables count too: the
evidence is the log likelihood by which the target's count differs from the raw rate, plus that by which the labelled
good ones differ from the other labelled ones, less if the two disagree; a ratio counts in full as evidence grows beyond ``EVIDENCE``.
A document's log weight is the sum over its buckets divided by the root of their number (the spread of a sum of chance
differences), in units of a document of ``TYPICAL`` buckets. Its own row is left out of all counts that weigh it, or
labelled documents would weigh more than others. Documents are sampled without replacement by Gumbel top-k: the k greatest of
log weight * ``SHARPNESS`` + noise, the noise a function of id and text. k is the number of documents whose
log weight passes the cut that parts the labelled ones best, a good one lost weighing as much as ``KEEP`` others kept
(in shares); the cut is 0 at most, so that texts of which nothing is known pass.

At most ``LABELS`` labelled documents are used (those of smallest hash, spread over the corpus);
counts, weights and the sample cover all documents. Null texts count as empty and weigh 0;
repeated rows get equal keys, and ties at the k-th key all stay; rows with a null id have no label; other columns are not read.
Without labels nothing is known against any document, and all stay; an empty table gives an empty one; very long texts
are hashed in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PUNCT, arrow_map, as_long, checkpoint, mix, slices, table, type_of, windows

ONES, TWOS, STEMS, STEM, LABELS, EVIDENCE, TYPICAL, KEEP, SHARPNESS, RUNS = 1 << 18, 1 << 17, 1 << 17, 7, 20_000, 8.5, 256, 3, 10.0, (4, 8)
BUCKETS = ONES + TWOS + STEMS + len(RUNS)


def buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram."""
    starts, ends, first = WORD_PUNCT.cut(data, offs)
    hashes = WORD_PUNCT.hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    at, pairs = windows(hashes, first, 2)
    equal = hashes[at] == hashes[at + 1]
    n = len(hashes)
    same = np.zeros(n, bool)
    same[at[equal]] = True
    count = np.append(0, np.cumsum(same))
    runs = [np.flatnonzero(count[r - 1 :] - count[: n - r + 2] == r - 1) if n >= r else np.zeros(0, np.int64) for r in RUNS]
    word = WORD_PUNCT.classes[data[starts]] == 1
    two = word[at] & word[at + 1] & ~equal
    long = np.flatnonzero(ends - starts > STEM)
    stems = mix(WORD_PUNCT.hashes(data, starts[long], starts[long] + STEM))
    rows = np.concatenate([row, row[at[two]], row[long], *(row[r] for r in runs)])
    found = (mix(hashes) % np.uint64(ONES)).astype(np.int64), (pairs[two] % np.uint64(TWOS)).astype(np.int64) + ONES, (stems % np.uint64(STEMS)).astype(np.int64) + ONES + TWOS
    return rows, np.concatenate([*found, *(np.full(len(r), BUCKETS - len(RUNS) + k) for k, r in enumerate(runs))])


def _present(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket once a row."""
    key = np.sort(rows * BUCKETS + found)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key // BUCKETS, key % BUCKETS


def groups(ids: pa.Array, known: np.ndarray, good: np.ndarray) -> np.ndarray:
    """0: not labelled, 1: good, 2: another labelled document."""
    if not len(known):
        return np.zeros(len(ids), np.int64)
    ids, null = ids.cast(pa.int64()).fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
    place = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return np.where((known[place] == ids) & ~null, np.where(good[place], 1, 2), 0)


def _counter(labelled, id_col: str):
    def run(batches):
        counts, sizes = np.zeros((3, BUCKETS), np.int64), np.zeros(3, np.int64)
        for batch in batches:
            for part, data, offs in slices(batch, "text"):
                group = groups(part.column(id_col), *labelled.value)
                rows, found = _present(*buckets(data, offs))
                for g in range(3):
                    counts[g] += np.bincount(found[group[rows] == g], minlength=BUCKETS)
                sizes += np.bincount(group, minlength=3)
        at = np.flatnonzero(counts.any(axis=0))
        raw, target, other = (np.append(c[at], n) for c, n in zip((counts.sum(axis=0), counts[1], counts[2]), (sizes.sum(), sizes[1], sizes[2]), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.append(at, -1), raw, target, other)], ["bucket", "raw", "target", "other"])

    return run


def log_ratios(raw: np.ndarray, target: np.ndarray, other: np.ndarray, n_raw: int, n_target: int, n_other: int) -> np.ndarray:
    """Smoothed log ratios of target to raw chances, shrunk by the evidence for them."""
    expected = raw * (n_target / max(1, n_raw))
    evidence = expected - target + target * np.log(np.maximum(target, 1) / np.maximum(expected, 1e-9))
    told, share = target + other, n_target / max(1, n_target + n_other)
    due, due_other = told * share, told * (1 - share)
    by_label = target * np.log(np.maximum(target, 1) / np.maximum(due, 1e-9)) + other * np.log(np.maximum(other, 1) / np.maximum(due_other, 1e-9))
    agree = np.sign(due - target) == np.sign(expected - target)
    evidence = np.where(expected > 0, np.maximum(evidence + np.where(agree, by_label, -by_label), 0), 0)
    return np.log((target + 1) / (expected + 1)) * (evidence / (evidence + EVIDENCE)) ** 3


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LABELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log ratio of each bucket for each of ``groups``, the weighed row left out; known ids and whether they are good."""
    sc = docs.sparkSession.sparkContext
    known = np.array(sorted((r[0], r[1]) for r in sampled(labels, id_col, limit).collect()), np.int64).reshape(-1, 2)
    told = (np.ascontiguousarray(known[:, 0]), known[:, 1].astype(bool))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = arrow_map(rows, _counter(sc.broadcast(told), "id"), "bucket long, raw long, target long, other long").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "target", "other")))
    counts = np.zeros((3, BUCKETS + 1))
    found = counted.toArrow()  # BUCKETS + 1 rows at most, as arrays: objects would take ten times as much
    at = found.column("bucket").to_numpy()
    for row, name in zip(counts, ("raw", "target", "other"), strict=True):
        row[at] = found.column(name).to_numpy()  # the sizes come last, as bucket -1
    counts, sizes = counts[:, :-1], tuple(counts[:, -1].astype(np.int64).tolist())
    if not sizes[1]:
        return np.zeros((3, BUCKETS)), *told
    out = []
    for g in range(3):
        own = np.array([1, g == 1, g == 2], float)
        out.append(log_ratios(*np.maximum(counts - own[:, None], 0), *np.maximum(np.array(sizes) - own, 0)))
    return np.array(out), *told


def sampled(labels: DataFrame, id_col: str = "doc_id", limit: int = LABELS) -> DataFrame:
    """(id, good 0/1) of at most ``limit`` labelled documents; an id with several labels is good if all of them are."""
    good = F.coalesce(F.col("quality") == 1, F.lit(False)) & F.coalesce(F.col("toxic") == 0, F.lit(False))
    one = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(good.cast("int")).alias("good"))
    return one.orderBy(F.xxhash64(id_col), id_col).limit(limit)


def weights(data: np.ndarray, offs: np.ndarray, group: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    rows, found = _present(*buckets(data, offs))
    total = np.bincount(rows, ratios[group[rows], found], minlength=len(offs) - 1).astype(float)
    return total * np.sqrt(TYPICAL / np.maximum(np.bincount(rows, minlength=len(offs) - 1), 1))


def _weigher(model, id_col: str):
    def run(batches):
        ratios, *told = model.value
        for batch in batches:
            for part, data, offs in slices(batch, "text"):
                weight = weights(data, offs, groups(part.column(id_col), *told), ratios)
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("h"), pa.array(weight)], [id_col, "h", "log_weight"])

    return run


def weigh(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, log_weight); h: a hash of the text."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(rows, _weigher(shared, id_col), f"{id_col} {type_of(docs, id_col)}, h long, log_weight double")


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The log weight from which on documents count as good."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    kept = 1 - np.append(0, np.cumsum(g)) / g.sum()
    gone = np.append(0, np.cumsum(~g)) / (~g).sum()
    at = np.flatnonzero(np.append(True, np.append(w[1:] != w[:-1], True)))
    best = at[np.argmax((KEEP * kept + gone)[at])]
    if best == 0:
        return -np.inf
    return float((w[best - 1] + w[best]) / 2) if best < len(w) else np.inf


def kth_greatest(keyed: DataFrame, k: int) -> int | None:
    """The k-th greatest ``key`` (long), by counting 16 bits at a time; None if there are fewer than k."""
    part = F.lit(True)
    prefix = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("key", shift)
        counts = sorted(((r[0], r[1]) for r in keyed.where(part).groupBy(digit.alias("d")).count().collect()), reverse=True)  # 65536 rows at most
        for d, n in counts:
            if n >= k:
                prefix = d
                break
            k -= n
        else:
            return None
        part = digit == F.lit(prefix).cast("long")
    return prefix


def keys(weight: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Longs in the order of weight * SHARPNESS plus Gumbel noise drawn by ``seed``."""
    u = ((mix(seed.view(np.uint64)) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)
    bits = (weight * SHARPNESS - np.log(-np.log(u)) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def _keyer(id_col: str):
    def run(batches):
        for batch in batches:
            order = keys(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("log_weight", "seed")))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("h"), batch.column("log_weight"), as_long(order)], [id_col, "h", "log_weight", "key"])

    return run


def seeds(id_col: str, h, seed: int):
    return F.xxhash64(F.lit(seed), F.col(id_col), h)


def resample(weighed: DataFrame, k: int, id_col: str = "doc_id", seed: int = 0) -> tuple[DataFrame, int | None]:
    """Adds key (long) and kept: whether it is among the k greatest; and the least key that is, None for all."""
    seeded = weighed.select(id_col, "h", "log_weight", seeds(id_col, F.col("h"), seed).alias("seed"))
    keyed = arrow_map(seeded, _keyer(id_col), f"{id_col} {type_of(weighed, id_col)}, h long, log_weight double, key long")
    least = (kth_greatest(keyed, k) if k > 0 else 2**63 - 1)
    return keyed.withColumn("kept", F.lit(True) if least is None else F.col("key") >= F.lit(least).cast("long")), least


def _classified(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray], int | None]:
    model = fit(docs, labels)
    weighed = checkpoint(weigh(docs, model))
    # LABELS rows at most, but for repeated ids
    told = weighed.join(F.broadcast(sampled(labels)), "doc_id").select("log_weight", "good").toPandas()
    cut = min(0.0, best_cut(told["log_weight"].to_numpy(float), told["good"].to_numpy(bool)))
    kept, least = resample(weighed, weighed.where(F.col("log_weight") >= F.lit(cut)).count())
    return kept, model, least


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, h, log_weight, key, kept) of every document."""
    return _classified(docs, labels)[0]


def _selector(model, least: int, place: int):
    def run(batches):
        ratios, *told = model.value
        for batch in batches:
            for part, data, offs in slices(batch, "text"):
                inner = part.column("row")
                ids = pc.struct_field(inner, [place])
                order = keys(weights(data, offs, groups(ids, *told), ratios), part.column("seed").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([inner.filter(pa.array(order >= least))], ["row"])

    return run


def keep_best(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that ``classify`` keeps, all columns, whatever their names; weighed once more in the scan rather than joined."""
    _, model, least = _classified(docs, labels)
    if least is None:
        return docs
    seed = seeds("doc_id", F.xxhash64(F.coalesce(text_col, F.lit(""))), 0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"), seed.alias("seed"))
    kept = arrow_map(rows, _selector(shared, least, docs.columns.index("doc_id")), rows.select("row").schema)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "key", "kept")
