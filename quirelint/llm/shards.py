"""Sharding by Karmarkar-Karp differencing, for byte balance of indivisible groups.

Equal texts form a group that no shard boundary may split. Groups of over a 1024th of all bytes
(at most 1023 of them) go to the last step as they are. The others are dealt by hash into buckets
of about ``PER_BUCKET`` groups; in each, differencing packs them into bundles of nearly equal
size. While there are more than ``MAX_BUNDLES`` bundles, these are dealt into buckets and packed again, so
the driver gets ``MAX_BUNDLES`` sums at most, whatever the input. Differencing over the bundles and the heavy
groups then gives the shards, so that many small bundles can offset one heavy group. Only bundle
sums and heavy groups reach the driver.

Null texts count as empty and share a group with empty ones; repeated rows are rows of their own,
in the same shard; equal sizes are told apart by the groups' hashes, so a rerun gives the same shards; other columns are not
read; an empty table gives an empty one; very long texts are only measured and hashed. Rows with a null id come after the others.
"""

from __future__ import annotations

import heapq
import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, group_key, ship, table

SHARDS, PER_BUCKET, MAX_BUNDLES, HEAVY = 16, 20_000, 65_536, 1024


def differencing(sizes: list[int], k: int) -> list[int]:
    """A part 0..k-1 for each size, by the largest differencing method for k parts.

    A partial partition is k sums, largest first, each less the smallest; parts are trees of items.
    The two of largest spread are joined, largest sum with smallest, until one is left.
    """
    if not sizes:
        return []
    order = itertools.count()
    children: list[tuple[int, int]] = []  # of inner nodes, which are numbered after the items
    n = len(sizes)
    heap = [(-s, next(order), [s] + [0] * (k - 1), [i] + [-1] * (k - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heap[0]
        joined = []
        for x, p, y, q in zip(a, left, reversed(b), reversed(right), strict=True):
            if p < 0 or q < 0:
                node = max(p, q)
            else:
                children.append((p, q))
                node = n + len(children) - 1
            joined.append((x + y, node))
        joined.sort(reverse=True)
        low = joined[-1][0]
        heapq.heapreplace(heap, (low - joined[0][0], next(order), [s - low for s, _ in joined], [node for _, node in joined]))
    part = [0] * n
    for p, root in enumerate(heap[0][3]):
        todo = [root] if root >= 0 else []
        while todo:
            node = todo.pop()
            if node < n:
                part[node] = p
            else:
                todo += children[node - n]
    return part


def _packer(bundles: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["w", "k1", "k2"], ascending=False, kind="stable")
        return group.assign(bundle=differencing(group["w"].tolist(), bundles))

    return pack


def packed(groups: DataFrame, count: int, per_bucket: int, most: int) -> tuple[DataFrame, int]:
    """``groups`` (k1, k2, w) with the bucket and bundle of each, and the number of buckets."""
    n_buckets = max(1, -(-count // per_bucket))
    bundles = max(2, min(most // n_buckets, 64))
    dealt = groups.select("k1", "k2", "w", F.pmod("k1", F.lit(n_buckets)).cast("long").alias("bucket"))
    out = dealt.groupBy("bucket").applyInPandas(_packer(bundles), "k1 long, k2 long, w long, bucket long, bundle int")
    return checkpoint(out), n_buckets


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = PER_BUCKET, most: int = MAX_BUNDLES) -> DataFrame:
    """(id, size, text_crc32, shard, slot)."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *group_key(F.col(text_col)))
    groups = checkpoint(rows.groupBy("k1", "k2").agg(F.sum("size").alias("w")))
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    is_heavy = F.col("w") * HEAVY > total
    heavy = sorted(((r.w, r.k1, r.k2) for r in groups.where(is_heavy).collect()), reverse=True)
    levels = [packed(groups.where(~is_heavy), count, per_bucket, most)]
    while 2 * levels[-1][1] > most:
        # bundles are the groups of the next level
        sums = levels[-1][0].groupBy(F.col("bucket").alias("k1"), F.col("bundle").cast("long").alias("k2")).agg(F.sum("w").alias("w"))
        levels.append(packed(sums, 2 * levels[-1][1], per_bucket, most))
    top = levels[-1][0]
    sums = sorted((r.bucket, r.bundle, r.w) for r in top.groupBy("bucket", "bundle").agg(F.sum("w").alias("w")).collect())  # ``most`` rows at most
    parts = differencing([w for w, *_ in heavy] + [w for *_, w in sums], shards)
    of_heavy = spark.createDataFrame([(k1, k2, p) for (_, k1, k2), p in zip(heavy, parts, strict=False)], "k1 long, k2 long, shard int")
    shard = spark.createDataFrame([(b, c, p) for (b, c, _), p in zip(sums, parts[len(heavy) :], strict=True)], "bucket long, bundle int, shard int")
    for level, _ in reversed(levels):
        below = level.join(shard, ["bucket", "bundle"])
        shard = below.select(F.col("k1").alias("bucket"), F.col("k2").cast("int").alias("bundle"), "shard") if level is not levels[0][0] else below.select("k1", "k2", "shard")
    return number(rows.join(shard.unionByName(of_heavy), ["k1", "k2"]), id_col, count)


def number(placed: DataFrame, id_col: str, about: int) -> DataFrame:
    """Adds slot, gapless in each shard: rows are counted in small parts, then the parts' sizes are summed up."""
    n_parts = max(16, about // 5_000)
    placed = placed.withColumn("part", F.pmod(F.xxhash64(id_col, "text_crc32", "size"), F.lit(n_parts)))
    placed = checkpoint(placed.select(id_col, "size", "text_crc32", "shard", "part"))
    sizes = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    local = F.row_number().over(W.partitionBy("shard", "part").orderBy(F.col(id_col).asc_nulls_last(), "size", "text_crc32")) - 1
    return placed.withColumn("local", local).join(offsets, ["shard", "part"]).select(id_col, "size", "text_crc32", "shard", (F.col("offset") + F.col("local")).cast("long").alias("slot"))


def op10_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
