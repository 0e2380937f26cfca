"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpoint

#: edges contracted at a time
EDGES = 2_000_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that these edges link each with)."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contracted(batches):
    parts, held = [], 0

    def stars():
        nodes, roots = contract(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        own = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(roots[own]), pa.array(nodes[own])], ["a", "b"])

    for x in batches:
        parts.append((x.column("a").to_numpy(), x.column("b").to_numpy()))
        held += x.num_rows
        if held >= EDGES:
            yield stars()
            parts, held = [], 0
    if held:
        yield stars()


def _labelled(batches):
    """(v, l) of every node of edges that fit one task."""
    parts = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if parts:
        nodes, roots = contract(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["v", "l"])


def components(edges: DataFrame, node: str = "node", root: str = "root", most: int = EDGES) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that ``edges`` (a, b: long) link with another.

    Edges are contracted to stars first, ``EDGES`` of a partition at a time, so chains are short. Up to ``most`` stars are labelled in one task. More
    take rounds, each of the smallest label of a node and its neighbours, and that label's own label; a hub's rows are pre-aggregated (min) or split as
    a skewed join. The stars are kept, for a plan that reads ``edges`` twice would run their tasks twice.
    """
    stars = checkpoint(arrow_map(edges.select("a", "b"), _contracted, "a long, b long"), tidy=True)
    if stars.count() <= most:
        return arrow_map(stars.repartition(1), _labelled, "v long, l long").select(F.col("v").alias(node), F.col("l").alias(root))
    both = checkpoint(stars.union(stars.select("b", "a")).distinct(), tidy=True)
    labels = checkpoint(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("l")))
    while True:
        seen = both.join(labels.select(F.col("v").alias("b"), "l"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        near = labels.join(seen, "v").select("v", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("v").alias("l"), F.col("l").alias("ll"))
        new = checkpoint(near.join(jump, "l", "left").select("v", "old", F.coalesce("ll", "l").alias("l")), tidy=True)
        if new.where("l <> old").isEmpty():
            return labels.select(F.col("v").alias(node), F.col("l").alias(root))
        labels = new.select("v", "l")
