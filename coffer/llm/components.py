"""Connected components of a graph of links, without the links ever meeting in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import join_unique, keep


class Forest:
    """Disjoint sets of integers; the root of a set is its smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


#: Links that one task may get: what it holds of them takes some 60 bytes each.
ONE = 1 << 22


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links u - v in order, and the smallest that each reaches."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = np.arange(len(nodes))
    a, b = place[: len(u)], place[len(u) :]
    while True:
        a, b = up[a], up[b]
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        if not len(a):
            return nodes, nodes[up]
        np.minimum.at(up, b, a)
        while True:  # until every node points to a root
            above = up[up]
            if (above == up).all():
                break
            up = above


def _contract(batches):
    """The links of a partition as stars: at most one link for each node that it has. What exceeds
    ONE links is let go, as stars of parts are as good as stars of the whole."""
    waiting, n = [], 0

    def stars():
        u, v = smallest(*(np.concatenate(x) for x in zip(*waiting)))
        return pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    for b in batches:
        waiting.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += len(b)
        if n > ONE:
            yield stars()
            waiting, n = [], 0
    if n:
        yield stars()


def _nodes(batches):
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        node, least = smallest(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["node", "component"])


def _star(links: DataFrame, both: bool) -> DataFrame:
    """Large-star (both) or small-star: every node's larger (smaller) neighbours and itself are
    hung below the smallest of its neighbours and itself."""
    if both:
        seen = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
    total = max(least.agg(F.sum("n")).first()[0] or 0, 1)
    joined = join_unique(seen, least, "u", "n", total, "inner")
    if both:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.where("u <> m").select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches, for links (u, v) of
    longs; nodes without a link have no row. Every partition replaces its links by stars. Up to
    ONE links are then joined in one task; more than that alternate large-star and small-star
    rounds until nothing changes, each round read from the shared folder."""
    links = keep(links.where("u <> v").select("u", "v").mapInArrow(_contract, "u long, v long"), "links")
    if links.count() <= ONE:
        return links.coalesce(1).mapInArrow(_nodes, "node long, component long")
    before = None
    while True:
        large = keep(_star(links, True), "large")
        links = keep(_star(large, False), "small")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    out = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
