"""Connected components by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..plans.storage import discard, stored

#: Edges that a task contracts at once.
_EDGES = 1 << 18
#: Edges of one node that a join may bring to one task; of large graphs, one in ``_SHARE`` of all edges.
_HOT = 1 << 16
_SHARE = 1 << 12


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the least one that it reaches by these edges."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def work() -> pa.RecordBatch:
        stars = _stars(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= _EDGES:
            yield work()
    if held:
        yield work()


def _mark(links: DataFrame) -> Row:
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _parents(links: DataFrame) -> DataFrame:
    """The least smaller neighbour ``m`` of each node that has any, and the number ``n`` of them."""
    return stored(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-parents")


def _joined(links: DataFrame, key: str, parents: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``links`` with the parent ``m``, if any, of the node in ``key``.  The edges of the nodes in ``hot`` stay where they are."""
    parents = parents.select(F.col("u").alias(key), "m")
    if hot is None or hot.isEmpty():
        return links.join(parents, key, "left")
    hot = F.broadcast(hot)
    few = F.broadcast(parents.join(hot, key, "left_semi"))
    return links.join(hot, key, "left_anti").join(parents, key, "left").union(links.join(hot, key, "left_semi").join(few, key, "left"))


def connected_components(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and ``component`` (the least node it reaches) for every node of an edge.

    Each round links neighbours to the least node around them, first the larger ones, then
    the smaller ones; a graph of n nodes contracts to stars in about log(n) rounds.  The
    least smaller neighbour, a node's parent, is a pre-aggregated minimum joined back to the
    edges; parents of nodes with very many edges (4,096 nodes at most) are broadcast, so no
    task gathers the edges of such a node.  Each round is stored.  Where nodes are longs, a
    task first replaces its edges, some hundred thousand at a time, by stars, which saves
    rounds.  Null ends are ignored; a loop makes its node a component of its own.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    pairs = stored(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    alone = pairs.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    links = pairs.where("u > v")
    if pairs.dtypes[0][1] == "bigint":
        links = stored(links.mapInArrow(_contract, "u bigint, v bigint").distinct(), "cc-stars")
    mark = _mark(links)
    while mark[0]:
        most = max(_HOT, mark[0] // _SHARE)
        hot = None
        if mark[0] > most:
            hot = stored(links.groupBy("v").count().where(F.col("count") > most).select("v"), "cc-hot")
        parents = _parents(links)
        large = stored(_joined(links, "v", parents, hot).select("u", F.coalesce("m", "v").alias("v")).distinct(), "cc-large")
        same = _mark(large) == mark and parents.count() == mark[0]
        discard(parents, *[x for x in [hot] if x is not None])
        if same:  # every node has one parent, which has none
            discard(large)
            break
        parents = _parents(large)
        crowded = parents.where("n > 1")
        hot = crowded.where(F.col("n") > most).select("u") if mark[0] > most else None
        small = _joined(large, "u", crowded, hot).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, links = links, stored(small.union(parents.select("u", "m")).distinct(), "cc-small")
        discard(large, parents, last)
        mark = _mark(links)
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    known = found.union(roots)
    return known.union(alone.join(known, "node", "left_anti"))
