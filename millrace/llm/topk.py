"""Exact top-k by integer inner product, with block-at-a-time pruning.

A component is a term and its quantised value ``floor(scale * x)`` the term's weight.
Candidates are dealt in id order into document-range blocks.  A block is one row: its ids,
its forward index (the matrix of its vectors) and each term's maximum and minimum.  For a
query a block's bound is the sum over terms of the larger of weight times maximum and
weight times minimum.  Blocks are visited in order of falling bounds; visiting stops once
a block's bound falls below the k-th score so far, so nothing that could enter is missed.

Queries are a stated set of rows, met with the candidates in blocks: blocks are dealt into
groups and queries into shares, both of bounded size.  First the shares meet the terms'
maxima and minima alone, two rows for each block: every query is scored against the block
of its highest bound of all, whose k-th score is its floor from then on.  Then a group and
a share meet, in a task of their own, if some query's floor is not above the bound of some
block of the group, and find the k best of each query.  A query's partial lists (k for each
group) are cut to k before they are merged.  Neither side is ever broadcast.

Defined edge cases: vectors that are null or hold a null or non-finite component take no
part; a query is scored against vectors of its own length only; identical rows count once
and rows that share an id with the query are not its candidates; ties go to the smaller
id; null ids take no part; fewer candidates than k give fewer rows; components whose scores
could leave 64 bits raise an error; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 20
SCALE = 64
BLOCK_ROWS = 256
#: Candidate blocks of a group, queries of a chunk, and chunks of a share of the queries.
GROUP_BLOCKS = 16
CHUNK = 512
SHARE_CHUNKS = 8


#: Groups whose maxima and minima come together.
BOUND_GROUPS = 64
_LEAST = np.iinfo(np.int64).min


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group, dim, block, ids, values, floors in zip(*(c.to_pylist() for c in batch.columns)):
            order = np.lexsort((np.arange(len(ids)), np.asarray(ids)))
            matrix = np.array(values, np.int64).reshape(len(ids), dim)[order]
            keep = np.asarray(ids, np.int64)[order]
            floor = np.asarray(floors, np.int64)[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array([group], pa.int64()), pa.array([dim], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x.tobytes()]) for x in (keep, matrix, floor))],
                names=["grp", "dim", "block", "ids", "matrix", "floors"],
            )


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each term's maximum and minimum in each block."""
    for batch in batches:
        high, low = [], []
        for dim, matrix in zip(batch.column(1).to_pylist(), batch.column(4)):
            values = np.frombuffer(matrix.as_buffer(), np.int64).reshape(-1, dim)
            high.append(values.max(0).tobytes())
            low.append(values.min(0).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(high, pa.binary()), pa.array(low, pa.binary())], names=["grp", "dim", "block", "high", "low"])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` exactly: in doubles while every partial sum is an integer below 2**53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top >= 2.0**62:
        raise OverflowError("components are too large for scores of 64 bits")
    return a @ b.T


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block, what no inner product with a row of the block is above."""
    return _exact(np.maximum(queries, 0), high) + _exact(np.minimum(queries, 0), low)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first of a row's candidates by (score falling, id)."""
    if len(ids) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= kth
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_chunk(
    queries: np.ndarray, query_ids: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, floors: np.ndarray | None = None
) -> tuple[list, int]:
    """The k best of each query over ``blocks`` (ids, matrix), and how many (query, block) pairs were scored.

    Scores below a query's floor are not asked for.
    """
    high = np.stack([m.max(0) for _, m in blocks])
    low = np.stack([m.min(0) for _, m in blocks])
    bounds = _bounds(queries, high, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    have: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
    kth = np.full(len(queries), _LEAST) if floors is None else floors.copy()
    alive, scored = np.arange(len(queries)), 0
    for nth in range(len(blocks)):
        block = order[alive, nth]
        alive = alive[bounds[alive, block] >= kth[alive]]  # bounds fall, so a query that stops is done
        block = order[alive, nth]
        for b in np.unique(block).tolist():
            ask = alive[block == b]
            ids, matrix = blocks[b]
            scores = _exact(queries[ask], matrix)
            scored += len(ask)
            for i, row in zip(ask.tolist(), scores):
                can = (ids != query_ids[i]) & (row >= kth[i])
                s, d = np.concatenate([have[i][0], row[can]]), np.concatenate([have[i][1], ids[can]])
                have[i] = _best(s, d, k)
                if len(have[i][0]) == k:
                    kth[i] = max(kth[i], have[i][0][-1])
    return have, scored


def _unpacked(table: pa.Table, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for ids, matrix, floors in zip(table.column("ids"), table.column("matrix"), table.column("floors")):
        yield np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(matrix.as_buffer(), np.int64).reshape(-1, dim), np.frombuffer(floors.as_buffer(), np.int64)


def _best_block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The block of each query's highest bound; queries go by their numbers."""
    dim, out = key[1].as_py(), []
    if left.num_rows:
        high, low = (np.frombuffer(left.column(c).combine_chunks().buffers()[2], np.int64)[: left.num_rows * dim].reshape(-1, dim) for c in ("high", "low"))
        block = left.column("block").to_numpy()
        for numbers, queries, _ in _unpacked(right, dim):
            bounds = _bounds(queries, high, low)
            best = bounds.argmax(axis=1)
            out.append((numbers, block[best], bounds[np.arange(len(best)), best]))
    columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
    return pa.table(dict(zip(("n", "block", "bound"), columns)))


def _floor(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The k-th score of each query in its best block, if that has so many candidates."""
        dim, n, floors = key[1].as_py(), [], []
        for ids, matrix, _ in _unpacked(left, dim):
            values = right.column("v").combine_chunks().values.to_numpy().reshape(-1, dim)
            scores = _exact(values, matrix)
            for number, query, row in zip(right.column("n").to_pylist(), right.column("vec_id").to_pylist(), scores):
                row = row[ids != query]
                if len(row) >= k:
                    n.append(number)
                    floors.append(int(np.partition(row, len(row) - k)[len(row) - k]))
        return pa.table({"n": pa.array(n, pa.int64()), "floor": pa.array(floors, pa.int64())})

    return run


def _meetings(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Groups of which some block's bound reaches some query's floor."""
    dim = key[1].as_py()
    alive = np.zeros(left.num_rows, bool)
    if left.num_rows:
        high, low = (np.frombuffer(left.column(c).combine_chunks().buffers()[2], np.int64)[: left.num_rows * dim].reshape(-1, dim) for c in ("high", "low"))
        for _, queries, floors in _unpacked(right, dim):
            alive |= (_bounds(queries, high, low) >= floors[:, None]).any(axis=0)
    groups = np.unique(left.column("grp").to_numpy()[alive])
    return pa.table({"grp": groups, "dim": pa.array([dim] * len(groups), pa.int32()), "share": pa.array([key[2].as_py()] * len(groups), pa.int64())})


def _search(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim, out = key[1].as_py(), []
        blocks = [(ids, matrix) for ids, matrix, _ in _unpacked(left, dim)]
        for query_ids, queries, floors in _unpacked(right, dim) if blocks else ():
            have, _ = search_chunk(queries, query_ids, blocks, k, floors)
            sizes = [len(s) for s, _ in have]
            out.append((np.repeat(query_ids, sizes), np.concatenate([d for _, d in have]), np.concatenate([s for s, _ in have])))
        columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def quantised(vectors: DataFrame, *, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Distinct rows (vec_id, dim, v) with whole-number components; unusable vectors are left out."""
    value = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), value.alias("x")).where("vec_id is not null and x is not null")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(~bad).select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))
    return rows.where("dim > 0").distinct()


def _blocks(rows: DataFrame, group_rows: int, block_rows: int, name: str = "vec_id") -> DataFrame:
    """Packed blocks (grp, dim, block, ids, matrix, floors) of at most ``block_rows`` rows each, in order of their number ``n``."""
    n, floor = F.col("n"), F.col("floor") if "floor" in rows.columns else F.lit(_LEAST)
    rows = rows.select(F.floor(n / group_rows).alias("grp"), "dim", F.floor(n / block_rows).alias("block"), F.col(name).alias("vec_id"), "v", floor.alias("floor"))
    packed = rows.groupBy("grp", "dim", "block").agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("rows"))
    packed = packed.select("grp", "dim", "block", F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("values"), F.col("rows.floor").alias("floors"))
    return packed.mapInArrow(_pack, "grp long, dim int, block long, ids binary, matrix binary, floors binary")


def _numbered(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``n``, their place in order of (dim, vec_id), without bringing them together."""
    ordered = rows.repartitionByRange("dim", "vec_id").sortWithinPartitions("dim", "vec_id")
    # a partition's number is the high part of this id, its rows' order the low part
    ordered = common.stored(ordered.withColumn("m", F.monotonically_increasing_id()), label)
    part = F.shiftright("m", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    rows = ordered.withColumn("part", part).join(counts, "part")
    return rows.select("vec_id", "dim", "v", (F.col("first") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("n"))


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    *,
    k: int = K,
    block_rows: int = BLOCK_ROWS,
    group_blocks: int = GROUP_BLOCKS,
    chunk: int = CHUNK,
    share_chunks: int = SHARE_CHUNKS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score; both inputs are of the form that ``quantised`` returns."""
    with common.tracked() as paths:
        placed, asked = _numbered(candidates, "candidates-sorted"), _numbered(queries, "queries-sorted")
    placed, asked = common.stored(placed, "candidates"), common.stored(asked, "queries")
    for path in paths:
        common.delete(candidates.sparkSession, path)
    groups = -(-placed.count() // (block_rows * group_blocks))
    shares = -(-asked.count() // (chunk * share_chunks))
    if not groups or not shares:
        return placed.select(*[F.lit(None).cast(t).alias(c) for c, t in (("query_id", "long"), ("rank", "int"), ("vec_id", "long"), ("score", "long"))]).limit(0)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    sized = block_rows * group_blocks, block_rows
    shared = chunk * share_chunks, chunk
    blocks = common.stored(_blocks(placed, *sized), "candidate-blocks")
    extremes = blocks.mapInArrow(_extremes, "grp long, dim int, block long, high binary, low binary")
    extremes = common.stored(extremes.withColumn("bounds", F.expr(f"grp div {BOUND_GROUPS}")), "block-extremes")
    many = -(-groups // BOUND_GROUPS)
    meet = ["bounds", "dim", "share"]

    def with_extremes(packed: DataFrame, f, schema: str) -> DataFrame:
        """Every share of the queries with all blocks' maxima and minima."""
        sides = extremes.withColumn("share", every(shares)), packed.withColumnRenamed("grp", "share").withColumn("bounds", every(many))
        return sides[0].groupBy(*meet).cogroup(sides[1].groupBy(*meet)).applyInArrow(f, schema)

    best = with_extremes(_blocks(asked, *shared, "n"), _best_block, "n long, block long, bound long")
    best = best.groupBy("n").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    best = common.stored(best.withColumn("share", F.floor(F.col("n") / shared[0])), "best-blocks")
    place = ["block", "dim", "share"]
    # the two sides of a meeting must not share a column of one frame
    left = blocks.join(best.select(F.expr("block + 0").alias("block"), F.expr("share + 0").alias("share")).distinct(), "block")
    right = asked.join(best, "n")
    floors = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(_floor(k), "n long, floor long")
    asked = asked.join(floors, "n", "left").withColumn("floor", F.coalesce("floor", F.lit(_LEAST)))
    queries = common.stored(_blocks(asked, *shared), "query-blocks")
    alive = common.stored(with_extremes(queries, _meetings, "grp long, dim int, share long").distinct(), "meetings")
    key = ["grp", "dim", "share"]
    left = blocks.join(alive.select(F.expr("grp + 0").alias("grp"), "dim", F.expr("share + 0").alias("share")), ["grp", "dim"])
    right = queries.withColumnRenamed("grp", "share").join(alive, ["share", "dim"])
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every row of ``embeddings`` whose vec_id is divisible by 20, among all other rows."""
    rows = quantised(common.table(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("vec_id") % 20 == 0), rows)


OP10_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
