"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's documents are put in a fixed pseudo-random order and dealt into blocks of
``block_docs``.  One slot holds one block.  A source with ``a`` shares of ``D`` owns ``a``
slots in every cycle of ``D``; its k-th block of a cycle is released at ``floor((k-1)D/a)``
and due at ``ceil(kD/a)``.  In each slot the released block with the earliest deadline
goes (ties: by source).  With the shares adding up to ``D`` every deadline is met, so at
any slot a source has had its share of slots to within less than one block.  The cycle
repeats, so its pattern is computed once, on the driver, for at most ``D`` shares; where a
block goes is then arithmetic on its number, whatever the number of documents.

The mix ends when every source has been gone through at least once; a source that has run
out before then starts anew (``epoch``).  So no document is left out, and shares hold over
the whole mix.  ``copies`` counts the epochs of a row.

A document's place within its source is its rank by (md5 of the id, id).  The rank is a
count of the rows in lower buckets of that digest plus the rank inside the bucket, so no
task ever holds one source.

Target weights are given, or by default the document counts to the power ``alpha``;
either way they are rounded to whole shares of ``D`` (largest remainder, at least one
share each).

Defined edge cases: a null source is a source of its own; rows with null, empty or very long
text are mixed like others; rows with equal ids take adjacent places, those without an id
places by a hash of their content; a source without a weight in
a given table of weights raises an error, a weight without rows is ignored; an empty table
mixes to nothing; extra columns are kept by ``mix`` unless their names clash with its own,
which replace them.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Slots of a cycle.
CYCLE = 1000
BLOCK_DOCS = 8
ALPHA = 0.7
#: Rows of a source that share a bucket of the digest, at most about; a bucket is named by its first hexadecimal digits, three at least.
BUCKET_ROWS = 100_000

OWN = ("mix_epoch", "mix_block", "mix_slot", "mix_place")


def shares(weights: dict[str | None, float], cycle: int = CYCLE) -> dict[str | None, int]:
    """Whole shares that add up to the cycle, by largest remainder."""
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    if any(weights[s] <= 0 for s in names):
        raise ValueError("weights must be positive")
    total = sum(weights.values())
    exact = {s: weights[s] * cycle / total for s in names}
    out = {s: max(1, int(exact[s])) for s in names}
    while (over := sum(out.values()) - cycle) != 0:
        step = -1 if over > 0 else 1
        able = [s for s in names if step > 0 or out[s] > 1]
        if not able:
            raise ValueError(f"{len(names)} sources do not fit a cycle of {cycle}")
        best = max(able, key=lambda s: step * (exact[s] - out[s]))
        out[best] += step
    return out


def pattern(share: dict[str | None, int]) -> dict[str | None, list[int]]:
    """The slots of each source in one cycle: earliest deadline first among released blocks."""
    cycle = sum(share.values())
    names = sorted(share, key=lambda s: (s is None, s or ""))
    waiting = [(0, i, 1) for i in range(len(names))]  # (release, source, number)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, number)
    out: dict[str | None, list[int]] = {s: [] for s in names}
    for slot in range(cycle):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-k * cycle // share[names[i]]), i, k))
        _, i, k = heapq.heappop(ready)
        out[names[i]].append(slot)
        if k < share[names[i]]:
            heapq.heappush(waiting, (k * cycle // share[names[i]], i, k + 1))
    return out


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    *,
    alpha: float = ALPHA,
    block_docs: int = BLOCK_DOCS,
    cycle: int = CYCLE,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with mix_epoch, mix_block, mix_slot and mix_place (the order of the mix); a row for each epoch it is in."""
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OWN])
    counted = docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.count("*").alias("n")).limit(cycle + 1).collect()
    counts = {r["s"]: r["n"] for r in counted}
    if len(counts) > cycle:
        raise ValueError(f"more sources than slots in a cycle of {cycle}")
    if not counts:
        empty = docs.limit(0)
        for name in OWN:
            empty = empty.withColumn(name, F.lit(None).cast("long"))
        return empty
    if weights is None:
        weights = {s: n**alpha for s, n in counts.items()}
    if missing := [s for s in counts if s not in weights]:
        raise ValueError(f"no weight for sources {missing[:5]}")
    share = shares({s: weights[s] for s in counts}, cycle)
    slots = pattern(share)
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    # slots until the source that needs longest has been gone through once
    horizon = max((blocks[s] - 1) // share[s] * cycle + slots[s][(blocks[s] - 1) % share[s]] + 1 for s in counts)
    plan = []
    for s in counts:
        turns = horizon // cycle * share[s] + sum(1 for x in slots[s] if x < horizon % cycle)
        plan.append({"s": s, "share": share[s], "slots": slots[s], "blocks": blocks[s], "turns": turns})
    text = json.dumps(plan)
    kind = "array<struct<s:string,share:long,slots:array<long>,blocks:long,turns:long>>"
    # at most ``cycle`` slots altogether, whatever the corpus
    planned = spark.range(1).select(F.explode(F.from_json(F.lit(text), kind)).alias("_p"))
    planned = planned.select(F.coalesce(F.concat(F.lit("s"), F.col("_p.s")), F.lit("n")).alias("_t"), F.struct("_p.share", "_p.slots", "_p.blocks", "_p.turns").alias("_plan"))

    # rows without an id go by their content, so that they do not meet in one bucket
    plain = [c for c, kind in docs.dtypes if not kind.startswith(("map", "array", "struct", "variant"))]
    unnamed = F.concat(F.lit("null"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).cast("string"))
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), unnamed).cast("binary"))
    digits = max(3, len(f"{max(counts.values()) // BUCKET_ROWS:x}"))
    # a row's own columns travel in one, so that no name of theirs meets one of the plan's
    # a source's name with a letter before it, so that null is a key like others and one shuffle serves the ranks and the join
    named = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    rows = docs.select(F.struct("*").alias("_doc"), named(F.col(source_col).cast("string")).alias("_source"), digest.alias("_digest"), F.col(id_col).alias("_id"))
    rows = rows.withColumn("_bucket", F.substring("_digest", 1, digits))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_digest", "_id")
    buckets = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    below = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_first")
    )
    buckets = buckets.join(F.broadcast(planned), F.col("_s") == F.col("_t"))
    buckets = buckets.select("_s", "_b", "_first", "_plan")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(buckets, (F.col("_source") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_first")).withColumn("_block", F.expr(f"_rank div {block_docs}"))
    # block number b of the source is its turn b, b + blocks, b + 2 blocks, ... while turns last
    last = F.expr("(_plan.turns - 1 - _block) div _plan.blocks")
    turned = ranked.where("_block < _plan.turns").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    turn = F.expr("mix_epoch * _plan.blocks + _block")
    out = turned.withColumn("mix_block", turn)
    out = out.withColumn("mix_slot", F.expr(f"mix_block div _plan.share * {cycle} + element_at(_plan.slots, cast(mix_block % _plan.share + 1 as int))"))
    out = out.withColumn("mix_place", F.expr(f"mix_slot * {block_docs} + _rank % {block_docs}"))
    return out.select("_doc.*", *OWN)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """The order in which all ``documents`` enter the mix."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs)


OP9_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
exact AS (
  SELECT source, n, pow(n, {ALPHA}) * {CYCLE} / sum(pow(n, {ALPHA})) OVER () AS x,
         row_number() OVER (ORDER BY source NULLS LAST) AS i FROM counts),
part AS (SELECT *, greatest(1, floor(x))::BIGINT AS whole FROM exact),
share AS (
  SELECT source, n, i, whole + CASE WHEN row_number() OVER (ORDER BY x - whole DESC, i)
         <= {CYCLE} - sum(whole) OVER () THEN 1 ELSE 0 END AS a FROM part),
lists AS (SELECT list(a ORDER BY i) AS a, count(*) AS m FROM share),
edf AS (
  SELECT 0 AS slot, NULL::BIGINT AS pick, list_transform(a, lambda y: 0::BIGINT) AS done FROM lists
  UNION ALL
  SELECT slot + 1, p, list_transform(done, lambda d, j: CASE WHEN j = p THEN d + 1 ELSE d END)
  FROM (
    SELECT slot, done,
           list_sort(list_filter(list_transform(a, lambda y, j: CASE
             WHEN done[j] < y AND done[j] * {CYCLE} // y <= slot
             THEN [((done[j] + 1) * {CYCLE} + y - 1) // y, j] END), lambda z: z IS NOT NULL))[1][2] AS p
    FROM edf, lists WHERE slot < {CYCLE})),
turn AS (SELECT slot - 1 AS slot, pick AS i, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS k FROM edf WHERE pick IS NOT NULL),
need AS (
  SELECT s.source, s.i, s.a::BIGINT AS a, ((s.n + {BLOCK_DOCS - 1}) // {BLOCK_DOCS})::BIGINT AS blocks FROM share s),
ends AS (
  SELECT max((blocks - 1) // a * {CYCLE} + t.slot + 1) AS horizon FROM need JOIN turn t ON t.i = need.i AND t.k = (blocks - 1) % a),
total AS (
  SELECT need.*, horizon // {CYCLE} * a + (SELECT count(*) FROM turn t WHERE t.i = need.i AND t.slot < horizon % {CYCLE}) AS turns FROM need, ends),
ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r FROM documents),
laid AS (
  SELECT doc_id, ranked.source, r, total.i, a, unnest(generate_series(r // {BLOCK_DOCS}, turns - 1, blocks)) AS b, blocks
  FROM ranked JOIN total ON ranked.source IS NOT DISTINCT FROM total.source)
SELECT doc_id, laid.source, b // blocks AS mix_epoch, b AS mix_block, b // a * {CYCLE} + t.slot AS mix_slot,
       (b // a * {CYCLE} + t.slot) * {BLOCK_DOCS} + r % {BLOCK_DOCS} AS mix_place
FROM laid JOIN turn t ON t.i = laid.i AND t.k = b % a
"""
