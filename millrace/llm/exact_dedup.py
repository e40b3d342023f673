"""Exact deduplication by distributed most-significant-digit radix partitioning.

A text's normalised bytes (white space deleted) are the digits of a key that begins with
their own number, so that a group's members end together.  Each round splits the open
groups by their next run of bytes; the run grows sixteenfold from round to round, so a
text of n bytes takes about log16(n) rounds.  A group closes when it is a singleton or
its bytes have ended; equality is that of the bytes themselves, no digest is compared.

Counting a round's groups pre-aggregates on the map side, so a group of copies that holds
a third of all rows sends one row per task; telling the rows their group is a join, whose
hot keys adaptive execution splits.  Each round is stored in the shared folder.

Defined edge cases: null counts as empty; all empty texts are one group; very long texts
take one more round for every sixteenfold length; among rows with
the same longest text and id (repeated rows) the first in the stored order stays, so one
row of a group is kept in any case; null document ids sort last; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Deleted before texts are compared.
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of the first round, and by how much the run grows.
FIRST, GROWTH = 32, 16

_ROWS = "doc_id long, n_chars long, row long, n_bytes long, data binary, text_sha256 string"


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        data = [x.encode().translate(None, WHITE_SPACE) for x in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(x) for x in texts], pa.int64()),
                pa.array(range(row, row + len(texts)), pa.int64()),
                pa.array([len(x) for x in data], pa.int64()),
                pa.array(data, pa.binary()),
                pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()),
            ],
            names=["doc_id", "n_chars", "row", "n_bytes", "data", "text_sha256"],
        )
        row += len(texts)


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text, for reference only)."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = common.stored(rows.mapInArrow(_normalise, _ROWS), "radix-0")
    open_ = table.withColumn("group", F.col("n_bytes"))
    closed, start, run, level = [], 0, FIRST, 0
    while True:
        stop = start + run
        # the last run of a text is the rest of it; a group's members have the same number of bytes; bytes that were compared are gone
        keyed = open_.withColumn("digits", F.expr(f"substring(data, 1, {run})"))
        best = F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
        groups = keyed.groupBy("group", "digits").agg(F.count("*").alias("group_size"), F.min(best).alias("best"))
        # a group's number: taken once the table is stored, so that it never changes
        groups = common.stored(groups, f"radix-groups-{level}")
        joined = keyed.join(groups.withColumn("next", F.monotonically_increasing_id()), ["group", "digits"])
        ended = (F.col("group_size") == 1) | (F.col("n_bytes") <= stop)
        joined = joined.select(
            "doc_id", "n_chars", "row", "n_bytes", F.when(~ended, F.expr(f"substring(data, {run + 1})")).alias("data"), "text_sha256", "group_size",
            F.col("best.d").alias("keep_id"), (F.col("best.r") == F.col("row")).alias("kept"), F.col("next").alias("group"), ended.alias("ended"),
        )
        level += 1
        done = common.stored(joined, f"radix-{level}")
        # of a finished round only the closed rows are read again, and their texts are gone
        common.discard(groups, *([table] if level == 1 else []))
        closed.append(done.where("ended").select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
        open_ = done.where("not ended").select("doc_id", "n_chars", "row", "n_bytes", "data", "text_sha256", "group")
        if open_.limit(1).count() == 0:
            break
        start, run = stop, min(run * GROWTH, (1 << 31) - 1 - stop)
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all ``documents``."""
    return exact_duplicates(common.table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
g AS (
  SELECT doc_id, body,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
