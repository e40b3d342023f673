"""What the operators share: reading tables, stored tables, Arrow settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.storage import delete, discard, new_path, shared_dir, stored, tracked

__all__ = ["BATCH_ROWS", "delete", "discard", "new_path", "shared_dir", "small_batches", "stored", "table", "tracked"]

#: Rows of an Arrow batch; with whole texts in them, batches of Spark's default size could outgrow a worker.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, so that very long texts make small batches.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches that carry whole texts to Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str((1 << 31) - 1)).rstrip("bB") or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
