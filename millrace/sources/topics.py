"""Topics: where streams come from and go to.

A topic in a batch plan is a frame with ``key``, ``value`` and ``ord``.  ``ord`` is an
array of bigints that orders the messages of a key; it comes from columns whose values
are unique, since ties would make a replay ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def _number(c: Column, kind: str) -> Column:
    return F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c.cast("bigint")


def topic(df: DataFrame, *, key: str | Column, value: str | Column, order: list[str]) -> DataFrame:
    """A table as a topic; ``order`` names its ordering columns (whole numbers or timestamps)."""
    kinds = dict(df.dtypes)
    as_column = lambda c: F.expr(c) if isinstance(c, str) else c
    ords = [_number(F.col(c), kinds[c]) for c in order]
    return df.select(as_column(key).alias("key"), as_column(value).alias("value"), F.array(*ords).alias("ord"))


def file_topic(spark: SparkSession, path: str, *, format: str = "parquet", schema: str | None = None, key: str, value: str, order: list[str], **options: str) -> DataFrame:
    """A topic in files of any format that Spark reads (parquet, orc, csv, json, text)."""
    reader = spark.read.format(format).options(**options)
    return topic((reader.schema(schema) if schema else reader).load(path), key=key, value=value, order=order)


def memory_topic(spark: SparkSession, messages: Iterable[tuple], schema: str) -> DataFrame:
    """A topic from (key, value) pairs in order; ``schema`` is "key TYPE, value TYPE"."""
    rows = [(*m, i) for i, m in enumerate(messages)]
    return topic(spark.createDataFrame(rows, f"{schema}, n bigint"), key="key", value="value", order=["n"])


def kafka_topic(spark: SparkSession, servers: str, name: str, *, key: str = "cast(key as string)", value: str = "cast(value as string)", streaming: bool = False) -> DataFrame:
    """A Kafka topic from its earliest offset; needs Spark's Kafka connector on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    df = reader.option("kafka.bootstrap.servers", servers).option("subscribe", name).option("startingOffsets", "earliest").load()
    order = F.array(F.unix_micros("timestamp"), F.col("partition").cast("bigint"), F.col("offset"))
    return df.select(F.expr(key).alias("key"), F.expr(value).alias("value"), order.alias("ord"))


def kafka_rows(df: DataFrame) -> DataFrame:
    """Messages as Kafka takes them: key and value as strings, records and collections as JSON."""
    simple = lambda c: F.col(c).cast("string") if not isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType)) else F.to_json(c)
    return df.select(simple("key").alias("key"), simple("value").alias("value"))


def publish_kafka(df: DataFrame, servers: str, name: str) -> None:
    """Write a stream to a Kafka topic; needs Spark's Kafka connector on the class path."""
    kafka_rows(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", name).save()


def clock(spark: SparkSession, seconds: int, first: str, last: str) -> DataFrame:
    """A tick every ``seconds`` from ``first`` to ``last`` (timestamps), as epoch seconds under key 0."""
    span = spark.sql(f"SELECT explode(sequence(unix_seconds(timestamp'{first}'), unix_seconds(timestamp'{last}'), {int(seconds)}L)) AS t")
    return span.select(F.lit(0).cast("bigint").alias("key"), F.col("t").alias("value"), F.array(F.col("t") * 1_000_000).alias("ord"))


def place_of(key: Column, partitions: int) -> Column:
    """Where a Java system with hash placement puts a string key (the sign bit of its hash dropped, modulo)."""
    codes = F.transform(F.split(key, ""), lambda c: F.ascii(c).cast("bigint"))
    hashed = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return hashed.bitwiseAND(F.lit(0x7FFFFFFF)) % partitions


def publish(df: DataFrame, path: str, *, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a stream (key, value, ord) as files that ``file_topic`` reads back."""
    df.write.format(format).mode(mode).save(path)
