"""A corpus pipeline: language ID, exact dedup, near-duplicate dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` stores in
the folder that the cluster shares and rereads for the next stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.exact_dedup import exact_duplicates
from millrace.llm.language_id import UNKNOWN, predict, train
from millrace.llm.mixing import OWN, mix
from millrace.llm.packing import pack
from millrace.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Predictions below this posterior are rejected; a text that two languages code equally well is below.
MIN_SCORE = 0.5
#: The near-duplicate stage takes shingles of five words and links texts with 0.8 of their fingerprint's 64 bits in common.
SHINGLE_WORDS = 5
RADIUS = 12

_left: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that removes what the one before it left in the shared folder, unless ``docs`` still reads that.

    What the last one leaves stays: its result is read later.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left and f.__name__ != "language_id":
            read = "\n".join(docs.inputFiles())
            for path in [p for p in _left if p.removeprefix("file://") not in read]:
                common.delete(spark, path)
        _left.clear()
        with common.tracked() as paths:
            found = f(spark, docs, sf_dir)
        _left.extend(paths)
        return found

    return run


def _numbered(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` with ``row``, a number for each row that repeated rows do not share."""
    return common.stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), label)


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from all labelled rows; rejected: ``und`` and predictions below ``MIN_SCORE``.

    Kept rows are returned unchanged, label included; null texts are rejected.
    """
    rows = docs.select(*COLUMNS)
    found = predict(rows, train(rows), keep_text=True)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space the longest stays, then the one with the least doc_id."""
    rows = _numbered(docs, "stage-exact")
    found = exact_duplicates(rows, id_col="row").where("kept").select(F.col("doc_id").alias("row"))
    return rows.join(found, "row", "left_semi").select(*COLUMNS)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component one row stays: that with the least doc_id (nulls last)."""
    rows = _numbered(docs, "stage-near")
    found = near_duplicates(rows, words=SHINGLE_WORDS, radius=RADIUS, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
    best = rows.select("row", "doc_id").join(found, "row").groupBy("component_id").agg(F.min(order).alias("b"))
    return rows.join(best.select(F.col("b.r").alias("row")), "row", "left_semi").select(*COLUMNS)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a row for each epoch that a document is in; none is left out.

    Rows are in the order of the mix: that of the partitions, and of the rows inside each.
    """
    mixed = mix(docs.select(*COLUMNS))
    return mixed.repartitionByRange("mix_place").sortWithinPartitions("mix_place").drop(*OWN)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as pieces of sequences of 1024 tokens; pieces of one length keep the order of the mix."""
    return pack(docs, keep_order=bool(docs.inputFiles()))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("source mixing", source_mix),
    ("packing", packing),
]

#: Language models and packing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            last, docs = docs, common.stored(docs, f"stage-{i}")
            common.discard(last)
    return docs
