"""Graphs on Structured Streaming.

Stateless nodes are ordinary projections.  A state machine is a keyed processor whose
pickled state lives in the checkpointed state store; it handles a key's messages of a
micro-batch in order of ``ord``, so the order between batches is that of arrival.  Values
cross into Python as JSON.  State is never dropped: that would change results.

Exactly-once results need an idempotent sink: ``start`` writes files, whose commit log is
exactly-once together with the checkpoint; ``start_each`` gives every micro-batch and its
number to a function, which may see one again after a failure (at least once).
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.flow import Flow
from ..plans.batch import Batch, without
from ..plans.ir import Clock, Graph, GroupBy, Lookup, Merge, Node, PureTransform, Source, StatefulTransform
from ..plans.storage import discard, stored
from ..sources.topics import kafka_rows

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Keyed(StatefulProcessor):
    """Runs ``step`` over a key's messages."""

    def __init__(self, init: Callable[[], Any], step: Callable, keyed: bool):
        self._init, self._step, self._keyed = init, step, keyed

    def init(self, handle) -> None:
        self._state = handle.getValueState("state", "s binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        got = [(json.loads(o), json.loads(p)["value"] if p is not None else None) for pdf in rows for p, o in zip(pdf["payload"], pdf["place"])]
        got.sort(key=lambda m: m[0])
        state = pickle.loads(self._state.get()[0]) if self._state.exists() else self._init()
        out = []
        for place, value in got:
            state, made = self._step(key[0], state, value) if self._keyed else self._step(state, value)
            out += [(key[0], json.dumps({"value": x}), json.dumps([*place, i])) for i, x in enumerate(made)]
        self._state.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=["key", "payload", "place"])

    def close(self) -> None:
        pass


def _lookup_step(left: Any, right: Any, both: bool) -> tuple[Callable[[], Any], Callable]:
    def step(state, message):
        now = (message["l"]["value"], state[1]) if message["side"] == 0 else (state[0], message["r"]["value"])
        return now, [{"_1": now[0], "_2": now[1]}] if both or message["side"] == 0 else []

    return lambda: (left, right), step


class Streaming:
    """A graph over streaming topics: frames of (key, value, ord) from ``readStream``."""

    def __init__(self, spark: SparkSession, flow: Flow | Graph, topics: dict[str, DataFrame]):
        self.spark, self.topics = spark, dict(topics)
        self.graph = flow.graph if isinstance(flow, Flow) else flow
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def stream(self, name: str) -> DataFrame:
        """The messages of a name or topic."""
        if name in self.graph.bindings:
            sink = self.graph.bindings[name]
            if sink.cycle:
                raise NotImplementedError("start_cycle runs a linear cycle; one that keeps state over its own name runs as a replay")
            return self._lower(sink.node)
        return self.topics[name]

    def _machine(self, df: DataFrame, init: Callable, step: Callable, kind: str, keyed: bool = False) -> DataFrame:
        key = df.schema["key"].dataType.simpleString()
        rows = df.select("key", F.to_json(F.struct("value")).alias("payload"), F.to_json("ord").alias("place"))
        made = rows.groupBy("key").transformWithStateInPandas(
            statefulProcessor=_Keyed(init, step, keyed),
            outputStructType=f"key {key}, payload string, place string",
            outputMode="Append",
            timeMode="None",
        )
        return made.select("key", F.from_json("payload", f"value {kind}")["value"].alias("value"), F.from_json("place", "array<bigint>").alias("ord"))

    def _lower(self, node: Node) -> DataFrame:
        if isinstance(node, Source):
            return self.stream(node.name)
        if isinstance(node, Clock):
            ticks = self.spark.readStream.format("rate").load().select(F.unix_seconds("timestamp").alias("t")).where(F.col("t") % node.seconds == 0)
            return ticks.select(F.lit(0).cast("bigint").alias("key"), F.col("t").alias("value"), F.array(F.col("t") * 1_000_000).alias("ord"))
        if isinstance(node, (PureTransform, GroupBy)):
            df = self._lower(node.up)
            out = node.f(F.col("key"), F.col("value")) if node.keyed else node.f(F.col("value"))
            if isinstance(node, GroupBy):
                return df.select(out.alias("key"), "value", "ord")
            if node.kind == "filter":
                return df.where(out)
            if node.kind == "map":
                return df.select("key", out.alias("value"), "ord")
            spread = df.select("key", "ord", F.posexplode(out).alias("_i", "value"))
            return spread.select("key", "value", F.concat("ord", F.array(F.col("_i").cast("bigint"))).alias("ord"))
        if isinstance(node, Merge):
            parts = [self._lower(n) for _, n in node.branches]
            out = None
            for i, p in enumerate(parts):
                p = p.select("key", "value", F.concat("ord", F.array(F.lit(i).cast("bigint"))).alias("ord"))
                out = p if out is None else out.unionByName(p)
            return out
        if isinstance(node, StatefulTransform):
            if node.type is None:
                raise ValueError("a state machine on a stream needs the type of its outputs")
            return self._machine(self._lower(node.up), node.init, node.step, node.type, node.keyed)
        assert isinstance(node, Lookup)
        left, right = self._lower(node.left), self._lower(node.right)
        kinds = [df.schema["value"].dataType.simpleString() for df in (left, right)]
        both = None
        for i, df in enumerate((left, right)):
            sides = [F.struct("value") if i == j else F.lit(None).cast(f"struct<value:{kinds[j]}>") for j in (0, 1)]
            value = F.struct(F.lit(i).alias("side"), sides[0].alias("l"), sides[1].alias("r"))
            part = df.select("key", value.alias("value"), F.concat("ord", F.array(F.lit(i).cast("bigint"))).alias("ord"))
            both = part if both is None else both.unionByName(part)
        init, step = _lookup_step(node.left_init, node.right_init, node.both)
        return self._machine(both, init, step, f"struct<_1:{kinds[0]},_2:{kinds[1]}>")

    def start(self, name: str, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
        """Append a name's messages to parquet files, exactly once."""
        writer = self.stream(name).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer).start(path)

    def start_each(self, name: str, use: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = True) -> StreamingQuery:
        """Give each micro-batch of a name's messages and its number to a function, at least once."""
        writer = self.stream(name).writeStream.foreachBatch(use).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer).start()

    def start_cycle(self, name: str, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
        """A linear cycle: every micro-batch goes round until nothing comes back; all its rounds are one folder below ``path``.

        A micro-batch that is run again writes its folder again, so each message is there exactly once.
        """
        sink = self.graph.bindings[name]
        if sink.cycle != "linear":
            raise NotImplementedError("only a body that keeps no state over its own name can go round inside a micro-batch")
        others = {n.name for n in sink.node.walk() if isinstance(n, Source)} - {name}
        shapes = {n: self.spark.createDataFrame([], self.stream(n).schema) for n in others}
        batch = Batch(self.spark, self.graph, {})

        def go_round(df: DataFrame, number: int) -> None:
            rounds = [stored(batch._mark(df, 0), f"{name}-{number}-0")]
            while rounds[-1].limit(1).count():
                last = rounds[-1]
                made = batch._lower(sink.node, lambda n: last if n == name else shapes[n])
                rounds.append(stored(batch._mark(made, len(rounds)), f"{name}-{number}-{len(rounds)}"))
            total = rounds[0]
            for part in rounds[1:]:
                total = total.unionByName(part)
            total.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")
            discard(*rounds)

        writer = self._lower(without(sink.node, name)).writeStream.foreachBatch(go_round).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer).start()

    def start_kafka(self, name: str, servers: str, topic: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
        """Send a name's messages to a Kafka topic, at least once; needs Spark's Kafka connector on the class path."""
        writer = kafka_rows(self.stream(name)).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer).start()


def file_stream(spark: SparkSession, path: str, schema: str, *, files_per_batch: int = 1) -> DataFrame:
    """A streaming topic from parquet files of (key, value, ord), taken in order of their modification times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
