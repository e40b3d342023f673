"""Replay: a graph over stored topics as one DataFrame plan.

Every stream is (key, value, ord).  Stateless nodes are projections that Catalyst fuses;
re-keying only replaces a column, and the exchange comes from the next stateful node.
Recognised state machines are window functions; opaque ones run in Arrow batches over
partitions sorted by (key, ord), which keep one state at a time, so a key of any size
streams through.  Named streams are lowered once and reused.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..operators.flow import Flow, Pool, Stream, literal, so_far
from .ir import Clock, Graph, GroupBy, Lookup, Merge, Node, PureTransform, Source, StatefulTransform, Transform
from .storage import stored


def converter(kind: DataType) -> Callable | None:
    """What turns Arrow's list-of-pairs form of maps in a value of this type into dictionaries; None if it holds no map."""
    if isinstance(kind, MapType):
        inner = converter(kind.valueType) or (lambda v: v)
        return lambda x: None if x is None else {k: inner(v) for k, v in (x.items() if isinstance(x, dict) else x)}
    if isinstance(kind, ArrayType):
        inner = converter(kind.elementType)
        return inner and (lambda x: None if x is None else [inner(v) for v in x])
    if isinstance(kind, StructType):
        fields = {f.name: c for f in kind if (c := converter(f.dataType))}
        return (lambda x: None if x is None else {k: fields[k](v) if k in fields else v for k, v in x.items()}) if fields else None
    return None


def run_machine(df: DataFrame, node: StatefulTransform) -> DataFrame:
    """A Python state machine over each key's messages in order."""
    spark = df.sparkSession
    key_type = df.schema["key"].dataType.simpleString()
    schema = spark.createDataFrame([], f"key {key_type}, value {node.type}, ord array<bigint>").schema
    arrow = to_arrow_schema(schema)
    init, step, keyed = node.init, node.step, node.keyed
    plain = converter(df.schema["value"].dataType) or (lambda v: v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, begun = None, None, False
        for batch in batches:
            keys, values, ords = (c.to_pylist() for c in batch.columns)
            rows: list[tuple] = []
            for key, value, at in zip(keys, values, ords):
                if not begun or key != now:
                    state, now, begun = init(), key, True
                value = plain(value)
                state, outputs = step(key, state, value) if keyed else step(state, value)
                rows += [(key, out, [*at, i]) for i, out in enumerate(outputs)]
            if rows:
                columns = [pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    ordered = df.select("key", "value", "ord").repartition("key").sortWithinPartitions("key", "ord")
    return ordered.mapInArrow(run, schema)


def without(body: Node, name: str) -> Node:
    """A cycle's body without the branches that read nothing but its own name."""

    def pruned(node: Node) -> Node | None:
        if isinstance(node, Source):
            return None if node.name == name else node
        if isinstance(node, Merge):
            left = [(n, p) for n, b in node.branches if (p := pruned(b)) is not None]
            return Merge(left) if left else None
        if isinstance(node, (Transform, GroupBy)):
            up = pruned(node.up)
            return None if up is None else replace(node, up=up)
        return node

    start = pruned(body)
    if start is None:
        raise ValueError(f"{name} reads nothing but itself")
    return start


class Batch:
    """A graph, the topics it reads, and the frames of its names."""

    def __init__(self, spark: SparkSession, flow: Flow | Graph, topics: dict[str, DataFrame], *, span: tuple[str, str] | None = None, max_rounds: int | None = None):
        self.spark = spark
        self.graph = flow.graph if isinstance(flow, Flow) else flow
        self.topics, self.span, self.max_rounds = dict(topics), span, max_rounds
        self._named: dict[str, DataFrame] = {}

    def stream(self, name: str) -> DataFrame:
        """The messages of a name or topic."""
        if name in self._named:
            return self._named[name]
        if name in self.graph.bindings:
            sink = self.graph.bindings[name]
            self._named[name] = self._fixpoint(name, sink.node, sink.cycle) if sink.cycle else self.lower(sink.node)
        elif name in self.topics:
            self._named[name] = self.topics[name]
        else:
            raise KeyError(f"neither bound nor a topic: {name}")
        return self._named[name]

    def lower(self, what: Node | Stream | Pool) -> DataFrame:
        """The messages of any definition."""
        node = what.node if isinstance(what, Stream) else what.updates().node if isinstance(what, Pool) else what
        return self._lower(node, self.stream)

    def current(self, pool: Pool) -> DataFrame:
        """Each key's present value (key, value).

        Only these are made: a running sum becomes an aggregate with map-side partial sums,
        and pools that are joined meet as their present values.
        """
        return pool.newest(self.lower)

    def _lower(self, node: Node, named: Callable[[str], DataFrame]) -> DataFrame:
        if isinstance(node, Source):
            return named(node.name)
        if isinstance(node, Clock):
            if self.span is None:
                raise ValueError("a replay of a clock needs a span of time")
            from ..sources.topics import clock

            return clock(self.spark, node.seconds, *self.span)
        if isinstance(node, PureTransform):
            df = self._lower(node.up, named)
            out = node.f(F.col("key"), F.col("value")) if node.keyed else node.f(F.col("value"))
            if node.kind == "filter":
                return df.where(out)
            if node.kind == "map":
                return df.select("key", out.alias("value"), "ord")
            spread = df.select("key", "ord", F.posexplode(out).alias("_i", "value"))
            return spread.select("key", "value", F.concat("ord", F.array(F.col("_i").cast("bigint"))).alias("ord"))
        if isinstance(node, GroupBy):
            df = self._lower(node.up, named)
            key = node.f(F.col("key"), F.col("value")) if node.keyed else node.f(F.col("value"))
            return df.select(key.alias("key"), "value", "ord")
        if isinstance(node, Merge):
            parts = [self._lower(n, named) for _, n in node.branches]
            parts = [p.select("key", "value", F.concat("ord", F.array(F.lit(i).cast("bigint"))).alias("ord")) for i, p in enumerate(parts)]
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            return out
        if isinstance(node, StatefulTransform):
            df = self._lower(node.up, named)
            return node.window(df).select("key", "value", "ord") if node.window else run_machine(df, node)
        if isinstance(node, Lookup):
            return self._lookup(node, named)
        raise TypeError(f"no batch form of {type(node).__name__}")

    def _lookup(self, node: Lookup, named: Callable[[str], DataFrame]) -> DataFrame:
        left, right = self._lower(node.left, named), self._lower(node.right, named)
        kinds = [df.schema["value"].dataType.simpleString() for df in (left, right)]
        # a value is wrapped, so that a null value is not taken for none; at equal places the left side comes first
        wrap = [F.struct("value"), F.lit(None).cast(f"struct<value:{kinds[0]}>")], [F.lit(None).cast(f"struct<value:{kinds[1]}>"), F.struct("value")]
        both = None
        for i, df in enumerate((left, right)):
            place = F.concat("ord", F.array(F.lit(i).cast("bigint")))
            part = df.select("key", wrap[0][i].alias("l"), wrap[1][i].alias("r"), place.alias("ord"))
            both = part if both is None else both.unionByName(part)
        w = so_far()
        known = lambda c, init, kind: F.when(F.last(c, True).over(w).isNull(), literal(init, kind)).otherwise(F.last(c, True).over(w)["value"])
        first = F.col("l")["value"] if not node.both else known("l", node.left_init, kinds[0])
        out = both.withColumn("value", F.struct(first.alias("_1"), known("r", node.right_init, kinds[1]).alias("_2")))
        return (out if node.both else out.where("l is not null")).select("key", "value", "ord")

    def _fixpoint(self, name: str, body: Node, mode: str) -> DataFrame:
        """Rounds of a body that reads its own name; each is stored."""
        reads = {n.name for n in body.walk() if isinstance(n, Source)}
        outside = {n: self.stream(n) for n in reads - {name}}
        shapes = {n: df.limit(0) for n, df in outside.items()}
        first = self._first(name, body, outside)
        total = stored(self._mark(first, 0), f"{name}-0")
        last = total
        for turn in itertools.count(1):
            if self.max_rounds is not None and turn > self.max_rounds:
                raise RuntimeError(f"{name} did not settle in {self.max_rounds} rounds")
            if mode == "linear":
                made = self._lower(body, lambda n, last=last: last if n == name else shapes[n])
                last = stored(self._mark(made, turn), f"{name}-{turn}")
                if last.limit(1).count() == 0:
                    return total
                total = total.unionByName(last)
            else:
                made = self._lower(body, lambda n, seen=total: seen if n == name else outside[n])
                new = made.select("key", "value").subtract(total.select("key", "value"))  # nulls are equal to nulls here
                order = F.row_number().over(Window.partitionBy("key").orderBy("value")).cast("bigint")
                last = stored(new.select("key", "value", F.array(F.lit(turn).cast("bigint"), order).alias("ord")), f"{name}-{turn}")
                if last.limit(1).count() == 0:
                    return total
                total = total.unionByName(last)

    def _first(self, name: str, body: Node, outside: dict[str, DataFrame]) -> DataFrame:
        """The first round: nothing has come back yet, so branches that only read the name are left out."""
        return self._lower(without(body, name), outside.__getitem__)

    @staticmethod
    def _mark(df: DataFrame, turn: int) -> DataFrame:
        return df.select("key", "value", F.concat(F.array(F.lit(turn).cast("bigint")), "ord").alias("ord"))
