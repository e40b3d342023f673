"""Building graphs: streams (ordered messages by key), pools (a changelog with a default) and flows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.monoids import SUM, Monoid
from ..plans.ir import Clock, Graph, GroupBy, Lookup, Merge, Node, PureTransform, Sink, Source, StatefulTransform


class NotGroupedError(TypeError):
    """State was asked of a stream whose messages of one key are not together yet; name the stream first."""


def by_key():
    """A key's messages in order."""
    return Window.partitionBy("key").orderBy("ord")


def so_far():
    """A key's messages up to the current one."""
    return by_key().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def literal(value: Any, kind: str) -> Column:
    """A plain value as a column of a type; sequences and records by way of JSON, maps of single values as such."""
    import json

    if kind.startswith("map") and isinstance(value, dict) and not any(isinstance(v, (list, dict)) for v in value.values()):
        return F.create_map(*[F.lit(x) for pair in value.items() for x in pair]).cast(kind)
    if isinstance(value, (list, dict)):
        return F.from_json(F.lit(json.dumps(value)), kind)
    return F.lit(value).cast(kind)


class Stream:
    """A stream definition; every method returns a new one."""

    def __init__(self, node: Node, grouped: bool, flow: Flow, keyed: bool = False):
        self.node, self.grouped, self.flow, self._keyed = node, grouped, flow, keyed
        #: Of a pool's changelog: the newest value of each key, see ``Pool.newest``.
        self.newest: Callable | None = None

    def _new(self, node: Node, grouped: bool | None = None) -> Stream:
        return Stream(node, self.grouped if grouped is None else grouped, self.flow)

    def _need_groups(self) -> None:
        if not self.grouped:
            raise NotGroupedError("name the stream with stream_to before keeping state")

    # stateless

    @property
    def with_keys(self) -> Stream:
        """The same stream; the next operator's function gets the key first."""
        return Stream(self.node, self.grouped, self.flow, True)

    def stream(self) -> Stream:
        """The same stream; functions get values only."""
        return Stream(self.node, self.grouped, self.flow, False)

    def _pure(self, kind: str, f: Callable, py: Callable | None) -> Stream:
        return self._new(PureTransform(self.node, kind, f, py, self._keyed))

    def flat_map(self, f: Callable, py: Callable | None = None) -> Stream:
        """Every element of the array ``f`` returns, in order."""
        return self._pure("flat_map", f, py)

    def filter(self, f: Callable, py: Callable | None = None) -> Stream:
        """Messages for which ``f`` is true."""
        return self._pure("filter", f, py)

    def map(self, f: Callable, py: Callable | None = None) -> Stream:
        """``f`` of each value."""
        return self._pure("map", f, py)

    def collect(self, defined: Callable, f: Callable, py_defined: Callable | None = None, py: Callable | None = None) -> Stream:
        """``f`` of the values where it is defined."""
        kept = self.filter(defined, py_defined)
        return (kept.with_keys if self._keyed else kept).map(f, py)

    def flatten(self) -> Stream:
        """The elements of array values."""
        return self.stream().flat_map(lambda v: v)

    def flatten_option(self) -> Stream:
        """Values that are not null."""
        return self.stream().filter(lambda v: v.isNotNull(), lambda v: v is not None)

    def zip_with_key(self) -> Stream:
        """(key, value) as value."""
        return self.with_keys.map(lambda k, v: F.struct(k.alias("_1"), v.alias("_2")), lambda k, v: {"_1": k, "_2": v})

    # keys

    def group_by(self, f: Callable, py: Callable | None = None) -> Stream:
        """The same values under the keys that ``f`` gives."""
        return self._new(GroupBy(self.node, f, py, self._keyed), False)

    def group_by_key(self) -> Stream:
        """Values are pairs (_1, _2): their first becomes the key, their second the value."""
        first = lambda v: v["_1"]
        return self.stream().group_by(first).map(lambda v: v["_2"])

    def invert(self) -> Stream:
        """Key a and value (b, c) become key b and value (a, c)."""
        pair = lambda k, v: F.struct(v["_1"].alias("_1"), F.struct(k.alias("_1"), v["_2"].alias("_2")).alias("_2"))
        return self.with_keys.map(pair, lambda k, v: {"_1": v["_1"], "_2": {"_1": k, "_2": v["_2"]}}).group_by_key()

    # state

    def transform(self, init: Callable[[], Any], step: Callable, type: str, window: Callable | None = None) -> Stream:
        """A state machine for each key: ``step(state, value) -> (state, outputs)``; with keys ``step(key, state, value)``."""
        self._need_groups()
        return self._new(StatefulTransform(self.node, init, step, type, window, self._keyed))

    process = transform

    def fold(self, init: Any, f: Callable[[Any, Any], Any], type: str) -> Pool:
        """Every new state of a running reduction, changed or not."""

        def step(state, value):
            state = f(state, value)
            return state, [state]

        return Pool(self.stream().transform(lambda: init, step, type), init, type)

    def sum(self, monoid: Monoid = SUM, type: str | None = None) -> Pool:
        """The running sum under a monoid."""
        return self.aggregate(monoid, type=type)

    def aggregate(self, monoid: Monoid, prepare: Callable | None = None, present: Callable | None = None, type: str | None = None) -> Pool:
        """Prepare each value, keep the running sum, present every state of it."""
        self._need_groups()
        kind = type or monoid.type
        up = self.stream().map(prepare) if prepare else self.stream()

        def step(state, value):
            state = monoid.plus(state, value)
            return state, [monoid.value(state)]

        node = StatefulTransform(up.node, monoid.zero, step, kind, lambda df: df.withColumn("value", monoid.running(F.col("value"), so_far())))
        final = lambda lower: lower(up.node).groupBy("key").agg(monoid.final(F.col("value")).alias("value"))
        out = Pool(self._new(node), monoid.initial, kind, final)
        return out.map(present) if present else out

    def distinct_count(self) -> Pool:
        """How many different values a key has had: the size of a growing set, without keeping the set in the plan."""
        self._need_groups()

        def step(state, value):
            state = state | {value}
            return state, [len(state)]

        def window(df):
            first = F.row_number().over(Window.partitionBy("key", "value").orderBy("ord")) == 1
            return df.withColumn("value", first.cast("bigint")).withColumn("value", F.sum("value").over(so_far()))

        final = lambda lower: lower(self.node).groupBy("key").agg(F.countDistinct(F.struct("value")).alias("value"))
        return Pool(self._new(StatefulTransform(self.node, frozenset, step, "bigint", window)), 0, "bigint", final)

    def grouped_by_count(self, size: int, lossless: bool = False, type: str = "array<bigint>") -> Stream:
        """Arrays of ``size`` values.

        As the model this engine follows has it, the value that finds the batch full emits
        it and is itself dropped; ``lossless`` batches (``chunked``) keep every value.  A
        batch that is not full is never emitted.
        """
        self._need_groups()
        if size <= 0:
            raise ValueError("a batch holds at least one value")
        cycle = size if lossless else size + 1

        def step(state, value):
            if lossless:
                state = [*state, value]
                return ([], [state]) if len(state) == size else (state, [])
            return ([], [state]) if len(state) == size else ([*state, value], [])

        def window(df):
            place = F.row_number().over(by_key()) - 1
            rows = df.withColumn("_g", F.floor(place / cycle)).withColumn("_i", place % cycle)
            parts = rows.groupBy("key", "_g").agg(
                F.sort_array(F.collect_list(F.when(F.col("_i") < size, F.struct("_i", "value")))).alias("_v"), F.max("ord").alias("ord"), F.max("_i").alias("_m")
            )
            parts = parts.where(F.col("_m") == cycle - 1)
            return parts.select("key", F.transform("_v", lambda x: x["value"]).alias("value"), "ord")

        return self._new(StatefulTransform(self.node, list, step, type, window))

    def chunked(self, size: int, type: str = "array<bigint>") -> Stream:
        """Arrays of ``size`` values, none lost but those of a last batch that is not full."""
        return self.grouped_by_count(size, True, type)

    # pools

    def latest_or(self, init: Any, type: str | None = None) -> Pool:
        """The stream as a changelog with a default."""
        return Pool(self.stream(), init, type)

    def latest_option(self, type: str | None = None) -> Pool:
        """The stream as a changelog whose default is null."""
        return Pool(self.stream(), None, type)

    def join(self, pool: Pool) -> Stream:
        """Each message with the pool's value just before it: value (_1, _2)."""
        self._need_groups()
        if not pool.updates().grouped:
            raise NotGroupedError("name the pool before joining with it")
        return self._new(Lookup(self.node, pool.updates().node, None, pool.initial))

    def sum_by_key(self, name: str, type: str = "bigint", key_type: str = "string") -> Pool:
        """Values are maps; the total of each map key over every stream key's newest map.

        A key's newer map takes back what its last one gave.  Differences of zero are left out.
        ``key_type`` is that of the maps' keys.
        """
        self._need_groups()

        def step(state, value):
            now = value or {}
            out = [{"_1": k, "_2": now.get(k, 0) - state.get(k, 0)} for k in sorted({*state, *now})]
            return now, [x for x in out if x["_2"]]

        def window(df):
            empty = F.map_filter("value", lambda k, v: F.lit(False))
            df = df.withColumn("value", F.coalesce("value", F.create_map().cast(f"map<{key_type},{type}>")))
            old = df.withColumn("_old", F.coalesce(F.lag("value").over(by_key()), empty))
            both = F.map_zip_with("_old", "value", lambda k, o, n: F.coalesce(n, F.lit(0)) - F.coalesce(o, F.lit(0)))
            listed = F.array_sort(F.map_entries(F.map_filter(both, lambda k, d: d != 0)))
            rows = old.select("key", "ord", F.posexplode(listed).alias("_i", "_e"))
            pair = F.struct(F.col("_e.key").alias("_1"), F.col("_e.value").alias("_2"))
            return rows.select("key", pair.alias("value"), F.concat("ord", F.array(F.col("_i").cast("bigint"))).alias("ord"))

        def final(lower):
            """Sums over the newest maps; keys that had a number once and are in no newest map any more are zero.

            If the maps are a pool's own changelog, which is never made then, those keys are left out.
            """
            newest = _newest(self, lower).select(F.explode("value").alias("key", "v"))
            totals = newest.groupBy("key").agg(F.sum("v").cast(type).alias("value"), F.max(F.col("v") != 0).alias("had"))
            if self.newest is not None:
                return totals.where("had").select("key", "value")
            known = lower(self.node).select(F.explode("value").alias("key", "v")).where("v <> 0").select("key").distinct()
            return known.join(totals, "key", "left").select("key", F.coalesce("value", F.lit(0).cast(type)).alias("value"))

        pair = self._new(StatefulTransform(self.node, dict, step, f"struct<_1:{key_type},_2:{type}>", window))
        pool = pair.group_by_key().stream_to(name).sum(_sum_of(type))
        pool.final = final
        return pool

    def latest_by_key(self, name: str, type: str = "bigint", key_type: str = "string", owner_type: str = "string") -> Pool:
        """Values are maps; for each map key, what every stream key's newest map has for it.

        Entries that a newer map lacks are removed first, then its own are put again.
        ``key_type`` is that of the maps' keys, ``owner_type`` that of the stream's (as strings
        they may be of any type).
        """
        self._need_groups()
        owner = str if owner_type == "string" else lambda k: k

        def changes(state, value):
            now = value or {}
            gone = [{"_1": k, "_2": None} for k in sorted(state) if k not in now]
            return now, gone + [{"_1": k, "_2": {"v": now[k]}} for k in sorted(now)]

        kind = f"struct<_1:{key_type},_2:struct<v:{type}>>"
        moved = self._new(StatefulTransform(self.node, dict, changes, kind))
        tagged = moved.with_keys.map(
            lambda k, v: F.struct(v["_1"].alias("_1"), F.struct(k.alias("k"), v["_2"].alias("v")).alias("_2")), lambda k, v: {"_1": v["_1"], "_2": {"k": k, "v": v["_2"]}}
        )

        def put(state, change):
            new = {k: v for k, v in state.items() if k != owner(change["k"])}
            if change["v"] is not None:
                new[owner(change["k"])] = change["v"]["v"]
            return new

        def final(lower):
            """Every key's newest map, turned over; map keys that all have lost keep an empty map.

            If the maps are a pool's own changelog, which is never made then, those keys are left out.
            """
            newest = _newest(self, lower).select(F.col("key").cast(owner_type).alias("o"), F.explode("value").alias("key", "v"))
            held = newest.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("o", "v")))).alias("value"))
            if self.newest is not None:
                return held
            known = lower(self.node).select(F.explode(F.map_keys("value")).alias("key")).distinct()
            empty = F.create_map().cast(f"map<{owner_type},{type}>")
            return known.join(held, "key", "left").select("key", F.coalesce("value", empty).alias("value"))

        pool = tagged.group_by_key().stream_to(name).fold({}, put, f"map<{owner_type},{type}>")
        pool.final = final
        return pool

    # names

    def stream_to(self, name: str) -> Stream:
        """Bind the stream to a name; what is read from the name has its keys together."""
        return self.flow.stream(name, self)

    def within(self, name: str) -> Stream:
        """Name a stream inside a binding's own body, where a cycle has no name of its own for it.

        Its keys count as together: the next state brings them together.  The name is taken and binds nothing.
        """
        self.flow.graph.reserve(name)
        return self._new(self.node, True)

    def sink_to(self, name: str) -> None:
        """Publish the stream."""
        self.flow.sink(name, self)


def _sum_of(kind: str) -> Monoid:
    from dataclasses import replace

    return replace(SUM, type=kind)


def _newest(stream: Stream, lower: Callable):
    """The newest value (key, value) of each key of a stream."""
    if stream.newest is not None:
        return stream.newest(lower)
    last = lower(stream.node).groupBy("key").agg(F.max_by(F.struct("value"), "ord").alias("v"))
    return last.select("key", F.col("v.value").alias("value"))


class Pool:
    """A changelog and the value that a key has before its first change.

    ``final`` makes the newest values (key, value) without the changelog, given what lowers
    nodes; pools made of pools know theirs from those.
    """

    def __init__(self, updates: Stream, initial: Any, type: str | None = None, final: Callable | None = None):
        self._updates, self.initial, self.type, self.final = updates, initial, type, final

    def updates(self) -> Stream:
        """The changelog as a stream."""
        stream = self._updates._new(self._updates.node)
        stream.newest = self.final
        return stream

    def newest(self, lower: Callable):
        """The newest value (key, value) of each key that has had a change."""
        return _newest(self.updates(), lower)

    def updated_pairs(self) -> Stream:
        """(previous, current) for each change; the first previous value is the initial one."""
        initial, kind = self.initial, self.type

        def step(state, value):
            return value, [{"_1": state, "_2": value}]

        def window(df):
            actual = df.schema["value"].dataType.simpleString()
            old = F.lag(F.struct("value")).over(by_key())
            before = F.when(old.isNull(), literal(initial, actual)).otherwise(old["value"])
            return df.withColumn("value", F.struct(before.alias("_1"), F.col("value").alias("_2")))

        self._updates._need_groups()
        node = StatefulTransform(self._updates.node, lambda: initial, step, f"struct<_1:{kind},_2:{kind}>", window)
        return self._updates._new(node)

    def map(self, f: Callable, py: Callable | None = None, initial: Any = None, type: str | None = None) -> Pool:
        """``f`` of every value, and of the initial one (given as ``initial`` where ``f`` works on columns only)."""
        if initial is None and self.initial is not None:
            try:
                initial = (py or f)(self.initial)
            except Exception as e:
                raise ValueError("give the mapped initial value: the function works on columns only") from e
        final = lambda lower: self.newest(lower).select("key", f(F.col("value")).alias("value"))
        return Pool(self._updates.stream().map(f, py), initial, type or self.type, final)

    def join(self, other: Pool) -> Pool:
        """A pair for every change of either side, each with the other's value at that time."""
        for side in (self, other):
            side._updates._need_groups()
        node = Lookup(self._updates.node, other._updates.node, self.initial, other.initial, both=True)

        def final(lower):
            """Both sides' newest values; a side without a change has its initial one."""
            sides = [p.newest(lower).select("key", F.struct("value").alias(c)) for p, c in ((self, "l"), (other, "r"))]
            both = sides[0].join(sides[1], "key", "full")
            known = lambda c, init: F.when(F.col(c).isNull(), literal(init, both.schema[c].dataType["value"].dataType.simpleString())).otherwise(F.col(c)["value"])
            return both.select("key", F.struct(known("l", self.initial).alias("_1"), known("r", other.initial).alias("_2")).alias("value"))

        return Pool(self._updates._new(node), {"_1": self.initial, "_2": other.initial}, None, final)

    def stream_to(self, name: str) -> Pool:
        """Bind the changelog to a name."""
        return self._updates.flow.pool(name, self)


class Topic:
    """A name from outside that a flow can read."""

    def __init__(self, name: str):
        self.name = name

    def as_source(self, flow: Flow) -> Stream:
        """The topic as a stream of the flow."""
        return flow.source(self.name)


class Flow:
    """Names and what they are bound to; also usable with ``with``."""

    def __init__(self):
        self.graph = Graph()

    def __enter__(self) -> Flow:
        return self

    def __exit__(self, *exc) -> None:
        return None

    def source(self, name: str) -> Stream:
        """A topic from outside."""
        return Stream(Source(name), True, self)

    def clock(self, seconds: int) -> Stream:
        """Ticks under one key; their values are epoch seconds."""
        return Stream(Clock(seconds), True, self)

    def stream(self, name: str, stream: Stream) -> Stream:
        """Bind any stream; reading the name gives a grouped one."""
        self.graph.bind(name, Sink(stream.node))
        return Stream(Source(name), True, self)

    def pool(self, name: str, pool: Pool) -> Pool:
        """Bind a pool's changelog and keep its default."""
        return Pool(self.stream(name, pool.updates()), pool.initial, pool.type, pool.final)

    def sink(self, name: str, stream: Stream) -> None:
        """Publish a grouped stream."""
        stream._need_groups()
        self.graph.bind(name, Sink(stream.node, published=True))

    def cycle(self, name: str, body: Callable[[Stream], Stream], mode: str = "linear") -> Stream:
        """Bind ``name`` to ``body`` of itself.

        ``linear``: the body keeps no state over its own name, so each round runs it on what
        the last one made.  ``replay``: each round runs it on all messages, until a round
        makes nothing new; for bodies whose final messages do not depend on the order.
        """
        made = body(Stream(Source(name), True, self))
        self.graph.bind(name, Sink(made.node, cycle=mode))
        return Stream(Source(name), True, self)

    add_cycle = cycle

    def merge(self, **branches: Stream) -> Stream:
        """All messages of several streams."""
        grouped = all(s.grouped for s in branches.values())
        return Stream(Merge([(n, s.node) for n, s in branches.items()]), grouped, self)

    def merge_pairs(self, *branches: tuple[str, Stream]) -> Stream:
        """``merge`` for names that are no identifiers; names must differ."""
        names = [n for n, _ in branches]
        if len(set(names)) != len(names):
            raise ValueError("branch names must differ")
        return self.merge(**dict(branches))

    def include(self, other: Flow) -> Flow:
        """Take over another flow's bindings; a name that both have is an error."""
        for name, sink in other.graph.bindings.items():
            self.graph.bind(name, sink)
        return self
