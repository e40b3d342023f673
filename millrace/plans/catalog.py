"""The registered queries over the driver's tables, and the same in SQL.

Streams come from ``events`` by user in order of event_id unless a query says otherwise.
Collections are joined to strings, since results hold scalars only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..examples import jobs
from ..functions.monoids import AVERAGE, LIST, MAX, SET_UNION, SUM, SUM_DOUBLE, pointwise, product
from ..functions.process import Process
from ..functions.text import split_words
from ..operators.components import connected_components
from ..operators.flow import Flow
from ..sources.topics import clock, topic
from .batch import Batch


def _events(spark: SparkSession, sf_dir: str, key: str = "user_id", value: str = "event_id") -> DataFrame:
    return topic(spark.read.parquet(f"{sf_dir}/events.parquet"), key=key, value=value, order=["event_id"])


def _run(spark: SparkSession, sf_dir: str, build, key: str = "user_id", value: str = "event_id", **more) -> tuple[Batch, object]:
    flow = Flow()
    out = build(flow, flow.source("events"))
    topics = {"events": _events(spark, sf_dir, key, value)} | more
    return Batch(spark, flow, topics), out


def _messages(spark, sf_dir, build, key="user_id", value="event_id", **more) -> DataFrame:
    batch, out = _run(spark, sf_dir, build, key, value, **more)
    return batch.lower(out)


QUERIES: dict = {}
SQL: dict[str, str] = {}


_COMPONENTS = """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS u, 1000000000 + o_orderkey // 2 AS v FROM orders),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(node, label) USING KEY (node) AS (
  SELECT u AS node, u AS label FROM b GROUP BY u
  UNION
  SELECT b.v AS node, min(r.label) AS label FROM r JOIN b ON r.node = b.u JOIN recurring.r AS now ON now.node = b.v
  WHERE r.label < now.label GROUP BY b.v)
SELECT node, label AS component FROM r"""


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_WORDS = r"""
SELECT doc_id, w AS word, i FROM (
  SELECT doc_id, unnest(words) AS w, unnest(generate_series(1, len(words))) AS i FROM (
    SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\s') THEN [text] WHEN regexp_full_match(text, '\s+') THEN []
      ELSE string_split_regex(regexp_replace(text, '\s+$', ''), '\s+') END AS words FROM documents))
"""


@_query("word_count", f"SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY word")
def word_count(spark, sf_dir):
    """The final counts: running counts that nothing reads become a partial aggregate."""
    flow = Flow()
    words = flow.source("sentences").flat_map(split_words)
    pairs = words.map(lambda w: F.struct(w.alias("_1"), F.lit(1).cast("bigint").alias("_2"))).group_by_key().stream_to("words")
    counts = pairs.sum(SUM)
    docs = topic(spark.read.parquet(f"{sf_dir}/documents.parquet"), key="doc_id", value="text", order=["doc_id"])
    return Batch(spark, flow, {"sentences": docs}).current(counts).select(F.col("key").alias("word"), F.col("value").alias("n"))


@_query("word_count_running", f"SELECT word, row_number() OVER (PARTITION BY word ORDER BY doc_id, i) AS n FROM ({_WORDS})")
def word_count_running(spark, sf_dir):
    """Every count that each word has had."""
    docs = topic(spark.read.parquet(f"{sf_dir}/documents.parquet"), key="doc_id", value="text", order=["doc_id"])
    df = Batch(spark, jobs.word_count(), {"sentences": docs}).stream("word-counts")
    return df.select(F.col("key").alias("word"), F.col("value").alias("n"))


@_query("map_filter_collect", "SELECT user_id, event_id * 2 + 1 AS v FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0")
def map_filter_collect(spark, sf_dir):
    """filter, then collect (a partial function), then map."""
    out = _messages(spark, sf_dir, lambda _, s: s.filter(lambda v: v % 3 == 0).collect(lambda v: v % 2 == 0, lambda v: v * 2).map(lambda v: v + 1))
    return out.select(F.col("key").alias("user_id"), F.col("value").alias("v"))


@_query("flatmap_flatten_option", "SELECT user_id, v FROM (SELECT user_id, unnest([event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 10 END]) AS v FROM events) WHERE v IS NOT NULL")
def flatmap_flatten_option(spark, sf_dir):
    """map to arrays, flatten, drop nulls."""
    arrays = lambda v: F.array(v, F.when(v % 2 == 0, v * 10))
    out = _messages(spark, sf_dir, lambda _, s: s.map(arrays).flatten().flatten_option())
    return out.select(F.col("key").alias("user_id"), F.col("value").alias("v"))


@_query("with_keys_zip", "SELECT user_id AS k, event_id + user_id AS v FROM events")
def with_keys_zip(spark, sf_dir):
    """Key-aware map and zip_with_key."""
    out = _messages(spark, sf_dir, lambda _, s: s.with_keys.map(lambda k, v: k + v).zip_with_key())
    return out.select(F.col("value._1").alias("k"), F.col("value._2").alias("v"))


@_query("group_by_parity", "SELECT event_id % 2 AS parity, row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) AS n, event_id FROM events")
def group_by_parity(spark, sf_dir):
    """New keys, named, then a running count beside the value."""

    def build(flow, s):
        named = s.group_by(lambda v: v % 2).stream_to("by-parity")
        counts = named.map(lambda v: F.lit(1).cast("bigint")).sum(SUM).updates().stream_to("counts")
        return counts.join(named.latest_or(0)), named

    batch, (_, named) = _run(spark, sf_dir, build)
    rows, counts = batch.lower(named), batch.stream("counts")
    both = rows.join(counts.select("key", "ord", F.col("value").alias("n")), ["key", "ord"])
    return both.select(F.col("key").alias("parity"), "n", F.col("value").alias("event_id"))


@_query("invert_index", "SELECT event_type, user_id, event_id FROM events")
def invert_index(spark, sf_dir):
    """Key user and value (type, id) become key type and value (user, id)."""
    out = _messages(spark, sf_dir, lambda _, s: s.invert(), value="struct(event_type as _1, event_id as _2)")
    return out.select(F.col("key").alias("event_type"), F.col("value._1").alias("user_id"), F.col("value._2").alias("event_id"))


@_query("merge_two", "SELECT user_id, event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_id FROM events WHERE event_id % 3 = 0")
def merge_two(spark, sf_dir):
    """A bag union of two branches of one source."""
    build = lambda flow, s: flow.merge(even=s.filter(lambda v: v % 2 == 0), third=s.filter(lambda v: v % 3 == 0))
    return _messages(spark, sf_dir, build).select(F.col("key").alias("user_id"), F.col("value").alias("event_id"))


def _running(sql: str) -> str:
    return f"SELECT user_id, event_id, CAST({sql} OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM events"


def _with_id(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("user_id"), F.col("ord")[0].alias("event_id"), F.col("value").alias("v"))


@_query("running_sum", _running("sum(event_id)"))
def running_sum(spark, sf_dir):
    """fold by a monoid: every state is emitted."""
    return _with_id(_messages(spark, sf_dir, lambda _, s: s.sum(SUM)))


@_query("running_count", _running("count(*)"))
def running_count(spark, sf_dir):
    """A running count."""
    return _with_id(_messages(spark, sf_dir, lambda _, s: s.map(lambda v: F.lit(1).cast("bigint")).sum(SUM)))


@_query("running_max", _running("max((event_id * 7919) % 1000)"))
def running_max(spark, sf_dir):
    """A running maximum with a preparation."""
    return _with_id(_messages(spark, sf_dir, lambda _, s: s.aggregate(MAX, lambda v: (v * 7919) % 1000)))


@_query("fold_opaque", _running("sum(event_id)"))
def fold_opaque(spark, sf_dir):
    """The same fold as an opaque Python function."""
    return _with_id(_messages(spark, sf_dir, lambda _, s: s.fold(0, lambda a, v: a + v, "bigint")))


@_query("averaged", "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + 1e-8, 6) AS v FROM events")
def averaged(spark, sf_dir):
    """Running means, presented rounded."""
    return _with_id(_messages(spark, sf_dir, lambda _, s: s.aggregate(AVERAGE, present=lambda v: F.round(v + 1e-8, 6)), value="value"))


@_query(
    "set_union_size",
    """SELECT event_type, event_id, sum(f) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM (
  SELECT event_type, event_id, CASE WHEN row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS f FROM events)""",
)
def set_union_size(spark, sf_dir):
    """The size of a growing set, by first occurrences."""
    out = _messages(spark, sf_dir, lambda _, s: s.distinct_count(), key="event_type", value="user_id")
    return out.select(F.col("key").alias("event_type"), F.col("ord")[0].alias("event_id"), F.col("value").alias("n"))


@_query("set_union", "SELECT event_type, string_agg(u, ',' ORDER BY u) AS users FROM (SELECT DISTINCT event_type, user_id::VARCHAR AS u FROM events) GROUP BY event_type")
def set_union(spark, sf_dir):
    """The contents of each set in the end."""
    batch, pool = _run(spark, sf_dir, lambda _, s: s.map(lambda v: F.array(v)).sum(SET_UNION), key="event_type", value="cast(user_id as string)")
    return batch.current(pool).select(F.col("key").alias("event_type"), F.array_join("value", ",").alias("users"))


@_query(
    "map_sums",
    """SELECT user_id, string_agg(concat(k, ':', s), ',' ORDER BY k) AS sums FROM (
  SELECT user_id, k, sum(v)::BIGINT AS s FROM (
    SELECT user_id, event_type AS k, event_id AS v FROM events UNION ALL SELECT user_id, concat('m', event_id % 3), 1 FROM events) GROUP BY 1, 2)
GROUP BY user_id""",
)
def map_sums(spark, sf_dir):
    """Maps summed key by key."""
    value = "map_from_arrays(array(event_type, concat('m', event_id % 3)), array(event_id, 1L))"
    batch, pool = _run(spark, sf_dir, lambda _, s: s.sum(pointwise()), value=value)
    entries = F.transform(F.array_sort(F.map_entries("value")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return batch.current(pool).select(F.col("key").alias("user_id"), F.array_join(entries, ",").alias("sums"))


@_query(
    "product_sum",
    "SELECT user_id, sum(event_id)::BIGINT AS total, max(event_id % 100) AS most, count(*) AS n FROM events GROUP BY user_id",
)
def product_sum(spark, sf_dir):
    """Three sums side by side in one aggregate."""
    triple = lambda v: F.struct(F.struct(v.alias("_1"), (v % 100).alias("_2")).alias("_1"), F.lit(1).cast("bigint").alias("_2"))
    batch, pool = _run(spark, sf_dir, lambda _, s: s.map(triple).sum(product(product(SUM, MAX), SUM)))
    v = F.col("value")
    return batch.current(pool).select(F.col("key").alias("user_id"), v["_1"]["_1"].alias("total"), v["_1"]["_2"].alias("most"), v["_2"].alias("n"))


@_query(
    "named_pool_join",
    """SELECT user_id, event_id, coalesce(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
FROM events""",
)
def named_pool_join(spark, sf_dir):
    """Each message with a named pool's value just before it."""
    out = _messages(spark, sf_dir, lambda _, s: s.join(s.sum(SUM).stream_to("totals")))
    return out.select(F.col("key").alias("user_id"), F.col("value._1").alias("event_id"), F.col("value._2").alias("before"))


@_query("latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest(spark, sf_dir):
    """Each key's present value of a stream seen as a pool."""
    batch, pool = _run(spark, sf_dir, lambda _, s: s.latest_or("none"), value="event_type")
    return batch.current(pool).select(F.col("key").alias("user_id"), F.col("value").alias("event_type"))


@_query("latest_option", "SELECT user_id, CASE WHEN event_type = 'view' THEN event_id ELSE -1 END AS v FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_option(spark, sf_dir):
    """The same with null values, which count as values."""
    batch, pool = _run(spark, sf_dir, lambda _, s: s.latest_option(), value="case when event_type = 'view' then event_id end")
    return batch.current(pool).select(F.col("key").alias("user_id"), F.coalesce("value", F.lit(-1)).alias("v"))


def _batches(cycle: int) -> str:
    return f"""SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (WHERE i < 4) AS ids FROM (
  SELECT user_id, event_id, (r // {cycle}) AS g, r % {cycle} AS i FROM (
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events))
GROUP BY user_id, g HAVING max(i) = {cycle - 1}"""


@_query("grouped_batches", _batches(5))
def grouped_batches(spark, sf_dir):
    """Batches of four; the value that finds one full is dropped."""
    out = _messages(spark, sf_dir, lambda _, s: s.grouped_by_count(4))
    return out.select(F.col("key").alias("user_id"), F.array_join("value", ",").alias("ids"))


@_query("chunked_batches", _batches(4))
def chunked_batches(spark, sf_dir):
    """Batches of four that lose nothing between them."""
    out = _messages(spark, sf_dir, lambda _, s: s.chunked(4))
    return out.select(F.col("key").alias("user_id"), F.array_join("value", ",").alias("ids"))


@_query(
    "stream_pool_join",
    """SELECT a.user_id, a.event_id, coalesce(b.event_id, -1) AS last_view FROM
  (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b
  ON a.user_id = b.user_id AND a.event_id > b.event_id""",
)
def stream_pool_join(spark, sf_dir):
    """Each purchase with the last view before it, or the default."""

    def build(_, s):
        of = lambda kind: s.filter(lambda v: v["_1"] == kind).map(lambda v: v["_2"])
        return of("purchase").join(of("view").latest_or(-1))

    out = _messages(spark, sf_dir, build, value="struct(event_type as _1, event_id as _2)")
    return out.select(F.col("key").alias("user_id"), F.col("value._1").alias("event_id"), F.col("value._2").alias("last_view"))


@_query("self_join_strict", "SELECT user_id, event_id, lag(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events")
def self_join_strict(spark, sf_dir):
    """A topic joined with itself sees what was there before the message."""
    out = _messages(spark, sf_dir, lambda _, s: s.join(s.latest_or(-1)))
    return out.select(F.col("key").alias("user_id"), F.col("value._1").alias("event_id"), F.col("value._2").alias("before"))


@_query(
    "pool_pool_join",
    """SELECT k AS user_id, o AS place, s AS side,
  coalesce(last_value(a IGNORE NULLS) OVER w, -1) AS left_value, coalesce(last_value(b IGNORE NULLS) OVER w, -2) AS right_value FROM (
  SELECT user_id AS k, event_id AS o, 0 AS s, event_id AS a, NULL AS b FROM events WHERE event_type = 'view'
  UNION ALL SELECT user_id, event_id, 1, NULL, event_id FROM events WHERE event_type = 'click')
WINDOW w AS (PARTITION BY k ORDER BY o, s ROWS UNBOUNDED PRECEDING)""",
)
def pool_pool_join(spark, sf_dir):
    """A pair for every change of either pool."""

    def build(_, s):
        of = lambda kind: s.filter(lambda v: v["_1"] == kind).map(lambda v: v["_2"])
        return of("view").latest_or(-1).join(of("click").latest_or(-2))

    out = _messages(spark, sf_dir, build, value="struct(event_type as _1, event_id as _2)")
    return out.select(
        F.col("key").alias("user_id"), F.col("ord")[0].alias("place"), F.col("ord")[1].cast("int").alias("side"), F.col("value._1").alias("left_value"), F.col("value._2").alias("right_value")
    )


@_query("updated_pairs", "SELECT user_id, lag(s, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS before, s AS after FROM (" + _running("sum(event_id)").replace(" AS v ", " AS s ") + ")")
def updated_pairs(spark, sf_dir):
    """(previous, current) of a running sum."""
    out = _messages(spark, sf_dir, lambda _, s: s.sum(SUM).updated_pairs())
    return out.select(F.col("key").alias("user_id"), F.col("value._1").alias("before"), F.col("value._2").alias("after"))


@_query("pool_map", "SELECT user_id, event_id, v * 2 + 1 AS v FROM (" + _running("sum(event_id)") + ")")
def pool_map(spark, sf_dir):
    """A pool's values mapped."""
    return _with_id(_messages(spark, sf_dir, lambda _, s: s.sum(SUM).map(lambda v: v * 2 + 1)))


_TWO_MAP = "map_from_arrays(array(event_type, concat('m', event_id % 3)), array(event_id, event_id * 2))"
_LATEST_MAPS = """SELECT user_id, unnest([t, concat('m', e % 3)]) AS k, unnest([e, e * 2]) AS v FROM (
  SELECT user_id, max(event_id) AS e, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id)"""


@_query("sum_by_key", f"SELECT k, sum(v)::BIGINT AS total FROM ({_LATEST_MAPS}) GROUP BY k")
def sum_by_key(spark, sf_dir):
    """Totals by map key over every user's newest map: older maps are taken back."""
    batch, pool = _run(spark, sf_dir, lambda _, s: s.sum_by_key("changes"), value=_TWO_MAP)
    held = F.col("value") != 0  # a total that is zero has no owner here: all numbers are positive
    return batch.current(pool).where(held).select(F.col("key").alias("k"), F.col("value").alias("total"))


@_query("latest_by_key", f"SELECT k, string_agg(concat(user_id, ':', v), ',' ORDER BY user_id::VARCHAR) AS members FROM ({_LATEST_MAPS}) GROUP BY k")
def latest_by_key(spark, sf_dir):
    """For each map key, what each user's newest map has for it."""
    batch, pool = _run(spark, sf_dir, lambda _, s: s.latest_by_key("changes"), value=_TWO_MAP)
    entries = F.transform(F.array_sort(F.map_entries("value")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    out = batch.current(pool).where(F.size("value") > 0)
    return out.select(F.col("key").alias("k"), F.array_join(entries, ",").alias("members"))


@_query(
    "process_machine",
    """SELECT user_id, event_id AS at, n FROM (
  SELECT user_id, event_id, big, count(*) FILTER (WHERE big) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM (
    SELECT user_id, event_id, event_id % 5 > 1 AS big,
      count(*) FILTER (WHERE event_id % 5 <= 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events))
WHERE big AND n >= 2""",
)
def process_machine(spark, sf_dir):
    """An alarm from combinators: how long a run of large values has lasted, from its second on."""
    count = Process(lambda n, v: (n + 1, [{"at": v, "n": n + 1}]))
    alarm = Process.on_input(lambda v: count if v % 5 > 1 else Process.set_state(0))
    loud = alarm.flat_map(lambda out: Process.output(out) if out["n"] >= 2 else Process.skip())
    out = _messages(spark, sf_dir, lambda _, s: s.process(lambda: 0, loud, "struct<at:bigint,n:bigint>"))
    return out.select(F.col("key").alias("user_id"), F.col("value.at").alias("at"), F.col("value.n").alias("n"))


@_query(
    "process_combinators",
    "SELECT user_id, event_id, unnest([0, 1]) AS i, unnest([2 * s + 1, s]) AS v FROM (" + _running("sum(event_id)").replace(" AS v ", " AS s ") + ")",
)
def process_combinators(spark, sf_dir):
    """from_aggregator, map, chain, and_then: twice a running sum and one more, then the sum itself."""
    total = Process.from_aggregator(lambda n, v: n + v, lambda n: n).map(lambda n: 2 * n)
    both = total.chain(Process.on_input(lambda v: Process.output(v + 1))).and_then(Process.on_state(lambda n: Process.output(n)))
    out = _messages(spark, sf_dir, lambda _, s: s.process(lambda: 0, both, "bigint"))
    return out.select(F.col("key").alias("user_id"), F.col("ord")[0].alias("event_id"), F.element_at("ord", -1).cast("int").alias("i"), F.col("value").alias("v"))


@_query(
    "cycle_linear",
    """WITH RECURSIVE e AS (SELECT coalesce(max(event_id), 0) + 1 AS z, (coalesce(max(event_id), 0) + 8) // 8 AS d FROM events),
c AS (SELECT user_id, event_id + d AS v FROM events, e
  UNION ALL SELECT user_id, v + d FROM c, e WHERE v < z) SELECT user_id, v FROM c""",
)
def cycle_linear(spark, sf_dir):
    """A stream that feeds itself until its values are above all ids; a step is an eighth of that."""
    end = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.coalesce(F.max("event_id"), F.lit(0)) + 1).first()[0]
    step = -(-end // 8)
    build = lambda flow, s: flow.cycle("grown", lambda me: flow.merge(new=s, again=me).filter(lambda v: v < end).map(lambda v: v + step))
    return _messages(spark, sf_dir, build).select(F.col("key").alias("user_id"), F.col("value").alias("v"))


@_query("connected_components", _COMPONENTS)
def components(spark, sf_dir):
    """The least node that each node reaches, in a graph of customers and halved order numbers."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return connected_components(orders.select(F.col("o_custkey").alias("src"), F.expr("1000000000 + o_orderkey div 2").alias("dst")))


@_query("clock_ticks", "SELECT unnest(generate_series(1704067200, 1704067200 + 86400, 3600)) AS t")
def clock_ticks(spark, sf_dir):
    """A tick every hour of a day."""
    return clock(spark, 3600, "2024-01-01 00:00:00", "2024-01-02 00:00:00").select(F.col("value").alias("t"))


@_query(
    "scheduler",
    """WITH r AS (SELECT (floor(epoch(ts))::BIGINT // 3600) * 3600 AS due, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS names FROM events GROUP BY 1),
b AS (SELECT (min(floor(epoch(ts))::BIGINT) // 3600) * 3600 AS a, max(floor(epoch(ts))::BIGINT) AS z FROM events)
SELECT t AS tick, coalesce(names, '') AS names FROM (SELECT unnest(generate_series(a, z, 3600)) AS t FROM b) LEFT JOIN r ON r.due = t""",
)
def scheduler(spark, sf_dir):
    """At each hourly tick the requests due then; all requests come before all ticks, so each tick finds the list that is current in the end."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("due", F.expr("unix_seconds(cast(ts as timestamp)) div 3600 * 3600"))
    ends = events.agg(F.min("due").alias("a"), F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("z")).first()
    flow = Flow()
    requests = flow.source("requests").map(lambda r: F.array(r)).sum(LIST, "array<bigint>")
    batch = Batch(spark, flow, {"requests": topic(events, key="due", value="event_id", order=["event_id"])})
    known = batch.current(requests).select(F.col("key").alias("tick"), F.array_join("value", ",").alias("names"))
    if ends["a"] is None:  # no events
        return known
    ticks = spark.range(ends["a"], ends["z"] + 1, 3600).select(F.col("id").alias("tick"))
    return ticks.join(known, "tick", "left").select("tick", F.coalesce("names", F.lit("")).alias("names"))


@_query(
    "linear_road",
    """WITH p AS (SELECT user_id AS car, concat(event_id % 10, '@', floor(epoch(ts))::BIGINT // 3600) AS place, event_id, value AS speed FROM events),
a AS (SELECT place, event_id, car, avg(speed) OVER (PARTITION BY place ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS mean FROM p)
SELECT place, event_id, round(mean + 1e-8, 6) AS v FROM a""",
)
def linear_road(spark, sf_dir):
    """Average speeds by place and time, from reports keyed by vehicle."""
    value = "struct(concat(event_id % 10, '@', unix_seconds(cast(ts as timestamp)) div 3600) as _1, value as _2)"
    batch = Batch(spark, jobs.linear_road(), {"position-reports": _events(spark, sf_dir, value=value)})
    out = batch.stream("average-speed")
    return out.select(F.col("key").alias("place"), F.col("ord")[0].alias("event_id"), F.round(F.col("value") + 1e-8, 6).alias("v"))


@_query(
    "linear_road_tolls",
    f"""WITH p AS (SELECT user_id AS car, event_id % 10 AS place, event_id, value AS speed FROM events),
s AS (SELECT place, count(DISTINCT car) AS n, avg(speed) AS mean FROM p GROUP BY place HAVING avg(speed) < {jobs.SLOW}),
t AS (SELECT DISTINCT p.place, car, (n - {jobs.VEHICLES}) * (n - {jobs.VEHICLES}) AS toll FROM p JOIN s ON s.place = p.place)
SELECT car, sum(toll)::BIGINT AS toll FROM t WHERE toll <> 0 GROUP BY car""",
)
def linear_road_tolls(spark, sf_dir):
    """The final toll of each vehicle that has seen a slow place."""
    flow, tolls = jobs.linear_road_tolls()
    batch = Batch(spark, flow, {"position-reports": _events(spark, sf_dir, value="struct(event_id % 10 as _1, value as _2)")})
    return batch.current(tolls).select(F.col("key").cast("bigint").alias("car"), F.col("value").alias("toll"))


@_query(
    "twitter_reach",
    """WITH f AS (SELECT event_id AS o, user_id % 40 AS u, user_id AS follower FROM events WHERE event_id % 3 <> 0),
t AS (SELECT event_id AS o, user_id % 40 AS u, concat('http://x/', event_type) AS url FROM events WHERE event_id % 3 = 0),
j AS (SELECT t.url, f.follower, min(t.o) AS o FROM t JOIN f ON f.u = t.u AND f.o < t.o GROUP BY 1, 2)
SELECT url, count(*) AS n FROM j GROUP BY url""",
)
def twitter_reach(spark, sf_dir):
    """How many users each link has reached in the end."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    followers = topic(events.where("event_id % 3 <> 0"), key="user_id % 40", value="user_id", order=["event_id"])
    tweets = topic(events.where("event_id % 3 = 0"), key="user_id % 40", value="concat('see http://x/', event_type)", order=["event_id"])
    flow, reach = jobs.twitter_reach_once()
    return Batch(spark, flow, {"followers": followers, "tweets": tweets}).current(reach).select(F.col("key").alias("url"), F.col("value").alias("n"))


@_query(
    "denormalize",
    """SELECT n_nationkey AS nation, n_name AS name, count(c_custkey) AS members, coalesce(max(c_custkey), -1) AS newest,
  coalesce(sum(length(c_name)), 0)::BIGINT AS letters FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def denormalize(spark, sf_dir):
    """Each group with its members as they are in the end."""
    flow, groups = jobs.denormalize()
    users = topic(spark.read.parquet(f"{sf_dir}/customer.parquet"), key="c_custkey", value="map(cast(c_nationkey as bigint), c_name)", order=["c_custkey"])
    nation = topic(spark.read.parquet(f"{sf_dir}/nation.parquet"), key="cast(n_nationkey as bigint)", value="n_name", order=["n_nationkey"])
    out = Batch(spark, flow, {"users": users, "groups": nation}).current(groups).where("value is not null")
    members = F.coalesce("value.members", F.create_map().cast("map<bigint,string>"))
    letters = F.aggregate(F.map_values(members), F.lit(0).cast("bigint"), lambda n, name: n + F.length(name))
    return out.select(
        F.col("key").cast("int").alias("nation"), F.col("value.name").alias("name"), F.size(members).cast("bigint").alias("members"),
        F.coalesce(F.array_max(F.map_keys(members)), F.lit(-1)).alias("newest"), letters.alias("letters"),
    )


@_query(
    "customer_transactions",
    """SELECT c_custkey AS customer, c_name AS name, count(*) AS orders, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS listed
FROM customer JOIN (SELECT DISTINCT o_custkey, o_orderkey FROM orders) ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def customer_transactions(spark, sf_dir):
    """Transactions joined with their customers' numbers, gathered by customer in order, then joined with the customers."""
    flow, known = jobs.customer_transactions()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").distinct()
    topics = {
        "transactions": topic(orders, key="o_orderkey", value="o_orderkey", order=["o_orderkey"]),
        "transaction-customers": topic(orders, key="o_orderkey", value="o_custkey", order=["o_orderkey"]),
        "customers": topic(spark.read.parquet(f"{sf_dir}/customer.parquet"), key="c_custkey", value="c_name", order=["c_custkey"]),
    }
    out = Batch(spark, flow, topics).current(known).where("value is not null and size(value.transactions) > 0")
    listed = F.col("value.transactions")
    return out.select(F.col("key").alias("customer"), F.col("value.name").alias("name"), F.size(listed).cast("bigint").alias("orders"), F.array_join(listed, ",").alias("listed"))


@_query("entity_resolution")
def entity_resolution(spark, sf_dir):
    """Parts as products: names from their numbers, categories from their brands; what merging brings about."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    value = "struct(array(concat('n', p_partkey % 17), concat('m', p_partkey % 23)) as names, p_size as price, array(p_brand) as categories)"
    products = topic(parts, key="0L", value=value, order=["p_partkey"])
    out = Batch(spark, jobs.entity_resolution(), {"products": products}).stream("resolved")
    return out.select(F.col("key").alias("category"), F.array_join("value.names", ",").alias("names"), F.col("value.price").alias("price"))


@_query(
    "revenue_by_priority",
    """SELECT o_orderpriority AS priority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1""",
)
def revenue_by_priority(spark, sf_dir):
    """A final monoid sum after a batch join; filter and columns reach the scan."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_shipdate >= timestamp'1995-01-01'")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    joined = lines.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = joined.groupBy(F.col("o_orderpriority").alias("priority")).agg(SUM_DOUBLE.final(F.col("v")).alias("revenue"), F.count("*").alias("n"))
    return out.withColumn("revenue", F.round("revenue", 2))
