"""Batch plans against the interpreter, SQL, and streaming runs."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.examples import jobs
from millrace.functions.monoids import AVERAGE, LIST, MAX, MIN, SUM
from millrace.operators.components import connected_components
from millrace.operators.flow import Flow
from millrace.plans.batch import Batch
from millrace.plans.interp import Machine
from millrace.sources.topics import file_topic, kafka_rows, memory_topic, place_of, publish
from millrace.streaming.runner import Streaming, file_stream

SF = "/root/testdata/sf0.001"


def plain(x):
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    return [plain(v) for v in x] if isinstance(x, list) else x


def replayed(spark, flow, name, messages, schema="key string, value bigint", topic="ints"):
    rows = Batch(spark, flow, {topic: memory_topic(spark, messages, schema)}).stream(name).orderBy("ord").collect()
    out = {}
    for r in rows:
        out.setdefault(r["key"], []).append(plain(r["value"]))
    return out


def interpreted(flow, name, messages, topic="ints"):
    machine = Machine(flow)
    for k, v in messages:
        machine.push(topic, k, v)
    out = {}
    for k, v in machine.run()[name]:
        out.setdefault(k, []).append(v)
    return out


BUILDS = {
    "sum": lambda s: s.sum(SUM).updates(),
    "max": lambda s: s.sum(MAX).updates(),
    "min": lambda s: s.sum(MIN).updates(),
    "average": lambda s: s.aggregate(AVERAGE).updates(),
    "fold": lambda s: s.fold(1, lambda a, v: a * 2 + v, "bigint").updates(),
    "distinct": lambda s: s.distinct_count().updates(),
    "batches": lambda s: s.grouped_by_count(2),
    "chunks": lambda s: s.chunked(3),
    "pairs": lambda s: s.sum(SUM).updated_pairs(),
    "join": lambda s: s.join(s.sum(SUM)),
    "pools": lambda s: s.sum(SUM).join(s.latest_or(-1, "bigint")).updates(),
    "keyed": lambda s: s.with_keys.transform(lambda: 0, lambda k, n, v: (n + 1, [n, v] if k == "a" else [v]), "bigint"),
}


@pytest.mark.parametrize("name", BUILDS)
def test_plan_equals_interpreter(spark, name):
    rng = random.Random(name)
    messages = [(rng.choice("abc"), rng.randint(-4, 4)) for _ in range(40)]
    flow = Flow()
    flow.stream("out", BUILDS[name](flow.source("ints")))
    ours, theirs = replayed(spark, flow, "out", messages), interpreted(flow, "out", messages)
    if name in ("join", "pools"):  # one topic feeds both sides: the plan fixes one of the legal orders
        assert {k: len(v) for k, v in ours.items()} == {k: len(v) for k, v in theirs.items()}
    else:
        assert ours == theirs


def test_null_pool_values_count(spark):
    flow = Flow()
    s = flow.source("ints")
    side = lambda k: s.filter(lambda v: v["s"] == k).map(lambda v: v["x"])
    flow.stream("out", side(0).join(side(1).latest_or(7)))
    messages = [("k", {"s": 0, "x": 1}), ("k", {"s": 1, "x": None}), ("k", {"s": 0, "x": 2})]
    got = replayed(spark, flow, "out", messages, "key string, value struct<s:int,x:int>")
    assert got == {"k": [{"_1": 1, "_2": 7}, {"_1": 2, "_2": None}]}


def test_current_of_a_monoid_is_a_partial_aggregate(spark):
    flow = Flow()
    pool = flow.source("ints").sum(SUM)
    df = Batch(spark, flow, {"ints": memory_topic(spark, [("a", 1), ("a", 2)], "key string, value bigint")}).current(pool)
    plan = df._jdf.queryExecution().toString()
    assert "partial_sum" in plan and "Window" not in plan
    assert [tuple(r) for r in df.collect()] == [("a", 3)]


def test_empty_topics(spark):
    for build in BUILDS.values():
        flow = Flow()
        flow.stream("out", build(flow.source("ints")))
        assert replayed(spark, flow, "out", []) == {}


def test_twitter_reach_and_scheduler(spark):
    followers = memory_topic(spark, [("u", "f1"), ("u", "f2"), ("w", "f2")], "key string, value string")
    tweets = memory_topic(spark, [("x", "-")] * 3 + [("u", "a http://l b"), ("w", "http://l"), ("z", "http://m")], "key string, value string")
    out = Batch(spark, jobs.twitter_reach(), {"followers": followers, "tweets": tweets}).stream("reach")
    assert sorted((r["key"], r["value"]) for r in out.collect()) == [("http://l", 1), ("http://l", 2), ("http://l", 2)]


def test_reach_in_the_end_is_that_of_the_changelog(spark):
    rng = random.Random(3)
    rows = [(rng.choice("uvw"), rng.choice([1, 2, 3, "see http://a", "http://b http://a"]), i) for i in range(40)]
    topics = {}
    for name, kind in (("followers", int), ("tweets", str)):
        df = spark.createDataFrame([r for r in rows if isinstance(r[1], kind)], f"key string, value {'bigint' if kind is int else 'string'}, n bigint")
        topics[name] = df.select("key", "value", F.array("n").alias("ord"))
    flow, reach = jobs.twitter_reach_once()
    flow.stream("reach", reach.updates())
    batch = Batch(spark, flow, topics)
    last = {r["key"]: r["value"] for r in batch.stream("reach").orderBy("ord").collect()}
    assert last and {r["key"]: r["value"] for r in batch.current(reach).collect()} == last


def test_cycles(spark):
    flow = Flow()
    flow.cycle("out", lambda me: flow.merge(a=flow.source("ints"), b=me).filter(lambda v: v < 20).map(lambda v: v + 2))
    messages = [("k", 1), ("k", 15)]
    assert sorted(replayed(spark, flow, "out", messages)["k"]) == sorted(interpreted(flow, "out", messages)["k"])
    products = [(0, {"names": ["a", "b"], "price": 3, "categories": ["e"]}), (0, {"names": ["b"], "price": 1, "categories": ["e", "f"]})]
    got = replayed(spark, jobs.entity_resolution(), "resolved", products, f"key bigint, value {jobs.PRODUCT}", "products")
    assert {"names": ["a", "b"], "price": 1, "categories": ["e", "f"]} in got["e"]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100), (None, 3)] + [(200 + i, 201 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    label = {n: n for e in edges if None not in e for n in e}
    for _ in label:
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_no_task_gathers_the_edges_of_a_hub(spark):
    leaves = 80_000
    ids = spark.range(leaves).select(F.format_string("m%06d", "id").alias("leaf"))
    least, greatest = ids.select(F.lit("a").alias("src"), F.col("leaf").alias("dst")), ids.select(F.lit("z").alias("src"), F.concat(F.lit("n"), "leaf").alias("dst"))
    context, group = spark.sparkContext, "edges of a hub"
    as_large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # larger tables are not broadcast
    before = {k: spark.conf.get(k) for k in as_large}
    for k, v in as_large.items():
        spark.conf.set(k, v)
    context.setJobGroup(group, group)
    try:
        found = connected_components(least.union(greatest)).groupBy("component").count().collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, found)) == [("a", leaves + 1), ("nm000000", leaves + 1)]
    store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
    stages = {k for job in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(job).stageIds}
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    read = []
    for k in stages:
        tasks = store.taskList(k, 0, 1000)
        read += [t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in map(tasks.apply, range(tasks.size())) if t.taskMetrics().isDefined()]
    assert leaves / 4 < max(read) < leaves


def test_topics_in_files(spark, tmp_path):
    df = memory_topic(spark, [("a", 1), ("b", 2)], "key string, value bigint")
    publish(df, str(tmp_path / "t"))
    back = file_topic(spark, str(tmp_path / "t"), key="key", value="value", order=["value"])
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1, [1]), ("b", 2, [2])]
    df.select("key", "value").write.json(str(tmp_path / "j"))
    assert file_topic(spark, str(tmp_path / "j"), format="json", schema="key string, value bigint", key="key", value="value", order=["value"]).count() == 2
    # "hello".hashCode() is 99162322
    assert spark.range(1).select(place_of(F.lit("hello"), 7)).first()[0] == 99162322 % 7


NAMES = sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    expected = con.sql(__spark_entry__.oracle_sql()[name])
    df = __spark_entry__.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(expected.columns)
    order = sorted(df.columns)
    theirs = sorted(expected.select(*order).fetchall(), key=repr)
    assert sorted((tuple(r) for r in df.select(*order).collect()), key=repr) == theirs


def test_flagship_and_every_query_has_a_function(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def batches(spark, folder, messages):
    """A file for each message, in order of modification times."""
    for i, (k, v) in enumerate(messages):
        part = folder / f"{i}.parquet"
        import pyarrow as pa
        import pyarrow.parquet as pq

        pq.write_table(pa.table({"key": pa.array(k, pa.string()), "value": pa.array(v, pa.int64()), "ord": pa.array([[i, j] for j in range(len(k))], pa.list_(pa.int64()))}), part)
        os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))


def test_streaming_equals_replay_over_a_restart(spark, tmp_path):
    messages = [(["a", "b", "a"], [1, 2, 3]), (["b", "a"], [4, 5]), (["a", "c"], [6, 7])]
    flow = Flow()
    flow.source("ints").map(lambda v: v * 2).sum(SUM).updates().sink_to("out")
    (tmp_path / "in").mkdir()
    schema = "key string, value bigint, ord array<bigint>"

    def go():
        topics = {"ints": file_stream(spark, str(tmp_path / "in"), schema)}
        query = Streaming(spark, flow, topics).start("out", str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()

    batches(spark, tmp_path / "in", messages[:2])
    go()
    batches(spark, tmp_path / "in", messages)
    os.utime(tmp_path / "in" / "0.parquet", (1_700_000_000, 1_700_000_000))
    go()  # a second run of the same checkpoint: old files are not read again
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("key", "value").collect())
    listed = [(k, v) for ks, vs in messages for k, v in zip(ks, vs)]
    expected = sorted((k, v) for k, vs in replayed(spark, flow, "out", listed).items() for v in vs)
    assert got == expected


def test_streaming_lookup(spark, tmp_path):
    flow = Flow()
    s = flow.source("ints")
    flow.sink("out", s.filter(lambda v: v > 0).join(s.filter(lambda v: v < 0).latest_or(0)))
    (tmp_path / "in").mkdir()
    batches(spark, tmp_path / "in", [(["a", "a", "a"], [1, -5, 2])])
    seen = []
    topics = {"ints": file_stream(spark, str(tmp_path / "in"), "key string, value bigint, ord array<bigint>")}
    query = Streaming(spark, flow, topics).start_each("out", lambda df, n: seen.extend(tuple(r["value"]) for r in df.orderBy("ord").collect()), str(tmp_path / "check"))
    query.awaitTermination()
    assert seen == [(1, 0), (2, -5)]


def whole_tables(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_components_of_all_orders(spark, tmp_path):
    rng = random.Random(7)
    rows = [(7 * i + 1 + i % 6, rng.randint(1, 60)) for i in range(80)]  # no key is a multiple of 7
    folder = whole_tables(spark, tmp_path, orders=([(k, c, "5-LOW") for k, c in rows], "o_orderkey long, o_custkey long, o_orderpriority string"))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for key, customer in rows:
        a, b = sorted((root(customer), root(1000000000 + key // 2)))
        parent[b] = a
    found = __spark_entry__.queries()["connected_components"](spark, folder).collect()
    assert {r["node"]: r["component"] for r in found} == {x: root(x) for x in parent} and len(found) == len(parent)


def test_no_query_stops_at_a_fixed_id(spark, tmp_path):
    rng = random.Random(8)
    parts = [(k, 1 + k % 50, f"Brand#{k % 3}") for k in range(1, 241)]
    orders = [(k, rng.randint(1, 9)) for k in range(3990, 4060)]
    events = [(k, k % 5, f"2024-01-01 {k % 7:02d}:10:00") for k in [*range(195, 230), *range(7990, 8030)]]
    folder = whole_tables(
        spark, tmp_path,
        part=(parts, "p_partkey long, p_size int, p_brand string"),
        orders=(orders, "o_orderkey long, o_custkey long"),
        customer=([(c, f"C{c}") for c in range(1, 9)], "c_custkey long, c_name string"),
        events=(events, "event_id long, user_id long, ts string"),
    )
    run = lambda name: [tuple(r) for r in __spark_entry__.queries()[name](spark, folder).collect()]

    listed = {c: sorted(k for k, d in orders if d == c) for c in range(1, 9)}
    assert sorted(run("customer_transactions")) == [(c, f"C{c}", len(v), ",".join(map(str, v))) for c, v in listed.items() if v]

    ticks = run("scheduler")
    assert sorted(int(x) for _, names in ticks for x in names.split(",") if x) == sorted(k for k, _, _ in events)
    assert all(int(x) % 7 == tick % 86400 // 3600 for tick, names in ticks for x in names.split(",") if x)

    end, step, grown = 8030, 1004, []
    for k, user, _ in events:
        while k < end:
            k += step
            grown.append((user, k))
    assert sorted(run("cycle_linear")) == sorted(grown)

    known = {}
    for k, size, brand in parts:
        known[brand], _ = jobs.swoosh(known.get(brand, []), {"names": [f"n{k % 17}", f"m{k % 23}"], "price": size, "categories": [brand]})
    last = {(b, ",".join(p["names"]), p["price"]) for b, found in known.items() for p in found}
    assert last <= set(run("entity_resolution"))


def test_present_values_equal_the_last_of_the_changelog(spark):
    rng = random.Random(12)
    maps = [(rng.choice("abc"), {x: rng.randint(0, 3) for x in rng.sample("wxyz", rng.randint(0, 3))}) for _ in range(30)]
    schema = "key string, value map<string,bigint>"
    for build in (lambda s: s.sum_by_key("changes"), lambda s: s.latest_by_key("changes")):
        flow = Flow()
        pool = build(flow.source("ints"))
        flow.stream("out", pool.updates())
        last = {k: v[-1] for k, v in interpreted(flow, "out", maps).items()}
        got = Batch(spark, flow, {"ints": memory_topic(spark, maps, schema)}).current(pool).collect()
        assert {r["key"]: r["value"] for r in got} == last
    ints = [(rng.choice("ab"), rng.randint(0, 9)) for _ in range(12)]
    flow = Flow()
    s = flow.source("ints")
    pool = s.filter(lambda v: v > 4).sum(SUM).map(lambda v: v + 1).join(s.latest_or(-1, "bigint"))
    flow.stream("out", pool.updates())
    batch = Batch(spark, flow, {"ints": memory_topic(spark, ints, "key string, value bigint")})
    last = {r["key"]: plain(r["value"]) for r in batch.stream("out").orderBy("ord").collect()}
    assert {r["key"]: plain(r["value"]) for r in batch.current(pool).collect()} == last


def test_maps_reach_python_machines_as_dictionaries(spark):
    flow = Flow()
    flow.stream("out", flow.source("ints").transform(lambda: 0, lambda n, v: (n, [f"{type(v).__name__} {v}"]), "string"))
    messages = [("a", {}), ("a", {"x": 1}), ("b", None)]
    assert replayed(spark, flow, "out", messages, "key string, value map<string,bigint>") == {"a": ["dict {}", "dict {'x': 1}"], "b": ["NoneType None"]}


def test_replay_cycles_settle_with_nulls(spark):
    flow = Flow()
    flow.cycle("out", lambda me: flow.merge(a=flow.source("ints"), b=me).transform(lambda: 0, lambda n, v: (n, [v]), "bigint"), mode="replay")
    assert replayed(spark, flow, "out", [("k", None), ("k", 1)]) == {"k": [None, 1]}


def test_components_as_a_replayed_cycle(spark):
    edges = [(1, 2), (2, 3), (5, 6), (9, 9)]
    got = replayed(spark, jobs.connected_components(), "labels", edges, "key bigint, value bigint", "edges")
    assert {k: min(k, *v) for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}


def test_streaming_cycle(spark, tmp_path):
    flow = Flow()
    flow.cycle("out", lambda me: flow.merge(a=flow.source("ints"), b=me).filter(lambda v: v < 20).map(lambda v: v + 7))
    (tmp_path / "in").mkdir()
    messages = [(["a", "b"], [1, 15]), (["a"], [30])]
    batches(spark, tmp_path / "in", messages)
    topics = {"ints": file_stream(spark, str(tmp_path / "in"), "key string, value bigint, ord array<bigint>")}
    Streaming(spark, flow, topics).start_cycle("out", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted((r["key"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 8), ("a", 15), ("a", 22), ("b", 22)]


def test_messages_for_a_broker(spark):
    df = memory_topic(spark, [(1, {"x": 2})], "key bigint, value struct<x:int>")
    assert [tuple(r) for r in kafka_rows(df).collect()] == [("1", '{"x":2}')]


def test_command_line_runs_batch_and_stream(spark, tmp_path):
    from millrace.cli import main

    publish(memory_topic(spark, [("-", "a b a")], "key string, value string"), str(tmp_path / "in"))
    topic = ["--topic", f"sentences={tmp_path / 'in'}"]
    flow = "millrace.examples.jobs:word_count"
    assert main(["run", flow, *topic, "--out", str(tmp_path / "batch")]) == 0
    assert main(["run", flow, *topic, "--stream", "--out", str(tmp_path / "stream"), "--checkpoint", str(tmp_path / "check")]) == 0
    for kind in ("batch", "stream"):
        rows = spark.read.parquet(str(tmp_path / kind / "word-counts")).collect()
        assert sorted((r["key"], r["value"]) for r in rows) == [("a", 1), ("a", 2), ("b", 1)]
