"""Building, naming, drawing, and the interpreter's laws."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions.monoids import AVERAGE, SET_UNION, SUM, pointwise, product
from millrace.functions.process import Process
from millrace.functions.text import split_words_py
from millrace.examples import jobs
from millrace.operators.flow import Flow, NotGroupedError, Topic
from millrace.plans.interp import Machine
from millrace.plans.viz import describe, dot

INPUTS = st.dictionaries(st.sampled_from("abc"), st.lists(st.integers(-50, 50), max_size=6), max_size=3)


def outputs(flow, name, messages, seed, topic="ints"):
    machine = Machine(flow, seed)
    for key, values in messages.items():
        for v in values:
            machine.push(topic, key, v)
    out = {}
    for k, v in machine.run()[name]:
        out.setdefault(k, []).append(v)
    return out


def bound(build):
    flow = Flow()
    flow.stream("out", build(flow, flow.source("ints")))
    return flow


def test_names_are_bound_once_and_sinks_need_groups():
    flow = Flow()
    s = flow.source("ints")
    s.stream_to("x")
    with pytest.raises(ValueError):
        s.stream_to("x")
    with pytest.raises(NotGroupedError):
        s.group_by(lambda v: v % 2).sum(SUM)
    with pytest.raises(NotGroupedError):
        s.group_by(lambda v: v % 2).sink_to("y")
    with pytest.raises(ValueError):
        flow.merge_pairs(("a", s), ("a", s))
    s.group_by(lambda v: v % 2).stream_to("z").sum(SUM).updates().sink_to("y")
    with pytest.raises(ValueError):
        flow.include(flow)


@settings(max_examples=40, deadline=None)
@given(INPUTS, st.integers(0, 10**6))
def test_fold_emits_every_state(messages, seed):
    flow = bound(lambda _, s: s.fold(0, lambda a, v: a + v, "bigint").updates())
    expected = {k: [sum(vs[: i + 1]) for i in range(len(vs))] for k, vs in messages.items() if vs}
    assert outputs(flow, "out", messages, seed) == expected


@settings(max_examples=40, deadline=None)
@given(INPUTS, st.integers(0, 10**6))
def test_map_and_flat_map_laws(messages, seed):
    twice = bound(lambda _, s: s.map(lambda v: v + 1).map(lambda v: v * 2))
    once = bound(lambda _, s: s.map(lambda v: (v + 1) * 2))
    assert outputs(twice, "out", messages, seed) == outputs(once, "out", messages, seed + 1)
    unit = bound(lambda _, s: s.flat_map(lambda v: [v]))
    assert outputs(unit, "out", messages, seed) == {k: v for k, v in messages.items() if v}


@settings(max_examples=40, deadline=None)
@given(INPUTS, st.integers(0, 10**6))
def test_merge_and_group_by_keep_the_bag(messages, seed):
    both = bound(lambda f, s: f.merge(a=s, b=s.map(lambda v: v + 100)))
    got = outputs(both, "out", messages, seed)
    for k, values in messages.items():
        assert sorted(got.get(k, [])) == sorted(values + [v + 100 for v in values])
    parity = bound(lambda _, s: s.group_by(lambda v: v % 2))
    got = outputs(parity, "out", messages, seed)
    everything = [v for vs in messages.values() for v in vs]
    assert {k: sorted(v) for k, v in got.items()} == {p: sorted(v for v in everything if v % 2 == p) for p in {v % 2 for v in everything}}


def test_grouped_drops_the_value_that_finds_a_batch_full():
    messages = {"k": list(range(1, 9))}
    assert outputs(bound(lambda _, s: s.grouped_by_count(2)), "out", messages, 1) == {"k": [[1, 2], [4, 5]]}
    assert outputs(bound(lambda _, s: s.chunked(2)), "out", messages, 1) == {"k": [[1, 2], [3, 4], [5, 6], [7, 8]]}


def test_updated_pairs_and_pool_map():
    flow = bound(lambda _, s: s.sum(SUM).map(lambda v: v * 10).updated_pairs())
    assert outputs(flow, "out", {"k": [1, 2]}, 0) == {"k": [{"_1": 0, "_2": 10}, {"_1": 10, "_2": 30}]}


def test_sum_by_key_takes_back_old_maps():
    flow = Flow()
    flow.source("maps").sum_by_key("changes").updates().sink_to("totals")
    machine = Machine(flow, 3)
    for key, value in [("a", {"x": 1, "y": 2}), ("b", {"x": 5}), ("a", {"x": 3}), ("b", {})]:
        machine.push("maps", key, value)
    last = dict(machine.run()["totals"])
    assert last == {"x": 3, "y": 0}


def test_latest_by_key_removes_what_vanished():
    flow = Flow()
    flow.source("maps").latest_by_key("changes").updates().sink_to("index")
    machine = Machine(flow, 5)
    for key, value in [("a", {"x": 1, "y": 2}), ("b", {"x": 5}), ("a", {"x": 3})]:
        machine.push("maps", key, value)
    assert dict(machine.run()["index"]) == {"x": {"a": 3, "b": 5}, "y": {}}


def test_process_combinators():
    tick = Process(lambda n, v: (n + 1, [v]))
    assert tick.map(lambda v: v * 2)(0, 5) == (1, [10])
    assert tick.and_then(tick)(0, 5) == (2, [5, 5])
    assert tick.chain(tick)(0, 5) == (2, [5])
    assert tick.flat_map(lambda b: Process(lambda n, v: (n + 10, [(b, v)])))(0, 5) == (11, [(5, 5)])
    assert Process.skip()(3, 1) == (3, [])
    assert Process.output(1, 2)(3, 0) == (3, [1, 2])
    assert Process.output_each(iter([7]))(3, 0) == (3, [7])
    assert Process.on_state(lambda n: Process.set_state(n * 2))(3, 0) == (6, [])
    assert Process.on_input(lambda v: Process.output(v))(3, 9) == (3, [9])
    assert Process.from_aggregator(lambda s, v: s + v, str)(1, 2) == (3, ["3"])


def test_words_split_as_documented():
    assert [split_words_py(t) for t in ("", " ", "x  y", " x y", "x ")] == [[""], [], ["x", "y"], ["", "x", "y"], ["x"]]


def test_linear_cycle():
    flow = Flow()
    flow.cycle("out", lambda me: flow.merge(a=flow.source("ints"), b=me).filter(lambda v: v < 20).map(lambda v: v + 2))
    assert sorted(outputs(flow, "out", {"k": [1, 15]}, 2)["k"]) == [3, 5, 7, 9, 11, 13, 15, 17, 17, 19, 19, 21, 21]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("uvwxyz"), min_size=1, max_size=3), st.integers(1, 9), st.lists(st.sampled_from("pq"), min_size=1, max_size=2)), max_size=6), st.integers(0, 999))
def test_entity_resolution_equals_sequential_merging(products, seed):
    listed = [{"names": sorted(set(n)), "price": p, "categories": sorted(set(c))} for n, p, c in products]
    machine = Machine(jobs.entity_resolution(), seed)
    for p in listed:
        machine.push("products", 0, p)
    made = [v for _, v in machine.run(100_000)["resolved"]]
    whole = []
    for p in listed:
        whole, _ = jobs.swoosh(whole, p)
        settled = False
        while not settled:  # a merge may make older ones match
            settled = True
            for x in list(whole):
                rest = [y for y in whole if y is not x]
                if any(jobs.matches(x, y) for y in rest):
                    whole, _ = jobs.swoosh(rest, x)
                    settled = False
                    break
    for p in whole:
        assert p in made


def test_drawing_and_summary():
    text = dot(jobs.word_count())
    assert text.startswith("digraph") and text.count("subgraph") == 2 and '"n_words" -> ' in text
    jobs_ = describe(jobs.word_count())
    assert [j["name"] for j in jobs_] == ["words", "word-counts"]
    assert jobs_[0]["regrouped"] and not jobs_[1]["regrouped"]
    assert jobs_[1]["stores"] == ["word-counts"] and jobs_[1]["published"]


def test_command_line(capsys, tmp_path):
    from millrace.cli import main

    assert main(["info", "millrace.examples.jobs:twitter_reach"]) == 0
    assert "reads" in capsys.readouterr().out
    assert main(["gen-config", "millrace.examples.jobs:word_count", "--out", str(tmp_path / "x.json")]) == 0
    assert "regrouped" in (tmp_path / "x.json").read_text()


def test_product_and_pointwise_sums():
    both = bound(lambda _, s: s.map(lambda v: {"_1": [str(v)], "_2": v}).sum(product(SET_UNION, AVERAGE)).updates())
    assert outputs(both, "out", {"k": [2, 4, 2]}, 0)["k"][-1] == {"_1": ["2", "4"], "_2": 8 / 3}
    maps = bound(lambda _, s: s.map(lambda v: {"x": v, str(v): 1}).sum(pointwise()).updates())
    assert outputs(maps, "out", {"k": [2, 4]}, 0)["k"][-1] == {"x": 6, "2": 1, "4": 1}


def test_clocks_tick_in_the_interpreter():
    machine = Machine(jobs.scheduler(60), 1)
    machine.push("requests", 120, "b")
    machine.push("requests", 120, "a")
    machine.run()
    for second in range(0, 200, 10):
        machine.tick(second)
    assert dict(machine.run()["triggered"]) == {0: [], 60: [], 120: ["b", "a"], 180: []}


def test_a_topic_is_a_source():
    flow = Flow()
    Topic("ints").as_source(flow).sink_to("out")
    assert outputs(flow, "out", {"k": [1]}, 0) == {"k": [1]}


def test_batches_need_a_positive_size():
    for size in (0, -1):
        with pytest.raises(ValueError):
            bound(lambda _, s: s.grouped_by_count(size))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14), st.integers(0, 999))
def test_components_as_a_cycle(edges, seed):
    machine = Machine(jobs.connected_components(), seed)
    for a, b in edges:
        machine.push("edges", a, b)
    label = {}
    for node, offer in machine.run()["labels"]:
        label[node] = min(offer, label.get(node, node))
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert {n: label.get(n, n) for n in least} == least


def test_tolls_of_slow_places_only():
    flow, tolls = jobs.linear_road_tolls()
    flow.stream("tolls", tolls.updates())
    machine = Machine(flow, 2)
    for car, place, speed in [(1, "slow", 10.0), (2, "fast", 90.0), (3, "slow", 20.0)]:
        machine.push("position-reports", car, {"_1": place, "_2": speed})
    assert dict(machine.run()["tolls"]) == {"1": (2 - 150) ** 2, "3": (2 - 150) ** 2}


def test_groups_are_unknown_until_named():
    flow, groups = jobs.denormalize()
    flow.stream("groups-with-members", groups.updates())
    machine = Machine(flow, 4)
    for user, map_ in [(1, {7: "Ann"}), (2, {7: "Bob", 8: "Bob"})]:
        machine.push("users", user, map_)
    assert all(v is None for _, v in machine.run()["groups-with-members"])
    machine.push("groups", 7, "staff")
    assert machine.run()["groups-with-members"][-1] == (7, {"name": "staff", "members": {1: "Ann", 2: "Bob"}})


def test_transactions_reach_known_customers():
    flow, known = jobs.customer_transactions()
    flow.stream("out", known.updates())
    machine = Machine(flow, 6)
    for topic, key, value in [("transactions", 1, 10), ("transaction-customers", 1, 5), ("transaction-customers", 2, 5), ("customers", 5, "Eve"), ("transactions", 2, 20)]:
        machine.push(topic, key, value)
        machine.run()
    assert machine.outputs["out"][-1] == (5, {"name": "Eve", "transactions": [10, 20]})


def test_pools_can_be_named():
    flow = Flow()
    total = flow.source("ints").sum(SUM).stream_to("total")
    flow.stream("out", flow.source("ints").join(total))
    assert len(outputs(flow, "out", {"k": [1, 2]}, 3)["k"]) == 2


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("uv"), st.one_of(st.integers(0, 4), st.sampled_from(["http://a", "see http://b now"]))), max_size=25))
def test_showing_links_once_reaches_the_same_users(messages):
    flow, reach = jobs.twitter_reach_once()
    flow.stream("reach", reach.updates())
    once, always = Machine(flow), Machine(jobs.twitter_reach())
    for user, x in messages:
        for machine in (once, always):
            machine.push("followers" if isinstance(x, int) else "tweets", user, x)
            machine.run()
    assert dict(once.outputs["reach"]) == dict(always.outputs["reach"])
