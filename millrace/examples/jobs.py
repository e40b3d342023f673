"""The example jobs as flows; topics are named in each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.monoids import AVERAGE, LIST, SET_UNION, SUM, product
from ..functions.text import split_words, split_words_py
from ..operators.flow import Flow, Pool


def word_count() -> Flow:
    """``sentences`` (text) to ``word-counts``: every new count of each word."""
    flow = Flow()
    words = flow.source("sentences").flat_map(split_words, split_words_py)
    pairs = words.map(lambda w: F.struct(w.alias("_1"), F.lit(1).cast("bigint").alias("_2")), lambda w: {"_1": w, "_2": 1})
    pairs.group_by_key().stream_to("words").sum(SUM).updates().sink_to("word-counts")
    return flow


def twitter_reach() -> Flow:
    """``followers`` (user: follower) and ``tweets`` (user: text) to ``reach``: how many users have seen a link.

    A user's followers are an array that grows; a link's audience is counted by the first
    time that each follower sees it.
    """
    flow = Flow()
    followers = flow.source("followers").map(lambda f: F.array(f), lambda f: [f]).sum(LIST)
    links = flow.source("tweets").flat_map(lambda t: F.filter(split_words(t), lambda w: w.startswith("http")), lambda t: [w for w in split_words_py(t) if w.startswith("http")])
    seen = links.join(followers).map(lambda v: F.struct(v["_1"].alias("_1"), v["_2"].alias("_2")), lambda v: v)
    by_link = seen.group_by_key().flat_map(lambda fs: fs).stream_to("followers-by-link")
    by_link.distinct_count().updates().sink_to("reach")
    return flow


def twitter_reach_once(follower_type: str = "bigint") -> tuple[Flow, Pool]:
    """The same audience, but a user shows a link to each of their followers once, so nothing grows with repeated tweets."""
    flow = Flow()
    pair = lambda f, u: F.struct(f.cast(follower_type).alias("follower"), u.cast("string").alias("url"))
    people = flow.source("followers").map(lambda f: pair(f, F.lit(None)), lambda f: {"follower": f, "url": None})
    links = flow.source("tweets").flat_map(lambda t: F.filter(split_words(t), lambda w: w.startswith("http")), lambda t: [w for w in split_words_py(t) if w.startswith("http")])
    shown = links.map(lambda u: pair(F.lit(None), u), lambda u: {"follower": None, "url": u})

    def show(state, message):
        known, told = state
        if message["url"] is None:
            known.append(message["follower"])  # the list is this key's own
            return (known, told), []
        new = known[told.get(message["url"], 0) :]
        return (known, {**told, message["url"]: len(known)}), [{"_1": message["url"], "_2": f} for f in new]

    met = flow.merge(followers=people, links=shown).transform(lambda: ([], {}), show, f"struct<_1:string,_2:{follower_type}>")
    reach = met.group_by_key().stream_to("followers-by-link").distinct_count()

    def final(lower):
        """In the end a link has reached the followers that were known when it was last shown."""
        known = lower(people.node).groupBy("key", "value.follower").agg(F.min("ord").alias("known"))
        last = lower(shown.node).groupBy("key", "value.url").agg(F.max("ord").alias("last"))
        met = last.join(known, "key").where("known <= last")
        return met.groupBy(F.col("url").alias("key")).agg(F.countDistinct("follower").alias("value"))

    reach.final = final
    return flow, reach


def linear_road() -> Flow:
    """``position-reports`` (vehicle: (place and time, speed)) to ``average-speed`` by place and time."""
    flow = Flow()
    reports = flow.source("position-reports").invert().stream_to("reports-by-place")
    reports.aggregate(AVERAGE, lambda v: v["_2"], type="double").updates().sink_to("average-speed")
    return flow


#: A place whose mean speed is below this charges tolls; the toll grows with the vehicles over or under the number.
SLOW, VEHICLES = 40, 150


def linear_road_tolls(flow: Flow | None = None) -> tuple[Flow, Pool]:
    """``position-reports`` (vehicle: (place, speed)) to the pool of each vehicle's toll.

    Of each place the vehicles and the mean speed are kept; a slow one asks the same toll of
    every vehicle that it has seen.
    """
    flow = flow or Flow()
    reports = flow.source("position-reports").invert().stream_to("vehicles-by-place")
    pair = lambda v: F.struct(F.array(v["_1"].cast("string")).alias("_1"), v["_2"].alias("_2"))
    seen = reports.map(pair, lambda v: {"_1": [str(v["_1"])], "_2": v["_2"]}).aggregate(product(SET_UNION, AVERAGE))

    def tolls(s):
        size = F.size(s["_1"]).cast("bigint")
        toll = (size - VEHICLES) * (size - VEHICLES)
        listed = F.map_from_arrays(s["_1"], F.array_repeat(toll, F.size(s["_1"])))
        return F.when(s["_2"] < SLOW, listed).otherwise(F.create_map().cast("map<string,bigint>"))

    def tolls_py(s):
        return {v: (len(s["_1"]) - VEHICLES) ** 2 for v in s["_1"]} if s["_2"] is not None and s["_2"] < SLOW else {}

    maps = seen.map(tolls, tolls_py, initial={}, type="map<string,bigint>")
    return flow, maps.updates().sum_by_key("summaries")


def denormalize() -> tuple[Flow, Pool]:
    """``users`` (user: map from group to name) and ``groups`` (group: its name) to a pool of groups with their members.

    A group that is not known yet is null, whoever its members are.
    """
    flow = Flow()
    members = flow.source("users").latest_by_key("users-changes", type="string", key_type="bigint", owner_type="bigint")
    both = flow.source("groups").latest_option("string").join(members)
    known = lambda v: F.when(v["_1"].isNotNull(), F.struct(v["_1"].alias("name"), v["_2"].alias("members")))
    known_py = lambda v: None if v["_1"] is None else {"name": v["_1"], "members": v["_2"]}
    return flow, both.map(known, known_py, type="struct<name:string,members:map<bigint,string>>")


def customer_transactions() -> tuple[Flow, Pool]:
    """``transactions`` and ``transaction-customers`` (both by transaction) and ``customers`` to a pool of (customer, transactions).

    A transaction and its customer are joined, whichever comes first; each change of either
    appends the transaction to its customer's again.  Null until the customer is known.
    """
    flow = Flow()
    bought = flow.source("transactions").latest_option("bigint").join(flow.source("transaction-customers").latest_option("bigint"))
    whole = bought.updates().filter(lambda v: v["_1"].isNotNull() & v["_2"].isNotNull(), lambda v: v["_1"] is not None and v["_2"] is not None)
    pairs = whole.map(lambda v: F.struct(v["_2"].alias("_1"), F.array(v["_1"]).alias("_2")), lambda v: {"_1": v["_2"], "_2": [v["_1"]]})
    listed = pairs.group_by_key().stream_to("transactions-by-customer").sum(LIST, "array<bigint>")
    both = flow.source("customers").latest_option("string").join(listed)
    known = lambda v: F.when(v["_1"].isNotNull(), F.struct(v["_1"].alias("name"), v["_2"].alias("transactions")))
    known_py = lambda v: None if v["_1"] is None else {"name": v["_1"], "transactions": v["_2"]}
    return flow, both.map(known, known_py, type="struct<name:string,transactions:array<bigint>>")


def connected_components() -> Flow:
    """``edges`` (node: neighbour) to ``labels``: each label that a node is offered, the least of which is its component's.

    Edges count in both directions.  A node tells its neighbours its label when it first
    hears of them and whenever the label falls.
    """
    flow = Flow()
    kind = "struct<edge:boolean,n:bigint>"
    as_edge = lambda v: F.struct(F.lit(True).alias("edge"), v.alias("n"))
    there = flow.source("edges")
    back = there.zip_with_key().map(lambda v: F.struct(v["_2"].alias("_1"), v["_1"].alias("_2")), lambda v: {"_1": v["_2"], "_2": v["_1"]}).group_by_key()
    ends = flow.merge(there=there, back=back).map(as_edge, lambda v: {"edge": True, "n": v}).stream_to("both-ends")

    def tell(key, state, message):
        label, around = state or (key, [])
        n = message["n"]
        if message["edge"]:
            return ((label, around), []) if n in around else ((label, [*around, n]), [{"_1": n, "_2": label}])
        if n >= label:
            return (label, around), []
        return (n, around), [{"_1": other, "_2": n} for other in around]

    def body(again):
        offers = again.map(lambda v: F.struct(F.lit(False).alias("edge"), v.alias("n")), lambda v: {"edge": False, "n": v})
        told = flow.merge(ends=ends.map(lambda v: v.cast(kind), lambda v: v), offers=offers)
        return told.with_keys.transform(lambda: None, tell, "struct<_1:bigint,_2:bigint>").group_by_key()

    flow.cycle("labels", body, mode="replay")
    return flow


def matches(one: dict, other: dict) -> bool:
    """Whether two products share a name and a category."""
    return bool(set(one["names"]) & set(other["names"])) and bool(set(one["categories"]) & set(other["categories"]))


def merged(one: dict, other: dict) -> dict:
    """All names and categories, and the lower price."""
    return {
        "names": sorted({*one["names"], *other["names"]}),
        "price": min(one["price"], other["price"]),
        "categories": sorted({*one["categories"], *other["categories"]}),
    }


def swoosh(known: list[dict], product: dict) -> tuple[list[dict], list[dict]]:
    """Merge a product into what is known until nothing matches; no output if it adds nothing."""
    product = merged(product, product)
    while True:
        hit = next((k for k in known if matches(k, product)), None)
        if hit is None:
            return [*known, product], [product]
        both = merged(hit, product)
        if both == hit:
            return known, []
        known, product = [k for k in known if k is not hit], both


PRODUCT = "struct<names:array<string>,price:int,categories:array<string>>"


def entity_resolution() -> Flow:
    """``products`` to ``resolved``: per category, every product that a merge has brought about.

    The cycle feeds merged products back to all their categories until none changes.
    """
    flow = Flow()

    def body(again):
        everything = flow.merge(raw=flow.source("products"), merged=again.group_by(lambda v: F.lit(0).cast("bigint"), lambda v: 0))
        copies = everything.flat_map(
            lambda p: F.transform(p["categories"], lambda c: F.struct(c.alias("_1"), p.alias("_2"))), lambda p: [{"_1": c, "_2": p} for c in sorted(p["categories"])]
        )
        return copies.group_by_key().within("by-category").transform(list, swoosh, PRODUCT)

    flow.cycle("resolved", body, mode="replay")
    return flow


def scheduler(seconds: int = 60) -> Flow:
    """``requests`` (due second: name) and a clock to ``triggered``: at each tick the requests due then."""
    flow = Flow()
    requests = flow.source("requests").map(lambda r: F.array(r), lambda r: [r]).sum(LIST)
    ticks = flow.clock(seconds).map(lambda t: F.struct(t.alias("_1"), t.alias("_2")), lambda t: {"_1": t, "_2": t}).group_by_key().stream_to("ticks")
    ticks.join(requests).map(lambda v: v["_2"]).sink_to("triggered")
    return flow
