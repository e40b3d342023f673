"""Associative sums with a zero, in three forms each.

``plus`` combines plain values (interpreter and streaming), ``running`` is a window column
(every prefix of a key's messages), ``final`` an aggregate with map-side partial sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Monoid:
    zero: Callable[[], Any]
    plus: Callable[[Any, Any], Any]
    running: Callable[[Column, WindowSpec], Column]
    final: Callable[[Column], Column]
    type: str = "long"
    #: What a state amounts to, and that of the zero.
    value: Callable[[Any], Any] = lambda state: state
    initial: Any = 0


def _total(kind: str) -> Monoid:
    return Monoid(lambda: 0, lambda a, b: a + b, lambda c, w: F.sum(c).over(w), F.sum, kind)


SUM = _total("long")
SUM_DOUBLE = _total("double")


def _extreme(f: Callable, spark_f: Callable) -> Monoid:
    return Monoid(lambda: None, lambda a, b: b if a is None else f(a, b), lambda c, w: spark_f(c).over(w), spark_f, initial=None)


MAX = _extreme(max, F.max)
MIN = _extreme(min, F.min)

#: Contents of a growing set, sorted.  For its size alone use ``Stream.distinct_count``, whose state is one flag a value.
SET_UNION = Monoid(
    list,
    lambda a, b: sorted({*a, *b}),
    lambda c, w: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c).over(w)))),
    lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))),
    "array<string>",
    initial=[],
)


def _in_order(c: Column) -> Column:
    """The elements of a key's arrays in order of ``ord``."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), c.alias("v"))))
    return F.flatten(F.transform(listed, lambda x: x["v"]))


LIST = Monoid(list, lambda a, b: [*a, *b], lambda c, w: F.flatten(F.collect_list(c).over(w)), _in_order, "array<string>", initial=[])
#: Averages of doubles; the state is (number, total).
AVERAGE = Monoid(
    lambda: (0, 0.0),
    lambda a, b: (a[0] + 1, a[1] + b),
    lambda c, w: F.avg(c).over(w),
    F.avg,
    "double",
    lambda state: state[1] / state[0],
    None,
)


def product(left: Monoid, right: Monoid) -> Monoid:
    """Pairs (_1, _2), summed side by side."""
    both = lambda one, two: F.struct(one.alias("_1"), two.alias("_2"))
    return Monoid(
        lambda: (left.zero(), right.zero()),
        lambda a, b: (left.plus(a[0], b["_1"]), right.plus(a[1], b["_2"])),
        lambda c, w: both(left.running(c["_1"], w), right.running(c["_2"], w)),
        lambda c: both(left.final(c["_1"]), right.final(c["_2"])),
        f"struct<_1:{left.type},_2:{right.type}>",
        lambda state: {"_1": left.value(state[0]), "_2": right.value(state[1])},
        {"_1": left.initial, "_2": right.initial},
    )


def pointwise(type: str = "bigint", key_type: str = "string") -> Monoid:
    """Maps, whose numbers are summed key by key; a key that either has stays."""

    def plus(a: dict, b: dict | None) -> dict:
        return {k: a.get(k, 0) + (b or {}).get(k, 0) for k in {**a, **(b or {})}}

    def summed(maps: Column) -> Column:
        add = lambda k, x, y: F.coalesce(x, F.lit(0).cast(type)) + F.coalesce(y, F.lit(0).cast(type))
        return F.aggregate(maps, F.create_map().cast(f"map<{key_type},{type}>"), lambda a, m: F.map_zip_with(a, m, add))

    return Monoid(dict, plus, lambda c, w: summed(F.collect_list(c).over(w)), lambda c: summed(F.collect_list(c)), f"map<{key_type},{type}>", initial={})
