"""The logical graph: a closed set of nodes that every operator of the builder becomes.

Functions of stateless nodes get and return Spark columns; as long as they use operators
that plain values have too, the in-memory interpreter runs the same function on values,
and where they do not, a node carries a second function for it (``py``).  State machines
are plain Python ``step(state, value) -> (state, [outputs])``; a recognised one also knows
its window form (``window``), which batch plans use instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any


@dataclass(eq=False)
class Node:
    """A stream of ordered (key, value) messages."""

    def inputs(self) -> list[Node]:
        return []

    def walk(self) -> Iterator[Node]:
        yield self
        for up in self.inputs():
            yield from up.walk()


@dataclass(eq=False)
class Source(Node):
    """A named stream from outside the graph or from one of its bindings."""

    name: str


@dataclass(eq=False)
class Clock(Node):
    """A tick every so many seconds, under one constant key."""

    seconds: int


@dataclass(eq=False)
class Transform(Node):
    """Messages of one input turned into others under the same keys; a ``keyed`` function gets the key first."""

    up: Node

    def inputs(self) -> list[Node]:
        return [self.up]


@dataclass(eq=False)
class PureTransform(Transform):
    """``kind`` map, filter or flat_map of ``f``."""

    kind: str
    f: Callable
    py: Callable | None = None
    keyed: bool = False


@dataclass(eq=False)
class StatefulTransform(Transform):
    """A state machine for each key.  ``type`` is the Spark type of its outputs."""

    init: Callable[[], Any]
    step: Callable[[Any, Any], tuple[Any, list]]
    type: str | None = None
    window: Callable | None = None
    keyed: bool = False


@dataclass(eq=False)
class Merge(Node):
    """All messages of named branches; ties keep the branches' order."""

    branches: list[tuple[str, Node]]

    def inputs(self) -> list[Node]:
        return [n for _, n in self.branches]


@dataclass(eq=False)
class GroupBy(Node):
    """The same messages under another key."""

    up: Node
    f: Callable
    py: Callable | None = None
    keyed: bool = False

    def inputs(self) -> list[Node]:
        return [self.up]


@dataclass(eq=False)
class Lookup(Node):
    """Merge of two branches and the state machine that remembers the last value of each.

    ``both``: a pair for every message of either side; otherwise only for the left ones.
    """

    left: Node
    right: Node
    left_init: Any
    right_init: Any
    both: bool = False

    def inputs(self) -> list[Node]:
        return [self.left, self.right]


@dataclass(eq=False)
class Sink:
    """What a name is bound to.  ``cycle`` tells how a body that reads its own name is run: linear or replay."""

    node: Node
    published: bool = False
    cycle: str | None = None


@dataclass
class Graph:
    """Bindings in the order in which they were made."""

    bindings: dict[str, Sink] = field(default_factory=dict)
    reserved: set[str] = field(default_factory=set)

    def bind(self, name: str, sink: Sink) -> None:
        if name in self.bindings or name in self.reserved:
            raise ValueError(f"name is bound already: {name}")
        self.bindings[name] = sink

    def reserve(self, name: str) -> None:
        """Take a name for a stream inside a binding."""
        if name in self.bindings or name in self.reserved:
            raise ValueError(f"name is bound already: {name}")
        self.reserved.add(name)

    def sources_of(self, name: str) -> list[str]:
        """Names that a binding reads, without repetition."""
        return list(dict.fromkeys(n.name for n in self.bindings[name].node.walk() if isinstance(n, Source)))

    def regrouped(self, name: str) -> bool:
        """Whether a binding's messages were given another key on their way."""
        return any(isinstance(n, GroupBy) for n in self.bindings[name].node.walk())

    def stores_of(self, name: str) -> list[str]:
        """A label for each state that a binding keeps, by its path in the binding's tree."""
        out: list[str] = []

        def visit(node: Node, path: str) -> None:
            if isinstance(node, (StatefulTransform, Lookup)):
                out.append(path)
            ups = node.branches if isinstance(node, Merge) else [(str(i), u) for i, u in enumerate(node.inputs())]
            for label, up in ups:
                visit(up, f"{path}.{label}" if len(ups) > 1 else path + "'")

        visit(self.bindings[name].node, name)
        return out
