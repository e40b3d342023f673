"""Graphs as GraphViz text, and summaries of what a job reads, keeps and writes."""

from __future__ import annotations

import json

from ..operators.flow import Flow
from .ir import Clock, Graph, GroupBy, Lookup, Merge, Node, PureTransform, Sink, Source, StatefulTransform

_NAMES = {PureTransform: "transform", StatefulTransform: "aggregate", Merge: "merge", GroupBy: "regroup", Lookup: "lookup"}


def _graph(flow: Flow | Graph) -> Graph:
    return flow.graph if isinstance(flow, Flow) else flow


def dot(flow: Flow | Graph) -> str:
    """One cluster for each binding; boxes are names, plain text is what happens between them."""
    lines, serial = ["digraph dataflow {"], 0
    for name, sink in _graph(flow).bindings.items():
        nodes: dict[str, tuple[str, str]] = {f"n_{name}": ("box", name)}
        edges: list[tuple[str, str, str]] = []

        def visit(node: Node, below: str, label: str = "") -> None:
            nonlocal serial
            if isinstance(node, Source):
                nodes[f"n_{node.name}"] = ("box", node.name)
                edges.append((f"n_{node.name}", below, label))
                return
            serial += 1
            here = f"i_{serial}"
            text = f"every {node.seconds} s" if isinstance(node, Clock) else _NAMES[type(node)]
            nodes[here] = ("none", text)
            edges.append((here, below, label))
            ups = node.branches if isinstance(node, Merge) else [("", u) for u in node.inputs()]
            for branch, up in ups:
                visit(up, here, branch)

        visit(sink.node, f"n_{name}")
        lines.append(f"  subgraph {json.dumps('cluster_' + name)} {{")
        lines.append(f"    label={json.dumps(name)};")
        lines += [f"    {json.dumps(k)} [shape={shape}, label={json.dumps(text)}];" for k, (shape, text) in nodes.items()]
        lines += [f"    {json.dumps(a)} -> {json.dumps(b)}" + (f" [label={json.dumps(t)}]" if t else "") + ";" for a, b, t in edges]
        lines.append("  }")
    return "\n".join([*lines, "}"])


def describe(flow: Flow | Graph) -> list[dict]:
    """For each binding: what it reads, whether keys change, and the states it keeps."""
    graph = _graph(flow)

    def one(name: str, sink: Sink) -> dict:
        return {
            "name": name,
            "published": sink.published,
            "cycle": sink.cycle,
            "inputs": graph.sources_of(name),
            "regrouped": graph.regrouped(name),
            "stores": graph.stores_of(name),
            "merges": sum(isinstance(n, (Merge, Lookup)) for n in sink.node.walk()),
        }

    return [one(name, sink) for name, sink in graph.bindings.items()]
