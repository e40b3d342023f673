"""``python -m millrace.cli COMMAND MODULE:FLOW``: dot, info, gen-config, run.

FLOW is a function of a module that returns a Flow.  ``run`` replays it over topics in
parquet files (``--topic NAME=PATH``, columns key, value, ord) and writes what it
publishes below ``--out``; ``--span FIRST,LAST`` (timestamps) is the time of its clocks.
``run --stream`` takes the topics as growing folders of such files and runs what is
published with Structured Streaming over the checkpoints below ``--checkpoint``, until no
file is left or, with ``--forever``, until it is stopped.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from .plans.viz import describe, dot


def main(args: list[str] | None = None) -> int:
    """The exit code."""
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("command", choices=["dot", "info", "gen-config", "run"])
    parser.add_argument("flow", help="module:function")
    parser.add_argument("--out", help="file of dot and gen-config, folder of run")
    parser.add_argument("--topic", action="append", default=[], metavar="NAME=PATH")
    parser.add_argument("--format", default="parquet", help="of the topics' files")
    parser.add_argument("--span", help="FIRST,LAST of clocks in a replay")
    parser.add_argument("--stream", action="store_true")
    parser.add_argument("--forever", action="store_true")
    parser.add_argument("--checkpoint")
    got = parser.parse_args(args)
    module, _, name = got.flow.partition(":")
    flow = getattr(importlib.import_module(module), name)()

    def show(text: str) -> None:
        Path(got.out).write_text(text + "\n") if got.out else print(text)

    if got.command == "dot":
        show(dot(flow))
    elif got.command == "gen-config":
        show(json.dumps(describe(flow), indent=2))
    elif got.command == "info":
        for job in describe(flow):
            print(f"{job['name']}: reads {', '.join(job['inputs']) or 'nothing'}")
            print(f"  {'published' if job['published'] else 'internal'}, {'re-keyed' if job['regrouped'] else 'same keys'}")
            print(f"  states: {', '.join(job['stores']) or 'none'}")
    else:
        from pyspark.sql import SparkSession

        from .plans.batch import Batch

        if not got.out or (got.stream and not got.checkpoint):
            parser.error("run needs --out, and --checkpoint with --stream")
        spark = SparkSession.builder.appName("millrace").getOrCreate()
        paths = [(n, p) for n, _, p in (t.partition("=") for t in got.topic)]
        topics = {n: spark.read.format(got.format).load(p) for n, p in paths}
        published = [label for label, sink in flow.graph.bindings.items() if sink.published]
        out = got.out.rstrip("/")
        if got.stream:
            from .streaming.runner import Streaming

            streams = {n: spark.readStream.format(got.format).schema(topics[n].schema).load(p) for n, p in paths}
            runner = Streaming(spark, flow, streams)
            started = [runner.start(x, f"{out}/{x}", f"{got.checkpoint.rstrip('/')}/{x}", once=not got.forever) for x in published]
            for query in started:
                query.awaitTermination()
        else:
            batch = Batch(spark, flow, topics, span=tuple(got.span.split(",", 1)) if got.span else None)
            for label in published:
                batch.stream(label).write.parquet(f"{out}/{label}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
