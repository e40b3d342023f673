"""Finding every window of a fixed length that occurs at least twice in a corpus.

Shared by the two substring deduplicators, whose units are bytes and words.

*Chunks.*  Whole texts are stored in chunks of about a megabyte, one row each, so that the
passes below cost array operations and not one Python step for each document.  A text is
in one chunk, however long it is.

*Census.*  Each chunk sends the hashes of its marked runs (of anchors or of reference
blocks and probes), each once and with the number of its copies, to buckets of hashes; a
bucket answers which of them the corpus holds twice.  A run in a third of all documents
is one entry for each chunk, so no bucket grows with it.

*Segments.*  Consecutive windows whose least such run is the same one form a segment.
Equal windows have equal least runs at equal offsets, so all twins of a window are in
segments of one run, its anchor.  Equal segments are counted (first in their chunk, then
in each task) and go on as one, with their number.

*Shards.*  Segments are dealt out by anchor; the solver of the operator finds the repeated
windows of a shard, and nothing else does.  An anchor with over ``hot_limit`` different
segments would make one large shard: its segments are cut into ranges of windows that
share a core of text around the anchor and dealt out by the core; where that is hot as
well, into single windows.  Each time equal ones are counted and go on as one.

Segments are told apart by 128-bit digests when results go back to documents.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Different segments of an anchor over which they are dealt out by more of their text.
HOT_LIMIT = 500
#: Bytes of segments that a solver gets at once.
SHARD_BYTES = 4 << 20
#: Bytes after which a chunk is full.
CHUNK_BYTES = 1 << 20
#: Hashes that a bucket of the census gets, about.
BUCKET_HASHES = 1 << 20
#: Units of text that are hashed at once.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_CODE_BITS = 30
_NONE = np.uint64((1 << 64) - 1)


@dataclass(frozen=True)
class Segments:
    """Stretches of windows with one anchor, as arrays: place of the first window, windows, anchor's offset from it, its hash."""

    place: np.ndarray
    n: np.ndarray
    offset: np.ndarray
    hash: np.ndarray


@dataclass(frozen=True)
class Units:
    """How texts fall into units and what is done with them.

    ``join``: texts as one array of bytes and the bytes of each.  ``bounds``: where the
    units of such an array begin and end, and the units of each text (None: bytes are the
    units).  ``hashes``: of the bytes and texts, the hashes for the census and which of them
    count as reference; None if ``mark`` gives segments before the census.  ``segments``: of
    bytes and texts the segments, given the census codes that occur twice.  ``solve``: of
    segments (contents, numbers, anchors' offsets, groups) the repeated windows of each.
    """

    window: int
    gram: int
    join: Callable[[list[str | None]], tuple[bytes, np.ndarray]]
    bounds: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None
    mark: Callable[[np.ndarray, np.ndarray], Segments] | None
    hashes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None
    segments: Callable[[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]], Segments] | None
    solve: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, int], list[np.ndarray]]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        out = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)]
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x


TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def spans(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of ``values[first:last]`` for each pair, the same wherever the run stands."""
    n = len(values)
    if not _POWERS or len(_POWERS[0][0]) < n:
        _POWERS[:] = [_powers(max(n, SLICE * 2))]
    up, down = _POWERS[0]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    got = total[last]
    got -= total[first]
    got *= down[first]
    return _mix(got)


def runs_of(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if not _POWERS or len(_POWERS[0][0]) < len(values):
        _POWERS[:] = [_powers(max(len(values), SLICE * 2))]
    up, down = _POWERS[0]
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    got = total[size:] - total[:n]
    got *= down[:n]
    return _mix(got)


def least_runs(hashes: np.ndarray, wanted: np.ndarray | None, limits: np.ndarray, window: int, size: int) -> Segments:
    """Segments of the windows by their least run of ``size`` units among those ``wanted`` (None: all).

    ``hashes``: of the runs that begin at each unit; ``limits``: where the text of each
    unit ends.  Windows without a wanted run, or over the end of a text, are left out.
    """
    width, n = window - size + 1, len(hashes) - (window - size)
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return Segments(empty, empty, empty, empty.view(np.uint64))
    # the upper half of the hash, then the place: the least is the leftmost least
    least = hashes & np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(hashes), dtype=np.uint64)
    if wanted is not None:
        least[~wanted] = _NONE
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    inside = limits[:n] >= np.arange(window, n + window)
    if wanted is not None:
        inside &= least != _NONE
    place = np.flatnonzero(inside)
    anchor = (least[place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    cuts = np.concatenate([np.zeros(min(1, len(place)), np.int64), cuts])
    counts = np.diff(np.append(cuts, len(place)))
    first, anchor = place[cuts], anchor[cuts]
    return Segments(first, counts, anchor - first, hashes[anchor])


def ends_of(sizes: np.ndarray) -> np.ndarray:
    """For each unit the number of the one after its text's last."""
    return np.repeat(np.cumsum(sizes), sizes)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


_CHUNKS = "chunk long, ids binary, sizes binary, data binary, places binary, hashes binary, n_hashes long"


def _chunk(units: Units, chunk_bytes: int):
    """Whole texts as rows of chunks: ids (value and whether null), bytes of each text, all bytes, segments if they are marked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        parts: list[bytes] = []
        sizes: list[np.ndarray] = []
        held = 0

        def emit() -> pa.RecordBatch:
            nonlocal number
            data, size = b"".join(parts), np.concatenate(sizes)
            array = np.frombuffer(data, np.uint8)
            places = hashes = b""
            if units.mark is not None:
                seg = units.mark(array, size)
                places, hashes = _pack(seg.place.astype("<i8"), seg.n.astype("<u2"), seg.offset.astype("<u2")), _pack(seg.hash)
                n = len(seg.hash)
            else:
                n = len(data) // 4
            key = np.array([[0 if x is None else x, x is None] for x in ids], "<i8")
            row = [[number], [_pack(key)], [_pack(size.astype("<i8"))], [data], [places], [hashes], [n]]
            kinds = [pa.int64(), *[pa.large_binary()] * 5, pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in _CHUNKS.split(", ")])
            number += 1
            ids.clear()
            parts.clear()
            sizes.clear()
            return out

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                stop = at
                while stop < len(texts) and held < chunk_bytes:
                    held += len(texts[stop] or "")
                    stop += 1
                data, size = units.join(texts[at:stop])
                ids += doc_ids[at:stop]
                parts.append(data)
                sizes.append(size)
                at = stop
                if held >= chunk_bytes:
                    yield _narrow(emit())
                    held = 0
        if ids:
            yield _narrow(emit())

    return run


def _narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Binaries with the offsets that Spark expects."""
    return batch.cast(pa.schema([(f.name, pa.binary() if pa.types.is_large_binary(f.type) else f.type) for f in batch.schema]))


def _census_map(units: Units, buckets: int):
    """Of a chunk, the codes of its hashes for each bucket: thirty bits, whether one copy is a reference, whether there are several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, first, second in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if units.mark is not None:
                    hashes = np.frombuffer(first.as_buffer(), np.uint64)
                    reference = np.ones(len(hashes), bool)
                else:
                    hashes, reference = units.hashes(np.frombuffer(second.as_buffer(), np.uint8), np.frombuffer(first.as_buffer(), "<i8"))
                if not len(hashes):
                    continue
                keys = codes(hashes, buckets)
                keys <<= np.uint64(1)
                keys |= reference
                keys.sort()
                last = np.flatnonzero(np.append((keys[1:] >> np.uint64(1)) != (keys[:-1] >> np.uint64(1)), True))
                counts = np.diff(last, prepend=-1)
                keys = keys[last]
                found = ((keys >> np.uint64(1)) << np.uint64(2)) & np.uint64((1 << _CODE_BITS + 2) - 1)
                found |= keys & np.uint64(1)
                found |= (counts > 1).astype(np.uint64) << np.uint64(1)
                bucket = (keys >> np.uint64(_CODE_BITS + 1)).astype(np.int64)
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts]), pa.array(np.full(len(cuts), chunk, np.int64)), _binaries(found.astype("<u4"), np.append(cuts, len(found)))],
                    names=["bucket", "chunk", "codes"],
                )

    return run


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Stretches of an array as binaries."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and code of each hash, as one number."""
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(_CODE_BITS) | hashes & np.uint64((1 << _CODE_BITS) - 1)


def _census_reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket and chunk, the codes that the corpus holds twice, one of them as a reference."""
    now, chunks, parts = None, [], []

    def work() -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(p) for p in parts], np.int64)
        merged = np.concatenate(parts).astype(np.uint64) << np.uint64(32)
        merged |= np.arange(len(merged), dtype=np.uint64)
        merged.sort()
        code = (merged >> np.uint64(34)).astype(np.uint32)
        cuts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        flags = np.bitwise_or.reduceat((merged >> np.uint64(32)).astype(np.uint8) & 3, cuts)
        counts = np.diff(np.append(cuts, len(code)))
        good = np.repeat((flags & 1 > 0) & ((counts > 1) | (flags & 2 > 0)), counts)
        at = (merged[good] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        code = code[good]
        order = np.argsort(at)
        at, code = at[order], code[order]
        bounds = np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)]))
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            cuts = np.append(bounds[some], bounds[some[-1] + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(chunks, np.int64)[some]), pa.array(np.full(len(some), now, np.int64)), _binaries(code.astype("<u4"), cuts)],
                names=["chunk", "bucket", "codes"],
            )

    for batch in batches:
        for bucket, chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if bucket != now:
                if parts:
                    yield from work()
                now, chunks, parts = bucket, [], []
            chunks.append(chunk)
            parts.append(np.frombuffer(blob.as_buffer(), "<u4").copy())
    if parts:
        yield from work()


def census(chunks: DataFrame, units: Units) -> tuple[DataFrame, int]:
    """Per chunk ``twice``, an array of (bucket, codes), and the number of buckets."""
    total = chunks.agg(F.sum("n_hashes")).first()[0] or 0
    buckets = min(1 << 24, max(1, -(-total // BUCKET_HASHES)))
    given = chunks.select("chunk", "hashes", F.lit(None).cast("binary").alias("none")) if units.mark else chunks.select("chunk", "sizes", "data")
    sent = given.mapInArrow(_census_map(units, buckets), "bucket long, chunk long, codes binary")
    sent = sent.repartition("bucket").sortWithinPartitions("bucket")
    got = sent.mapInArrow(_census_reduce, "chunk long, bucket long, codes binary")
    return got.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "codes")).alias("twice")), buckets


def _digests(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.md5(x, usedforsecurity=False).digest() for x in parts]), "<i8").reshape(-1, 2)


def _cut(data: bytes | memoryview, bounds: tuple[np.ndarray, np.ndarray] | None, first: int, units: int):
    if bounds is None:
        return data[first : first + units]
    return data[int(bounds[0][first]) : int(bounds[1][first + units - 1])]


_SEGMENTS = "chunk long, places binary, digests binary, k1 long, k2 long, c1 long, c2 long, a int, n int, c long, content binary"
_KINDS = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _segment(units: Units, buckets: int):
    """Per chunk one row with the places of its segments, and a row for each different one with its number of copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SEGMENTS.split(", ")]
        for batch in batches:
            twice = batch.column(5)
            for i, chunk in enumerate(batch.column(0).to_pylist()):
                raw = memoryview(batch.column(2)[i].as_buffer())
                sizes, data = np.frombuffer(batch.column(1)[i].as_buffer(), "<i8"), np.frombuffer(raw, np.uint8)
                parts = twice[i].values
                blobs = parts.field("codes")
                listed = [np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64) | np.uint64(b << _CODE_BITS) for b, x in zip(parts.field("bucket").to_pylist(), blobs)]
                known = np.sort(np.concatenate(listed))

                def wanted(hashes: np.ndarray, known: np.ndarray = known) -> np.ndarray:
                    mine = codes(hashes, buckets)
                    at = np.searchsorted(known, mine)
                    return known[np.minimum(at, len(known) - 1)] == mine

                if units.mark is not None:
                    marks = batch.column(3)[i].as_buffer()
                    hashes = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                    m = len(hashes)
                    place, n, offset = (np.frombuffer(marks, kind, m, at) for kind, at in (("<i8", 0), ("<u2", 8 * m), ("<u2", 10 * m)))
                    keep = wanted(hashes)
                    seg = Segments(place[keep], n[keep].astype(np.int64), offset[keep].astype(np.int64), hashes[keep])
                else:
                    seg = units.segments(data, sizes, wanted)
                if not len(seg.place):
                    continue
                bounds = units.bounds(data) if units.bounds else None
                if bounds is None:
                    low, high = seg.place, seg.place + seg.n + units.window - 1
                else:
                    low, high = bounds[0][seg.place], bounds[1][seg.place + seg.n + units.window - 2]
                content = [bytes(raw[a:b]) for a, b in zip(low.tolist(), high.tolist())]
                numbers: dict[bytes, int] = {}
                index = np.array([numbers.setdefault(x, len(numbers)) for x in content], np.int32)
                counts = np.bincount(index)
                first = np.full(len(numbers), len(index))
                np.minimum.at(first, index, np.arange(len(index)))
                content = list(numbers)
                digest = _digests(content)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], k) for v, k in zip((chunk, _pack(seg.place.astype("<i8"), index), _pack(digest), *[None] * 8), _KINDS)], names=names
                )
                for at in range(0, len(content), 4000):
                    some = slice(at, at + 4000)
                    m = len(content[some])
                    columns = [
                        np.full(m, chunk), None, None, seg.hash[first[some]].view(np.int64), np.zeros(m, np.int64),
                        digest[some, 0], digest[some, 1], seg.offset[first[some]].astype(np.int32), seg.n[first[some]].astype(np.int32), counts[some], content[some],
                    ]
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, k) if c is None else pa.array(c, k) for c, k in zip(columns, _KINDS)], names=names)

    return run


def _runs(flags: np.ndarray) -> bytes:
    """Beginnings and ends of the runs of true values, as pairs of u16."""
    padded = np.concatenate([[False], flags, [False]])
    return np.flatnonzero(padded[1:] != padded[:-1]).astype("<u2").tobytes()


_RESULT = "c1 long, c2 long, runs binary"


def _solve(units: Units, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []  # of the key that is being read
        ready: list[tuple] = []  # of keys with several segments
        size, now, number = 0, None, 0

        def work() -> Iterator[pa.RecordBatch]:
            c1, c2, a, count, content, key = zip(*ready)
            flags = units.solve(list(content), np.array(count), np.array(a), np.array(key), units.window)
            keep = [i for i, f in enumerate(flags) if f.any()]
            ready.clear()
            if keep:
                columns = [[c1[i] for i in keep], [c2[i] for i in keep], [_runs(flags[i]) for i in keep]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["c1", "c2", "runs"])

        def close() -> None:
            nonlocal size, number
            # a segment that is alone and occurs once has no twin: none of its windows equals another of them
            if len(group) > 1 or (group and group[0][3] > 1):
                ready.extend((*row, number) for row in group)
                size += sum(len(x[4]) for x in group)
                number += 1
            group.clear()

        for batch in batches:
            for k1, k2, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) != now:
                    close()
                    if size > shard_bytes:
                        yield from work()
                        size = 0
                    now = (k1, k2)
                group.append(tuple(row))
        close()
        if ready:
            yield from work()

    return run


_RANGES = "k1 long, k2 long, s1 long, s2 long, o1 long, o2 long, off int, a int, n int, c long, content binary"


def _ranges(units: Units, step: int):
    """Segments of hot keys cut into ranges of up to ``step`` windows, by the anchor's offset in a window.

    All windows of a range hold the same core around the anchor, so segments whose cores
    differ share none of them.
    """
    width = units.window - units.gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            cores, whole = [], []
            for k1, k2, c1, c2, anchor, n, count, content in zip(*(c.to_pylist() for c in batch.columns)):
                bounds = units.bounds(np.frombuffer(content, np.uint8)) if units.bounds else None
                for t in range((anchor - n + 1) // step, anchor // step + 1):
                    low, high = max(t * step, anchor - n + 1), min((t + 1) * step - 1, anchor)
                    last = min((t + 1) * step - 1, width - 1)
                    core = _cut(content, bounds, anchor - t * step, units.window - last + t * step)
                    cores.append(struct.pack("<qqii", k1, k2, step, t) + core)
                    text = _cut(content, bounds, anchor - high, high - low + units.window)
                    whole.append(struct.pack("<iii", step, low, high) + text)
                    rows.append((c1, c2, anchor - high, high, high - low + 1, count, text))
            if rows:
                o1, o2, off, a, n, c, text = zip(*rows)
                key, name = _digests(cores), _digests(whole)
                columns = [key[:, 0], key[:, 1], name[:, 0], name[:, 1], o1, o2, off, a, n, c, text]
                kinds = [*[pa.int64()] * 6, *[pa.int32()] * 3, pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=[x.split()[0] for x in _RANGES.split(", ")])

    return run


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows of a range as those of the segment it was cut from."""
    for batch in batches:
        runs = [(np.frombuffer(r.as_buffer(), "<u2") + np.uint16(off)).tobytes() for r, off in zip(batch.column(2), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.binary())], names=["c1", "c2", "runs"])


def _solved(segments: DataFrame, units: Units, steps: list[int], hot_limit: int, shard_bytes: int) -> DataFrame:
    """(c1, c2, runs) of the different segments (k1, k2, c1, c2, a, n, c, content), dealt out by (k1, k2)."""
    columns = ["k1", "k2", "c1", "c2", "a", "n", "c", "content"]
    cold, found = segments, None
    if steps:
        hot = segments.groupBy("k1", "k2").agg(F.count("*").alias("m")).where(F.col("m") > hot_limit).select("k1", "k2")
        hot = common.stored(hot, "hot-anchors")
        if hot.limit(1).count():
            cold = segments.join(hot, ["k1", "k2"], "left_anti")
            parts = segments.join(hot, ["k1", "k2"], "left_semi").select(*columns).mapInArrow(_ranges(units, steps[0]), _RANGES)
            parts = common.stored(parts, "ranges")
            kinds = parts.groupBy("k1", "k2", "s1", "s2", "a", "n", "content").agg(F.sum("c").alias("c"))
            kinds = common.stored(kinds.withColumnsRenamed({"s1": "c1", "s2": "c2"}), "range-kinds")
            inner = common.stored(_solved(kinds, units, steps[1:], hot_limit, shard_bytes), "range-results")
            back = parts.select("o1", "o2", "s1", "s2", "off").join(inner.withColumnsRenamed({"c1": "s1", "c2": "s2"}), ["s1", "s2"])
            found = back.select("o1", "o2", "runs", "off").mapInArrow(_shift, _RESULT)
    shards = cold.repartition("k1", "k2").sortWithinPartitions("k1", "k2").select("k1", "k2", "c1", "c2", "a", "c", "content")
    solved = shards.mapInArrow(_solve(units, shard_bytes), _RESULT)
    return solved if found is None else solved.union(found)


def repeated(
    docs: DataFrame,
    units: Units,
    *,
    hot_limit: int = HOT_LIMIT,
    shard_bytes: int = SHARD_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Chunks (ids, sizes, data) with their segments (places, digests) and ``found``, an array of (c1, c2, runs).

    ``covered`` makes of a row which units repeated windows cover.
    """
    if units.window >= 1 << 16:
        raise ValueError("windows are numbered with 16 bits within a segment")
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = common.stored(rows.mapInArrow(_chunk(units, chunk_bytes), _CHUNKS), "chunks")
    twice, buckets = census(chunks, units)
    twice = common.stored(twice, "twice")
    given = chunks.select("chunk", "sizes", "data", "places", "hashes").join(twice, "chunk")
    segs = common.stored(given.mapInArrow(_segment(units, buckets), _SEGMENTS), "segments")
    common.discard(twice)
    listed = segs.where("content is not null")
    with common.tracked() as scratch:
        kinds = listed.groupBy("k1", "k2", "c1", "c2", "a", "n", "content").agg(F.sum("c").alias("c"))
        kinds = common.stored(kinds, "kinds")
        width = units.window - units.gram + 1
        steps = [s for s in (math.isqrt(width) + 1, 1) if s < width]
        solved = _solved(kinds, units, steps, hot_limit, shard_bytes)
    solved = common.stored(solved, "repeats")
    for path in scratch:
        common.delete(spark, path)
    found = listed.select("chunk", "c1", "c2").join(solved, ["c1", "c2"])
    found = found.groupBy("chunk").agg(F.collect_list(F.struct("c1", "c2", "runs")).alias("found"))
    places = segs.where("content is null").select("chunk", F.col("places").alias("at"), "digests")
    found = common.stored(found.join(places, "chunk"), "found")
    common.discard(segs, solved)
    return chunks.select("chunk", "ids", "sizes", "data").join(found, "chunk", "left").select("ids", "sizes", "data", "at", "digests", "found")


def covered(units: int, at: bytes | None, digests: bytes | None, found: pa.StructArray | None, window: int) -> np.ndarray:
    """Which of a chunk's ``units`` the repeated windows cover."""
    if found is None or not len(found):
        return np.zeros(units, bool)
    m = len(at) // 12
    place, index = np.frombuffer(at, "<i8", m), np.frombuffer(at, "<i4", m, 8 * m)
    key = np.frombuffer(digests, "<i8").reshape(-1, 2)
    numbers = {x: i for i, x in enumerate(zip(key[:, 0].tolist(), key[:, 1].tolist()))}
    blobs = found.field("runs")
    mine = [numbers[x] for x in zip(found.field("c1").to_pylist(), found.field("c2").to_pylist())]
    runs = [np.frombuffer(x.as_buffer(), "<u2") for x in blobs]
    sizes = np.array([len(r) // 2 for r in runs])
    order = np.argsort(mine, kind="stable")
    flat = np.concatenate([runs[i] for i in order]).astype(np.int64).reshape(-1, 2)
    each = np.bincount(mine, sizes, len(key)).astype(np.int64)
    first = np.cumsum(each) - each
    n = each[index]
    row = np.repeat(first[index] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    start = np.repeat(place, n)
    marks = np.zeros(units + 1, np.int32)
    np.add.at(marks, start + flat[row, 0], 1)
    np.add.at(marks, start + flat[row, 1] + window - 1, -1)
    return np.cumsum(marks[:-1]) > 0


def spans_of(flags: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true values that end with their text: text, first and last + 1 within it."""
    starts = np.cumsum(sizes) - sizes
    begins = np.zeros(len(flags) + 1, bool)
    begins[starts] = True
    begins[-1] = True
    first = np.flatnonzero(flags & (begins[:-1] | ~np.concatenate([[False], flags[:-1]])))
    last = np.flatnonzero(flags & (begins[1:] | ~np.concatenate([flags[1:], [False]]))) + 1
    text = np.searchsorted(starts, first, side="right") - 1
    # texts without units share their start with the next one: the last of them has the units
    return text, first - starts[text], last - starts[text]
