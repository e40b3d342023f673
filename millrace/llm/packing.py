"""Packing documents into fixed-length sequences by cutting-stock column generation.

Every document becomes its token ids plus a separator id and is cut into full pieces and
one remainder.  The histogram of piece lengths (at most ``capacity`` entries, whatever
the corpus) is the demand of a cutting-stock problem on the driver: a linear program over
patterns of lengths, whose columns are priced by a knapsack dynamic program over the
capacity.  Pattern counts are rounded down; pieces of one length, ranked over the whole
corpus, take the places of their length in turn, so an assignment is arithmetic on
(length, rank).  Patterns that would waste more than ``slack`` tokens are not used, and
what rounding leaves over is laid end to end and cut every ``capacity`` tokens; the last
stretch is cut at powers of two.  So padding never exceeds ``slack`` per sequence.

Defined edge cases: a null text counts as empty and is the separator alone; very long texts
are encoded whole and become many full pieces; repeated rows
are packed each for itself; null document ids are kept; an empty table packs to nothing;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import default_vocabulary, encoder

CAPACITY = 1024
#: Tokens of padding that a pattern may have.
SLACK = 8
#: Column generation ends when the linear program is proven to be this near its optimum.
GAP = 1e-3


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The best multiset of ``lengths`` within ``capacity``: its value, and counts by index (an unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = np.searchsorted(lengths, room, side="right")
        if fit:
            gain = values[:fit] + best[room - lengths[:fit]]
            j = int(np.argmax(gain))
            best[room] = gain[j]
            pick[room] = j
        if best[room - 1] >= best[room]:
            best[room], pick[room] = best[room - 1], -1
    counts: dict[int, int] = {}
    room = capacity
    while room > 0:
        j = int(pick[room])
        if j < 0:
            room -= 1
        else:
            counts[j] = counts.get(j, 0) + 1
            room -= int(lengths[j])
    return float(best[capacity]), counts


def first_basis(lengths: np.ndarray, need: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """A feasible triangular basis: longest first, each pattern used until it exhausts the length that it stands for."""
    left, patterns, amounts = need.copy(), [{}] * len(lengths), np.zeros(len(lengths))
    alive = set(range(len(lengths)))
    while alive:
        counts: dict[int, int] = {}
        room, top = capacity, len(lengths)
        while room > 0 and top > 0:
            i = min(top, int(np.searchsorted(lengths, room, side="right"))) - 1
            while i >= 0 and i not in alive:
                i -= 1
            if i < 0:
                break
            counts[i] = int(room // lengths[i])
            room -= counts[i] * int(lengths[i])
            top = i
        times = {i: left[i] / c for i, c in counts.items()}
        out = min(times, key=lambda i: times[i])
        step = times[out]
        for i, c in counts.items():
            left[i] = max(left[i] - c * step, 0.0)
        patterns[out], amounts[out] = counts, step
        left[out] = 0.0
        alive.discard(out)
    return patterns, amounts


def column_generation(
    demand: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, rounds: int = 500
) -> list[tuple[dict[int, int], float]]:
    """Patterns (length to count) with their fractional numbers: a near-optimal basis of the linear program.

    A revised simplex with an explicit inverse; its size is the number of distinct lengths,
    so neither time nor memory depends on the number of documents.  It ends when the
    sequences are within ``gap`` of a lower bound (the tokens over the capacity, or that of
    Farley from the duals), or after ``rounds`` columns: a plan that is not near its optimum
    yet leaves more to be laid end to end, and nothing unpacked.
    """
    lengths = np.array(sorted(x for x, n in demand.items() if n > 0), dtype=np.int64)
    if not len(lengths):
        return []
    need = np.array([demand[int(x)] for x in lengths], dtype=float)
    patterns, amount = first_basis(lengths, need, capacity)
    basis = np.zeros((len(lengths), len(lengths)))
    for j, p in enumerate(patterns):
        basis[list(p), j] = list(p.values())
    inverse = np.linalg.inv(basis)
    least = float(lengths @ need) / capacity
    for _ in range(rounds):
        if amount.sum() <= least * (1 + gap):
            break
        worth, counts = price(inverse.sum(axis=0), lengths, capacity)
        if worth <= 1 + gap:  # the duals over the best worth are feasible
            break
        change = inverse[:, list(counts)] @ np.array(list(counts.values()), float)
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        amount -= step * change
        amount[out] = step
        np.maximum(amount, 0, out=amount)
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        patterns[out] = counts
    return [({int(lengths[i]): k for i, k in p.items()}, float(x)) for p, x in zip(patterns, amount)]


class Plan:
    """Where the piece with a given length and rank goes."""

    def __init__(self, demand: dict[int, int], capacity: int = CAPACITY, slack: int = SLACK, gap: float = GAP):
        self.capacity = capacity
        left = dict(demand)
        keys, uses, bases, offsets = [], [], [], []
        self.sequences = 0
        shift = self.shift = max([1, *demand.values()]) + 1  # (length, rank) as one sortable number
        full = demand.get(capacity, 0)
        found = column_generation({k: n for k, n in demand.items() if k < capacity}, capacity, gap)
        for pattern, x in sorted([({capacity: 1}, float(full)), *found], key=lambda p: sorted(p[0].items())):
            times = min([int(x + 1e-6), *(left.get(k, 0) // c for k, c in pattern.items())])
            if times <= 0 or capacity - sum(k * c for k, c in pattern.items()) > slack:
                continue
            at = 0
            for length, count in sorted(pattern.items(), reverse=True):
                keys.append(length * shift + demand[length] - left[length])
                uses.append(count)
                bases.append(self.sequences)
                offsets.append(at)
                left[length] -= count * times
                at += length * count
            self.sequences += times
        order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
        self.keys, self.uses, self.bases, self.offsets = (np.array(x, np.int64)[order] for x in (keys, uses, bases, offsets))
        self.covered = np.zeros(capacity + 1, np.int64)
        self.laid = np.zeros(capacity + 1, np.int64)  # where the left-over pieces of each length begin, end to end
        at = 0
        for length in range(1, capacity + 1):
            self.covered[length] = demand.get(length, 0) - left.get(length, 0)
            self.laid[length] = at
            at += length * left.get(length, 0)
        self.whole = at // capacity
        tail, bounds = at % capacity, [self.whole * capacity]
        for bit in range(tail.bit_length() - 1, -1, -1):
            if tail >> bit & 1:
                bounds.append(bounds[-1] + (1 << bit))
        self.tail = np.array(bounds, np.int64)

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece, or -1 and its place among the left-over tokens."""
        over = ranks >= self.covered[lengths]
        at = self.laid[lengths] + (ranks - self.covered[lengths]) * lengths
        if not len(self.keys):
            return np.full(len(lengths), -1), at
        key = lengths * self.shift + ranks
        i = np.maximum(np.searchsorted(self.keys, key, side="right") - 1, 0)
        nth = key - self.keys[i]
        sequence = self.bases[i] + nth // self.uses[i]
        offset = self.offsets[i] + nth % self.uses[i] * lengths
        return np.where(over, -1, sequence), np.where(over, at, offset)

    def cuts(self, at: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(sequence, offset, from, to) of the parts of a left-over piece that lies at ``at``."""
        done = 0
        while done < length:
            place = at + done
            if place < self.whole * self.capacity:
                nth, begin = divmod(place, self.capacity)
                room = self.capacity - begin
            else:
                k = int(np.searchsorted(self.tail, place, side="right")) - 1
                nth, begin, room = self.whole + k, int(place - self.tail[k]), int(self.tail[k + 1] - place)
            take = min(room, length - done)
            yield self.sequences + nth, begin, done, done + take
            done += take


_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, file string, part long, local long, ids binary"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(path: str, separator: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, part, enc = "", TaskContext.get().partitionId(), encoder(path)
        end, seen = np.asarray([separator], enc.dtype).tobytes(), np.zeros(capacity + 1, np.int64)
        last = (None, 0)
        for batch in batches:
            rows: list[tuple] = []
            ordered = batch.num_columns > 2
            places = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) if ordered else repeat(last)
            for doc_id, data, place in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), places):
                if ordered:
                    if place != (last[0], last[1] + 1):  # a stretch of a file begins; a task may read several
                        (file, part), seen = place, np.zeros(capacity + 1, np.int64)
                    last = place
                raw, width = data + end, enc.width
                ids = np.frombuffer(raw, enc.dtype).astype("<u4")
                n, view = len(ids), memoryview(ids).cast("B")
                for start in range(0, n, capacity):
                    size = min(capacity, n - start)
                    part_ids = view[4 * start : 4 * (start + size)]
                    rows.append((doc_id, start, size, zlib.crc32(part_ids), n, file, part, int(seen[size]), raw[width * start : width * (start + size)] if size < capacity else None))
                    seen[size] += 1
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "file", "part", "local", "ids")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))

    return run


def _place(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            lengths = got["length"].to_numpy().astype(np.int64)
            sequence, offset = plan.places(lengths, got["rank"].to_numpy())
            doc, start, crc, n = (got[k].to_pylist() for k in ("doc_id", "start", "ids_crc32", "doc_tokens"))
            rows = []
            for i, s in enumerate(sequence.tolist()):
                if s >= 0:
                    rows.append((doc[i], start[i], int(lengths[i]), crc[i], n[i], s, int(offset[i])))
                    continue
                ids = got["ids"][i].as_py()
                ids = np.frombuffer(ids, f"<u{len(ids) // int(lengths[i])}").astype("<u4").tobytes()
                for nth, begin, a, b in plan.cuts(int(offset[i]), int(lengths[i])):
                    whole = a == 0 and b == lengths[i]
                    rows.append((doc[i], start[i] + a, b - a, crc[i] if whole else zlib.crc32(ids[4 * a : 4 * b]), n[i], nth, begin))
            if rows:
                names = [x.split()[0] for x in _PACKED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return run


def pack(
    docs: DataFrame,
    *,
    vocabulary: str | None = None,
    separator: int = 0,
    capacity: int = CAPACITY,
    slack: int = SLACK,
    gap: float = GAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_order: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``keep_order`` is for rows read from Parquet files: pieces of one length are ranked by file
    name and row, however the files were dealt to tasks, so a stored order goes on in the sequences.

    Tokens are made once and stored with their pieces in the shared folder; only the
    length histogram comes to the driver, and only the plan (at most ``capacity`` patterns)
    goes out.
    """
    common.small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if keep_order:
        place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *place)
    pieces = common.stored(rows.mapInArrow(_cut(path, separator, capacity), _PIECES), "pieces")
    counts = pieces.groupBy("file", "part", "length").agg(F.count("*").alias("n"))
    demand = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("file", "part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["file", "part", "length"]).withColumn("rank", F.col("first") + F.col("local"))
    return ranked.mapInArrow(_place(Plan(demand, capacity, slack, gap)), _PACKED)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all ``documents`` into sequences of 1024 tokens."""
    return pack(common.table(spark, sf_dir, "documents"))
