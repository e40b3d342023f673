"""Induced sorting of suffixes with common-prefix values, through disk-backed queues.

The suffixes of a shard are sorted by induction: those at local minima (leftmost S) are
put in order first, and all others follow from two scans.  A scan reads tuples (position,
common prefix with the tuple before) bucket by bucket and puts the suffix one place to the
left into the bucket of its first symbol.  Tuples enter a bucket in sorted order, so a
bucket is a first-in-first-out run of a monotone priority queue; runs beyond
``memory_bytes`` go to a temporary file and come back when their bucket is scanned.  The
common prefix of two induced suffixes is one more than the least value between their
sources.  Values are capped at ``cap``, the length that the caller asks about.

The order of the local minima comes from their substrings, sorted by the same induction,
named, and - where names repeat - by doubling ranks of the names over as many symbols as
the cap needs.  (The reduced string's alphabet has about as many symbols as the string, so
its own bucket scans would be one Python step for each suffix; doubling does the same
recursion's work in whole arrays.)

All steps work on numpy arrays of a bucket; none is a Python step for each suffix.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

SEPARATOR, SENTINEL = 1, 0
_TOP = 258
#: Bytes of tuples that a queue holds before older runs go to disk; a shard of 4 MB has about 20 MB of them.
QUEUE_BYTES = 4 << 20


class Queues:
    """First-in-first-out runs of (position, common prefix) by symbol; old runs are on disk."""

    def __init__(self, memory_bytes: int):
        self._runs: list[list] = [[] for _ in range(_TOP)]
        self._held, self._most = 0, memory_bytes
        self._file = None

    def put(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self._runs[symbol].append((positions, prefixes))
        self._held += positions.nbytes + prefixes.nbytes
        if self._held > self._most:
            self._spill()

    def _spill(self) -> None:
        if self._file is None:
            self._file = tempfile.TemporaryFile(dir=os.environ.get("TMPDIR"))
        self._file.seek(0, os.SEEK_END)
        for runs in self._runs:
            for i, run in enumerate(runs):
                if not isinstance(run[0], int):
                    at = self._file.tell()
                    self._file.write(np.ascontiguousarray(run[0]).tobytes() + np.ascontiguousarray(run[1]).tobytes())
                    runs[i] = (at, len(run[0]))
        self._held = 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a bucket so far, which leave the queue."""
        runs, self._runs[symbol] = self._runs[symbol], []
        found = []
        for run in runs:
            if isinstance(run[0], int):
                self._file.seek(run[0])
                found.append((np.frombuffer(self._file.read(4 * run[1]), np.int32), np.frombuffer(self._file.read(run[1]), np.uint8)))
            else:
                self._held -= run[0].nbytes + run[1].nbytes
                found.append(run)
        if len(found) == 1:
            return found[0]
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.uint8)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


class _Scan:
    """One direction of induction: puts the left neighbours of scanned suffixes into their buckets."""

    def __init__(self, text: np.ndarray, small: np.ndarray, want_small: bool, cap: int, queues: Queues, values: bool):
        self.text, self.small, self.want, self.cap, self.queues, self.values = text, small, want_small, cap, queues, values
        self.since = np.full(_TOP, 255, np.uint8)  # least value since the last tuple of each symbol

    def feed(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        left = positions - 1
        ok = left >= 0
        ok &= self.small[left] == self.want
        at = np.flatnonzero(ok)
        m = len(positions)
        if self.values:
            everything = prefixes.min() if m else 255
        if not len(at):
            if self.values:
                np.minimum(self.since, everything, out=self.since)
            return
        left = left[at]
        symbols = self.text[left]
        order = np.argsort(symbols, kind="stable")
        at, left, symbols = at[order], left[order], symbols[order]
        cuts = np.concatenate([[0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1])
        ends = np.concatenate([cuts[1:], [len(at)]])
        value = np.zeros(len(at), np.uint8)
        if self.values:
            heads = np.minimum.accumulate(prefixes)
            tails = np.minimum.accumulate(prefixes[::-1])[::-1]
            value[1:] = _range_min(prefixes, at[:-1] + 1, at[1:])
            firsts = symbols[cuts]
            value[cuts] = np.minimum(self.since[firsts], heads[at[cuts]])
            np.minimum(self.since, everything, out=self.since)
            last = at[ends - 1] + 1
            self.since[firsts] = np.where(last < m, tails[np.minimum(last, m - 1)], 255)
            value = np.minimum(value.astype(np.int16) + 1, self.cap).astype(np.uint8)
        for symbol, a, b in zip(symbols[cuts].tolist(), cuts.tolist(), ends.tolist()):
            self.queues.put(symbol, left[a:b], value[a:b])


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``values[first..last]`` for each pair; pairs that are not in order give any value."""
    width = np.maximum(last - first + 1, 1)
    level = np.log2(width).astype(np.int8)
    out = np.zeros(len(first), np.uint8)
    row, step = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        hit = np.flatnonzero(level == k)
        if len(hit):
            a = first[hit]
            b = np.maximum(last[hit] - step + 1, a)
            out[hit] = np.minimum(row[np.minimum(a, len(row) - 1)], row[np.minimum(b, len(row) - 1)])
        if len(row) > step:
            row = np.minimum(row[:-step], row[step:])
            step *= 2
        else:
            break
    return out


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, up to ``cap``, eight bytes at a time."""
    out = np.zeros(len(a), np.int64)
    live, top = np.arange(len(a)), len(words) - 1
    for done in range(0, cap, 8):
        differ = words[np.minimum(a[live] + done, top)] ^ words[np.minimum(b[live] + done, top)]
        same = differ == 0
        rest = live[~same]
        # little-endian words: the first differing byte is the lowest one
        bit = np.log2((differ[~same] & (~differ[~same] + np.uint64(1))).astype(np.float64)).astype(np.int64)
        out[rest] = done + bit // 8
        live = live[same]
        out[live] = done + 8
        if not len(live):
            break
    return np.minimum(out, cap)


def _scan_all(text: np.ndarray, small: np.ndarray, minima: np.ndarray, prefixes: np.ndarray, words: np.ndarray, cap: int, memory: int, values: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all suffixes in falling order: (positions, common prefix with the next smaller one)."""
    symbols = np.unique(text).tolist()
    bounds = np.searchsorted(text[minima], np.arange(_TOP + 1))
    larger, kept = Queues(memory), Queues(memory)
    scan = _Scan(text, small, False, cap, larger, values)
    for c in symbols:
        last = None
        while True:
            positions, value = larger.take(c)
            if not len(positions):
                break
            if last is None:
                value = value.copy()
                value[0] = 0
            kept.put(c, positions, value)
            last = positions[-1:]
            scan.feed(positions, value)
        seeds, value = minima[bounds[c] : bounds[c + 1]], prefixes[bounds[c] : bounds[c + 1]].copy()
        if len(seeds):
            value[0] = 0 if last is None or not values else _common(words, last.astype(np.int64), seeds[:1].astype(np.int64), cap)[0]
            scan.feed(seeds, value)
    larger.close()
    smaller = Queues(memory)
    scan = _Scan(text, small, True, cap, smaller, values)
    for c in reversed(symbols):
        s_parts, s_values, first = [], [], True
        while True:
            positions, value = smaller.take(c)
            if not len(positions):
                break
            if first:
                value, first = value.copy(), False
                value[0] = 0
            s_parts.append(positions)
            s_values.append(value)
            scan.feed(positions, value)
        positions, value = kept.take(c)
        positions, value = positions[::-1], value[::-1]  # value: with the next one, which is smaller
        if len(positions):
            up = np.empty_like(value)  # value with the one scanned before, which is larger
            up[1:] = value[:-1]
            up[0] = 0
            if s_parts and values:
                up[0] = _common(words, positions[:1].astype(np.int64), s_parts[-1][-1:].astype(np.int64), cap)[0]
            scan.feed(positions, up)
        parts = [*s_parts, positions]
        together = np.concatenate(parts)
        if len(together):
            before = np.concatenate([*s_values, up if len(positions) else value])  # with the larger neighbour
            yield together, before
    smaller.close()
    kept.close()


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last counts as small."""
    n = len(text)
    rise = np.empty(n, bool)
    differs = np.empty(n, bool)
    rise[:-1], differs[:-1] = text[:-1] < text[1:], text[:-1] != text[1:]
    rise[-1] = differs[-1] = True
    at = np.where(differs, np.arange(n), n)
    return rise[np.minimum.accumulate(at[::-1])[::-1]]


def sorted_suffixes(text: np.ndarray, cap: int, memory_bytes: int = QUEUE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of ``text`` by buckets in falling order.

    ``text``: symbols below 258 as u16, of which the last is the only ``SENTINEL``.  Yields
    positions in falling order of their suffixes, and for each its common prefix, up to
    ``cap`` (at most 254), with the suffix before it (0 at the start of a bucket); the
    sentinel itself is left out.
    Suffixes that agree in their first ``cap`` symbols may come in any order.
    """
    if cap > 254:
        raise ValueError("values are held in one byte")
    n = len(text)
    small = _types(text)
    low = np.zeros(n, bool)
    low[1:] = small[1:] & ~small[:-1]
    minima = np.flatnonzero(low).astype(np.int32)
    if n == 1:
        return
    # symbols as bytes for comparing: separators and the sentinel become bytes that no text has
    raw = np.concatenate([np.where(text >= 2, text - 2, 255 - text).astype(np.uint8), np.zeros(cap + 16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))
    words = np.ascontiguousarray(words).view("<u8").reshape(-1) if n < 1 << 16 else _rolling_words(raw)
    first = minima[np.argsort(text[minima], kind="stable")]
    found = [p[low[p]] for p, _ in _scan_all(text, small, first, np.zeros(len(first), np.uint8), words, cap, memory_bytes, False)]
    order = np.concatenate([*found, [n - 1]])[::-1]  # the scans leave the sentinel out
    # names: equal for equal substrings from one minimum to the next
    rank_of = np.zeros(n, np.int32)
    rank_of[minima] = np.arange(len(minima))
    ends = np.append(minima[1:], n - 1)
    size = (ends - minima + 1).astype(np.int64)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    sizes = size[rank_of[order]]
    same = sizes[:-1] == sizes[1:]
    check = np.flatnonzero(same)
    longest = int(sizes[check].max(initial=0))
    live = check
    for step in range(longest):
        live = live[sizes[live] > step]
        if not len(live):
            break
        equal = text[a[live] + step] == text[b[live] + step]
        same[live[~equal]] = False
        live = live[equal]
    # a name is the place of the first that bears it
    heads = np.flatnonzero(np.append(True, ~same))
    group = np.append(0, np.cumsum(~same))
    names = np.empty(len(minima), np.int64)
    names[rank_of[order]] = heads[group]
    shared = np.zeros(len(minima), bool)
    shared[rank_of[order]] = np.diff(np.append(heads, len(minima)))[group] > 1
    todo = np.flatnonzero(shared)  # only names that several bear are looked at again
    reach = 1  # names that a rank covers; each covers at least one symbol more than it shares with the next
    while reach <= cap and len(todo):
        after = todo + reach
        key = names[todo] * (len(names) + 1) + np.where(after < len(names), names[np.minimum(after, len(names) - 1)] + 1, 0)
        by = np.argsort(key)
        todo, key = todo[by], key[by]
        old = names[todo]
        new_head = np.append(True, key[1:] != key[:-1])
        old_head = np.append(True, old[1:] != old[:-1])
        at = np.arange(len(todo))
        names[todo] = old + np.maximum.accumulate(np.where(new_head, at, 0)) - np.maximum.accumulate(np.where(old_head, at, 0))
        alone = new_head & np.append(new_head[1:], True)
        todo = todo[~alone]
        reach *= 2
    minima = minima[np.argsort(names, kind="stable")]
    wide = minima.astype(np.int64)
    prefixes = np.zeros(len(minima), np.uint8)
    prefixes[1:] = _common(words, wide[:-1], wide[1:], cap)
    yield from _scan_all(text, small, minima, prefixes, words, cap, memory_bytes, True)


def _rolling_words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number."""
    n = len(raw) - 7
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out |= raw[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return out


def repeated_windows(texts: list[bytes], length: int, memory_bytes: int = QUEUE_BYTES, counts: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text, which of its windows of ``length`` bytes also start anywhere else in ``texts``.

    With ``counts`` a text stands for so many copies: a suffix that several copies have has an equal neighbour.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    total = int(sizes.sum()) + len(texts) + 1
    text = np.full(total, SEPARATOR, np.uint16)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    keep = np.ones(total, bool)
    keep[starts + sizes] = False
    keep[-1] = False
    text[keep] = joined.astype(np.uint16) + 2
    text[-1] = SENTINEL
    again = np.zeros(total, bool)
    if counts is not None:
        several = np.zeros(total, bool)
        several[:-1] = np.repeat(counts > 1, sizes + 1)
    for positions, value in sorted_suffixes(text, length, memory_bytes):
        hit = np.flatnonzero(value >= length)
        again[positions[hit]] = True
        again[positions[hit - 1]] = True
        if counts is not None:
            again[positions[several[positions]]] = True
    return [again[s : s + max(0, k - length + 1)] for s, k in zip(starts.tolist(), sizes.tolist())]
