"""Removal of repeated word passages by fixed-block anchors.

Every word covered by a window of ``window`` words whose sequence also starts anywhere
else in the corpus is removed; windows are judged on the input.  Every text is cut into
non-overlapping reference blocks of ``(window + 1) // 2`` words, short enough that any
window contains a whole one.  The blocks of the whole corpus are the index; every rolling
window of a block's length of every text probes it (the census of
:mod:`millrace.llm.repeats`).  A block that some other place holds too is a hit.  The hits
are extended to both sides, word by word, over the real words: all places of a block are
refined together by their next word, so a block with a great many places costs a sort for
each word and never a pair of places.  Places that stay together over a whole window are
exact repeats; windows that overlap make up the maximal ones.

Defined edge cases: null counts as no words; texts with fewer words than the window keep
all; very long texts are one row of a chunk of their own; repeated rows are twins of each
other; null document ids are kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .repeats import SLICE, TABLE, Segments, Units, covered, ends_of, least_runs, repeated, runs_of, spans, spans_of

WINDOW = 35
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _join(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """Words with one blank between them and a line end after the last; only ASCII white space separates."""
    parts = [b" ".join((t or "").encode().split()) for t in texts]
    return b"".join([p + b"\n" for p in parts if p]), np.array([len(p) + 1 if p else 0 for p in parts], np.int64)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in what ``_join`` returns, or in a stretch of it."""
    ends = np.flatnonzero((data == 32) | (data == 10))
    if len(data) and (not len(ends) or ends[-1] != len(data) - 1):
        ends = np.append(ends, len(data))
    return np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1] + 1]), ends


def _words_of(data: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of words of each text."""
    return np.diff(np.searchsorted(ends, np.concatenate([[0], np.cumsum(sizes)])))


def _hashes(data: np.ndarray, sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word's place: the hash of the ``block`` words from it on, whether they are one text's, and the texts' ends."""
    starts, ends = word_bounds(data)
    n_words = _words_of(data, sizes, ends)
    words, at = np.empty(len(ends), np.uint64), 0
    while at < len(ends):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + SLICE)))
        words[at:stop] = spans(TABLE[data[low : ends[stop - 1]]], starts[at:stop] - low, ends[at:stop] - low)
        at = stop
    hashes = runs_of(words, block)
    limits = ends_of(n_words)
    return hashes, limits[: len(hashes)] >= np.arange(block, len(hashes) + block), limits


def probes(block: int):
    """For the census: rolling windows of ``block`` words, and which of them are reference blocks."""

    def run(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, inside, limits = _hashes(data, sizes, block)
        n_words = _words_of(data, sizes, word_bounds(data)[1])
        starts = np.repeat(np.cumsum(n_words) - n_words, n_words)[: len(hashes)]
        reference = (np.arange(len(hashes)) - starts) % block == 0
        return hashes[inside], reference[inside]

    return run


def stretches(window: int, block: int):
    """Segments of the windows by the least of their hits."""

    def run(data: np.ndarray, sizes: np.ndarray, wanted) -> Segments:
        hashes, inside, limits = _hashes(data, sizes, block)
        hit = np.zeros(len(hashes), bool)
        at = np.flatnonzero(inside)
        hit[at] = wanted(hashes[at])
        return least_runs(hashes, hit, limits, window, block)

    return run


def _numbers(values: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A number for each different pair."""
    return np.unique(values * (int(more.max(initial=0)) + 1) + more, return_inverse=True)[1]


def repeated_windows(texts: list[bytes], counts: np.ndarray, offsets: np.ndarray, groups: np.ndarray, window: int) -> list[np.ndarray]:
    """For each text, which of its windows occur twice; ``counts`` copies, the hit block at word ``offsets``, of ``groups`` alike.

    The blocks are compared as words, then the texts are told apart by one word more to the
    left and to the right at a time.
    """
    block = (window + 1) // 2
    width = window - block + 1
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = word_bounds(data)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    n_words = np.diff(np.searchsorted(ends, np.concatenate([[0], np.cumsum(sizes)])))
    first = np.cumsum(n_words) - n_words
    # words as numbers: equal numbers are equal words; each word keeps a separator behind it, which is made the same
    same = data.copy()
    same[ends] = 32
    cuts = np.append(starts, ends[-1] + 1).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(cuts), pa.py_buffer(same)]).dictionary_encode().indices.to_numpy().astype(np.int64)
    anchor = first + offsets
    core = groups.astype(np.int64)
    for k in range(block):
        core = _numbers(core, words[anchor + k])

    def sides(step: int, room: np.ndarray) -> list[np.ndarray]:
        """Numbers of the block with 0, 1, ... words more on one side; -1 where the text ends before."""
        out = [core]
        for k in range(1, width):
            have = np.flatnonzero(room >= k)
            now = np.full(len(core), -1)
            now[have] = _numbers(out[-1][have], words[anchor[have] + (-k if step < 0 else block - 1 + k)])
            out.append(now)
        return out

    left, right = sides(-1, offsets), sides(1, n_words - offsets - block)
    total = np.cumsum(n_words - window + 1) - (n_words - window + 1)
    again = np.zeros(int((n_words - window + 1).sum()), bool)
    for k in range(width):
        a, b = left[k], right[width - 1 - k]
        have = np.flatnonzero((a >= 0) & (b >= 0))
        which = _numbers(a[have], b[have])
        often = np.bincount(which, counts[have])[which] > 1
        again[total[have] + offsets[have] - k] = often
    return [again[a:b] for a, b in zip(total.tolist(), np.append(total[1:], len(again)).tolist())]


def remove_passages(docs: DataFrame, *, window: int = WINDOW, text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256; with ``text`` also the words kept and the spans."""
    block = (window + 1) // 2
    units = Units(window, block, _join, word_bounds, None, probes(block), stretches(window, block), repeated_windows)
    found = repeated(docs, units, id_col=id_col, text_col=text_col)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, spans array<struct<first:bigint,last:bigint>>" * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, data, at, digests, found = batch.columns
            for i in range(batch.num_rows):
                key = np.frombuffer(ids[i].as_buffer(), "<i8").reshape(-1, 2)
                size, raw = np.frombuffer(sizes[i].as_buffer(), "<i8"), np.frombuffer(data[i].as_buffer(), np.uint8)
                starts, ends = word_bounds(raw)
                n_words = _words_of(raw, size, ends)
                gone = covered(len(ends), at[i].as_py(), digests[i].as_py(), found[i].values, window)
                # each word goes with the separator behind it; the last one of a text is dropped
                keep = np.repeat(~gone, ends + 1 - starts)
                kept = memoryview(raw[keep])
                cuts = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(size)])].tolist()
                parts = [kept[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:])]
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], np.cumsum(n_words)])])
                columns = [
                    pa.array(key[:, 0], mask=key[:, 1] != 0),
                    pa.array(n_words),
                    pa.array(removed),
                    pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
                ]
                if text:
                    spans = [[] for _ in parts]
                    for d, a, b in zip(*(x.tolist() for x in spans_of(gone, n_words))):
                        spans[d].append({"first": a, "last": b})
                    columns += [pa.array([bytes(p).decode() for p in parts], pa.string()), pa.array(spans, _SPANS)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"][: len(columns)])

    return found.mapInArrow(run, schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeats of 35 words over all ``documents``."""
    return remove_passages(common.table(spark, sf_dir, "documents"))


#: Windows of 35 words as strings; no word holds a blank.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
word AS (SELECT r, unnest(generate_series(1, len(words))) AS p, unnest(words) AS w FROM d),
win AS (
  SELECT r, p, w, CASE WHEN count(*) OVER s = 35 THEN md5_number(string_agg(w, ' ') OVER s) END AS k FROM word
  WINDOW s AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
twice AS (SELECT k FROM win WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
marked AS (
  SELECT r, p, w, max(t.k IS NOT NULL) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM win LEFT JOIN twice t ON t.k = win.k),
made AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN made USING (r)
"""
