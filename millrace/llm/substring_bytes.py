"""Removal of repeated byte strings: shards are sorted by external induced sorting.

Every byte covered by a ``window``-byte string that also starts anywhere else in the
corpus is removed; strings are judged on the input.  Candidates and shards are those of
:mod:`millrace.llm.repeats`: the least hash of the runs of ``gram`` bytes in a window is its
anchor.  Within a shard :func:`millrace.llm.induced.repeated_windows` sorts the suffixes
and reads the repeats off their common-prefix values and numbers.

Defined edge cases: null counts as empty; texts shorter than the window keep all; very
long texts are one row of a chunk of their own and are hashed in slices; bytes are removed
even inside a character; repeated rows are twins of each other, so both lose whatever is
long enough; null document ids are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .induced import repeated_windows
from .repeats import SLICE, TABLE, Segments, Units, covered, ends_of, least_runs, repeated, runs_of, spans_of

WINDOW = 200
GRAM = 50
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _join(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    parts = [(t or "").encode() for t in texts]
    return b"".join(parts), np.array([len(p) for p in parts], np.int64)


def anchors(window: int, gram: int, slice_units: int = SLICE):
    """Segments of the windows of ``window`` bytes by their least run of ``gram`` bytes."""

    def mark(data: np.ndarray, sizes: np.ndarray) -> Segments:
        limits, found = ends_of(sizes), []
        for at in range(0, max(1, len(data) - window + 1), slice_units):
            stop = min(len(data), at + slice_units + window - 1)
            seg = least_runs(runs_of(TABLE[data[at:stop]], gram), None, limits[at:stop] - at, window, gram)
            found.append(Segments(seg.place + at, seg.n, seg.offset, seg.hash))
        return Segments(*(np.concatenate([getattr(s, k) for s in found]) for k in ("place", "n", "offset", "hash")))

    return mark


def _solve(texts: list[bytes], counts: np.ndarray, offsets: np.ndarray, groups: np.ndarray, window: int) -> list[np.ndarray]:
    return repeated_windows(texts, window, counts=counts)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``text`` also the bytes kept and the spans."""
    units = Units(window, gram, _join, None, anchors(window, gram), None, None, _solve)
    found = repeated(docs, units, id_col=id_col, text_col=text_col)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<first:bigint,last:bigint>>" * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, data, at, digests, found = batch.columns
            for i in range(batch.num_rows):
                key = np.frombuffer(ids[i].as_buffer(), "<i8").reshape(-1, 2)
                size, raw = np.frombuffer(sizes[i].as_buffer(), "<i8"), np.frombuffer(data[i].as_buffer(), np.uint8)
                gone = covered(len(raw), at[i].as_py(), digests[i].as_py(), found[i].values, window)
                kept = memoryview(raw[~gone])
                sums = np.concatenate([[0], np.cumsum(~gone)])
                ends = np.concatenate([[0], np.cumsum(size)])
                cuts = sums[ends].tolist()
                of, first, last = spans_of(gone, size)
                parts = [kept[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                columns = [
                    pa.array(key[:, 0], mask=key[:, 1] != 0),
                    pa.array(size.astype(np.int64)),
                    pa.array(size - np.diff(cuts)),
                    pa.array(np.bincount(of, minlength=len(size))),
                    pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
                ]
                if text:
                    spans = [[] for _ in parts]
                    for d, a, b in zip(of.tolist(), first.tolist(), last.tolist()):
                        spans[d].append({"first": a, "last": b})
                    columns += [pa.array([bytes(p) for p in parts], pa.binary()), pa.array(spans, _SPANS)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: len(columns)])

    return found.mapInArrow(run, schema)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeats of 200 bytes over all ``documents``."""
    return remove_repeats(common.table(spark, sf_dir, "documents"))


#: Strings of 200 bytes by their digests; texts are cut into pieces first, since a place in a short string is found faster.
OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (
  SELECT r, k, substr(h, 2 * k + 1, 2 * (64 + 199)) AS s, least(64, length(h) // 2 - k) AS n
  FROM (SELECT r, h, unnest(generate_series(0, length(h) // 2 - 1, 64)) AS k FROM d)),
byte AS (SELECT r, k + i AS p, substr(s, 2 * i + 1, 2) AS b, substr(s, 2 * i + 1, 400) AS w FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM part)),
win AS (SELECT r, p, b, CASE WHEN length(w) = 400 THEN md5_number(w) END AS w FROM byte),
twice AS (SELECT w FROM win WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1),
marked AS (
  SELECT r, p, b, max(t.w IS NOT NULL) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone
  FROM win LEFT JOIN twice t ON t.w = win.w),
runs AS (SELECT r, p, b, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS opens FROM marked),
made AS (
  SELECT r, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
         string_agg(b, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN made USING (r)
"""
