"""Token-id files with directly addressable codes.

A file holds the ids of whole documents.  Every id is split into 8-bit chunks, lowest
first.  Level ``k`` stores the ``k``-th chunk of each id that has one, a bitmap telling
which of those ids continue on level ``k + 1``, and a rank directory with the number of
set bits before each block of 512; so the place of an id on the next level is one
directory entry plus the bits of at most eight words, and any token is read without
decoding its neighbours.

Layout, little-endian: ``b"MRDAC001"``; number of documents, tokens and levels as u64;
document ids i64, their null flags u8 (padded to 8), document starts u64 (one more than
documents); then per level its length u64, chunks u8 (padded to 8), and on all but the
last level the bitmap (whole 512-bit blocks) and the directory u64.

Defined edge cases: a null text counts as empty and still gets the end id; null document
ids come first and are kept as nulls; a very long text is whole in one file, which may then hold
more than its share; rows with equal ids follow each other in order of
their text; an empty table writes no file and yields no row; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import default_vocabulary, encoder

MAGIC = b"MRDAC001"
BLOCK = 512
#: Tokens after which a task starts a new file, so that a file fits one task's memory when read.
FILE_TOKENS = 4_000_000


def _pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def encode_file(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file: ``starts`` has one entry more than ``doc_ids``; ``ids`` are unsigned."""
    out = io.BytesIO()
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        last = not more.any()
        levels.append((rest.astype(np.uint8), None if last else more))
        if last:
            break
        rest = rest[more] >> 8
    out.write(MAGIC + struct.pack("<QQQ", len(doc_ids), len(ids), len(levels)))
    out.write(np.asarray([0 if x is None else x for x in doc_ids], "<i8").tobytes())
    out.write(_pad(np.asarray([x is None for x in doc_ids], np.uint8).tobytes()))
    out.write(np.asarray(starts, "<u8").tobytes())
    for chunks, more in levels:
        out.write(struct.pack("<Q", len(chunks)) + _pad(chunks.tobytes()))
        if more is not None:
            padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, bool)
            padded[: len(more)] = more
            counts = padded.reshape(-1, BLOCK).sum(1, dtype=np.uint64)
            out.write(np.packbits(padded, bitorder="little").tobytes())
            out.write((np.cumsum(counts, dtype=np.uint64) - counts).astype("<u8").tobytes())
    return out.getvalue()


class TokenFile:
    """Reads a file; ``token`` and ``slice`` touch only what they return."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_tokens, n_levels = struct.unpack_from("<QQQ", data, 8)
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += -(-got.nbytes // 8) * 8
            return got

        ids, nulls = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if null else int(x) for x, null in zip(ids, nulls)]
        self.starts = take("<u8", n_docs + 1)
        self._levels = []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks, bits, directory = take("u1", n), None, None
            if k + 1 < n_levels:
                blocks = -(-n // BLOCK)
                bits, directory = take("u1", blocks * BLOCK // 8), take("<u8", blocks)
            self._levels.append((chunks, bits, directory))

    def _rank(self, k: int, i: int) -> int:
        """Set bits of level ``k`` before position ``i``."""
        _, bits, directory = self._levels[k]
        block = i // BLOCK
        if block >= len(directory):
            return len(self._levels[k + 1][0])
        first = block * BLOCK // 8
        word = int.from_bytes(bits[first : i // 8 + 1].tobytes(), "little")
        return int(directory[block]) + (word & ((1 << (i - block * BLOCK)) - 1)).bit_count()

    def token(self, i: int) -> int:
        """Token ``i`` of the file."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for k, (chunks, bits, _) in enumerate(self._levels):
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(k, i), shift + 8
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Tokens ``start`` to ``stop`` as u32, from the matching part of every level."""
        spans = [(start, stop)]
        for k in range(len(self._levels) - 1):
            a, b = spans[-1]
            spans.append((self._rank(k, a), self._rank(k, b)))
        above = np.zeros(0, np.uint32)
        for k in range(len(self._levels) - 1, -1, -1):
            (a, b), (chunks, bits, _) = spans[k], self._levels[k]
            value = chunks[a:b].astype(np.uint32)
            if bits is not None and b > a:
                more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
                value[more] |= above << np.uint32(8)
            above = value
        return above

    def document(self, k: int) -> np.ndarray:
        """All tokens of the file's ``k``-th document."""
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


#: What Spark's readers call some file systems, and their names here.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _write(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    scheme, colon, rest = folder.partition("://")
    where, path = fs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + colon + rest)
    where.create_dir(path, recursive=True)
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    try:
        with where.open_output_stream(draft) as out:
            out.write(data)
        where.move(draft, f"{path}/{name}")  # a task that runs twice leaves the same file
    except BaseException:
        with contextlib.suppress(OSError):
            where.delete_file(draft)
        raise


_MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long"


def write_token_files(
    docs: DataFrame,
    folder: str,
    *,
    vocabulary: str | None = None,
    end_id: int = 2,
    file_tokens: int = FILE_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the ids of ``docs`` in ascending id order to ``folder``; returns the stored manifest of files.

    ``folder`` must be one that pyarrow's file systems reach from every executor.  Texts
    are dealt out by id range, so tasks work on consecutive runs of documents and a
    task holds one file's ids at most.
    """
    common.small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, enc = TaskContext.get().partitionId(), 0, encoder(path)
        end = np.asarray([end_id], enc.dtype).tobytes()
        names: list[int | None] = []
        pieces: list[bytes] = []
        sizes = [0]

        def flush() -> pa.RecordBatch:
            nonlocal seq
            ids = np.frombuffer(b"".join(pieces), enc.dtype)
            name = f"part-{part:06d}-{seq:06d}.dac"
            _write(folder, name, encode_file(names, np.cumsum(sizes), ids))
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "n_docs": [len(names)], "n_tokens": [len(ids)]}
            )
            seq += 1
            names.clear()
            pieces.clear()
            sizes[1:] = []
            return row

        held = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, data in zip(ids, enc.encode(batch.column(1).to_pylist())):
                names.append(doc_id)
                pieces.append(data + end)
                sizes.append(len(data) // enc.width + 1)
                held += sizes[-1]
                if held >= file_tokens:
                    yield flush()
                    held = 0
        if names:
            yield flush()

    return common.stored(rows.mapInArrow(run, _MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32, file, index."""
    spark = manifest.sparkSession
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    parts = parts.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    files = files.join(parts, "part").select("file", (F.col("before") + F.col("within")).alias("first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = TokenFile(content.as_buffer())
                ids, starts = got.slice(0, got.n_tokens).astype("<u4"), got.starts.astype(np.int64)
                view = memoryview(ids).cast("B")
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": [name] * n,
                        "index": pa.array(np.arange(n, dtype=np.int64)),
                        "doc_id": pa.array(got.doc_ids, pa.int64()),
                        "local": pa.array(starts[:-1]),
                        "n_tokens": pa.array(np.diff(starts)),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                )

    schema = "file string, index long, doc_id long, local long, n_tokens long, ids_crc32 long"
    if manifest.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string, index long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
    found = found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")
    rows = found.mapInArrow(decode, schema).join(files, "file")
    return rows.select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "file", "index")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """Write all ``documents`` as token files in the shared folder and digest them from what is read back."""
    folder = common.new_path(spark, "token-files")
    return read_token_files(write_token_files(common.table(spark, sf_dir, "documents"), folder), folder)
