"""Language identification by prediction by partial matching.

Per language a context tree of orders 0 to 3 over all 256 byte values holds how often each
byte followed each context.  With its counts frozen, a byte's code length in a context is
that of escape method C: a byte seen there costs ``-log2(c / (n + q))``, any other the
escape ``-log2(q / (n + q))`` plus its cost in the next shorter context, down to eight bits
where nothing is known; a context that was never seen costs nothing to leave.  A text's
language is the one whose tree codes the whole text in the fewest bits.

The trees are learned from all labelled rows (nothing is sampled), and their counts are
whole numbers throughout.  They are sparse: what comes to the driver are the different
runs of four bytes in all languages, which a corpus stops adding to; their number is
counted first, and trees over ``max_model_bytes`` raise an error instead of being sent out.

Defined edge cases: ``und`` with score 0 for null texts, texts without a letter, and all
texts if nothing could be learned; equal code lengths go to the first label in order; very
long texts are coded in slices whose lengths add up; a null document id is not held out;
repeated rows count as often as they occur; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 3
UNKNOWN = "und"
#: Largest compiled model that is sent to the executors.
MAX_MODEL_BYTES = 256 << 20
#: Bytes that are scored at once.
_SLICE = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")
_ODD = np.uint32(0x9E3779B1)


def windows(data: bytes) -> np.ndarray:
    """Each run of four bytes as a number, the first byte lowest: the context and, on top, the byte that follows."""
    return np.ndarray((max(0, len(data) - ORDER),), "<u4", data, 0, (1,))


class Index:
    """Finds distinct u32 keys in whole arrays; ``order`` is how the keys are to be laid out."""

    def __init__(self, keys: np.ndarray):
        hashed = keys.astype(np.uint32) * _ODD  # odd: no two keys meet
        self.order = np.argsort(hashed, kind="stable")
        self._hashed = np.append(hashed[self.order], np.uint32(0xFFFFFFFF))
        bits = max(1, min(24, len(keys).bit_length()))
        self._shift = np.uint32(32 - bits)
        self._first = np.searchsorted(self._hashed[:-1], np.arange(1 << bits, dtype=np.uint64) << np.uint64(32 - bits)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is laid out, or -1."""
        hashed = keys * _ODD
        at = self._first[hashed >> self._shift]
        here = self._hashed[at]
        todo = np.flatnonzero(here < hashed)
        while len(todo):
            at[todo] += 1
            here[todo] = self._hashed[at[todo]]
            todo = todo[here[todo] < hashed[todo]]
        at[(here != hashed) | (at == len(self._hashed) - 1)] = -1
        return at


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their total and how many entries they had."""
    kinds, index, entries = np.unique(keys, return_inverse=True, return_counts=True)
    total = np.zeros(len(kinds), np.int64)
    np.add.at(total, index, n)
    return kinds, total, entries


def _at(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of keys among the sorted known ones; 0 for others."""
    if not len(known):
        return np.zeros(len(keys), values.dtype)
    i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[i] == keys, values[i], 0)


def _coded(c: np.ndarray, n: np.ndarray, q: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of bytes with ``c`` of a context's ``n`` counts and ``q`` kinds, given those in the shorter context; bits of the escape."""
    escape = np.where(n > 0, np.log2(np.maximum(n + q, 1) / np.maximum(q, 1)), 0.0)
    return np.where(c > 0, np.log2(np.maximum(n + q, 1) / np.maximum(c, 1)), escape + shorter), escape


class Model:
    """Frozen trees of several languages, compiled to code lengths by run of bytes."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        """``grams``: per language the different runs of four bytes, in rising order, and their numbers."""
        self.languages = sorted(grams)
        every = [grams[x][0].astype(np.uint32) for x in self.languages]
        four = np.unique(np.concatenate([*every, np.zeros(0, np.uint32)]))
        three, contexts = np.unique(four >> np.uint32(8)), np.unique(four & np.uint32(0xFFFFFF))
        self._four, self._three, self._contexts = Index(four), Index(three), Index(contexts)
        many = len(self.languages)
        self._bits1, self._escape2 = np.zeros((1 << 16, many), np.float32), np.zeros((1 << 16, many), np.float32)
        self._bits2, self._bits3 = np.zeros((len(three), many), np.float32), np.zeros((len(four), many), np.float32)
        self._escape3 = np.zeros((len(contexts), many), np.float32)
        for i, language in enumerate(self.languages):
            keys, n = grams[language][0].astype(np.uint32), grams[language][1].astype(np.int64)
            c0 = np.zeros(256, np.int64)
            np.add.at(c0, keys >> np.uint32(24), n)
            bits0, _ = _coded(c0, c0.sum(), (c0 > 0).sum(), np.full(256, 8.0))
            c1 = np.zeros(1 << 16, np.int64)  # the context is the low byte
            np.add.at(c1, keys >> np.uint32(16), n)
            context, byte = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
            n1, q1 = c1.reshape(256, 256).sum(0), (c1 > 0).reshape(256, 256).sum(0)
            bits1, _ = _coded(c1, n1[context], q1[context], bits0[byte])
            mine, c2, _ = _sums(keys >> np.uint32(8), n)
            n2, q2 = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            np.add.at(n2, mine & np.uint32(0xFFFF), c2)
            np.add.at(q2, mine & np.uint32(0xFFFF), 1)
            _, escape2 = _coded(np.zeros(1 << 16), n2, q2, np.zeros(1 << 16))
            under = three & np.uint32(0xFFFF)
            bits2, _ = _coded(_at(three, mine, c2), n2[under], q2[under], bits1[three >> np.uint32(8)])
            known, n3, q3 = _sums(keys & np.uint32(0xFFFFFF), n)
            _, escape3 = _coded(np.zeros(len(contexts)), _at(contexts, known, n3), _at(contexts, known, q3), np.zeros(len(contexts)))
            over = four & np.uint32(0xFFFFFF)
            bits3, _ = _coded(_at(four, keys, n), _at(over, known, n3), _at(over, known, q3), bits2[np.searchsorted(three, four >> np.uint32(8))])
            self._bits1[:, i], self._escape2[:, i] = bits1, escape2
            self._bits2[:, i], self._bits3[:, i], self._escape3[:, i] = bits2[self._three.order], bits3[self._four.order], escape3[self._contexts.order]

    def _lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each run's last byte under each language."""
        at = self._four.find(keys)
        out = self._bits3[np.maximum(at, 0)] if len(self._bits3) else np.zeros((len(keys), len(self.languages)), np.float32)
        new = np.flatnonzero(at < 0)  # no language has this run
        if len(new):
            some = keys[new]
            shorter = some >> np.uint32(8)
            at = self._three.find(shorter)
            bits = self._escape2[shorter & np.uint32(0xFFFF)] + self._bits1[shorter >> np.uint32(8)]
            bits[at >= 0] = self._bits2[at[at >= 0]]
            at = self._contexts.find(some & np.uint32(0xFFFFFF))
            bits[at >= 0] += self._escape3[at[at >= 0]]
            out[new] = bits
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text, none of them empty, under each language; three blanks come before a text."""
        out = np.zeros((len(texts), len(self.languages)))
        batch: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) > _SLICE:
                for at in range(0, len(text), _SLICE):  # a slice takes its context from the one before
                    lead = text[max(0, at - ORDER) : at].rjust(ORDER, b" ")
                    out[i] += self._score([lead + text[at : at + _SLICE]])[0]
                continue
            batch.append(i)
            size += len(text)
            if size > _SLICE:
                out[batch] = self._score([b" " * ORDER + texts[j] for j in batch])
                batch, size = [], 0
        if batch:
            out[batch] = self._score([b" " * ORDER + texts[j] for j in batch])
        return out

    def _score(self, texts: list[bytes]) -> np.ndarray:
        keys, sizes = _own_windows(texts)
        return np.add.reduceat(self._lengths(keys), np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Label and score (the posterior of the label under equal priors) of each text."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        ask = [i for i, x in enumerate(texts) if x and self.languages and _LETTER.search(x)]
        if ask:
            lengths = self.lengths([texts[i].encode() for i in ask])
            best = lengths.argmin(axis=1)
            odds = np.exp2(lengths[np.arange(len(ask)), best][:, None] - lengths).sum(axis=1)
            for i, b, o in zip(ask, best.tolist(), odds.tolist()):
                names[i], scores[i] = self.languages[b], 1.0 / o
        return names, scores


def _own_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of texts that ``ORDER`` bytes of context lead, without those over an end, and how many each has."""
    sizes = np.array([len(x) - ORDER for x in texts])
    keys = windows(b"".join(texts))
    ends = np.cumsum(sizes + ORDER)[:-1]
    keep = np.ones(len(keys), bool)
    for k in range(ORDER):
        keep[ends - ORDER + k] = False
    return keys[keep], sizes


#: Different runs of four bytes that a worker holds before it passes them on.
_HELD = 1 << 20


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def emit(language: str) -> pa.RecordBatch:
        keys, n = held.pop(language)
        return pa.RecordBatch.from_arrays([pa.array([language] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                by.setdefault(language, []).append(b" " * ORDER + text.encode())
        for language, texts in by.items():
            keys, n = np.unique(_own_windows(texts)[0], return_counts=True)
            if language in held:
                more = held[language]
                keys, index = np.unique(np.concatenate([more[0], keys]), return_inverse=True)
                both = np.concatenate([more[1], n])
                n = np.zeros(len(keys), np.int64)
                np.add.at(n, index, both)
            held[language] = keys, n
        if sum(len(k) for k, _ in held.values()) > _HELD:
            for language in list(held):
                yield emit(language)
    for language in list(held):
        yield emit(language)


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_model_bytes: int = MAX_MODEL_BYTES) -> Model:
    """Learn a tree for each label from all rows with a text and a label."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    common.small_batches(rows.sparkSession)
    counts = rows.mapInArrow(_grams, "lang string, gram long, n long")
    counts = common.stored(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    languages = counts.groupBy("lang").agg(F.count("*").alias("c")).orderBy("lang")
    rows, names = counts.select("gram").distinct().count(), languages.limit(1 << 16).select("lang").toArrow().column(0).to_pylist()
    # runs of four bytes, those of three and the contexts, no more of each; two dense tables
    size = (3 * rows + (1 << 17)) * 4 * len(names) + 24 * rows
    if size > max_model_bytes:
        raise ValueError(f"{rows} runs of bytes in {len(names)} languages make a model of {size >> 20} MB")
    grams = {}
    for language in names:
        got = counts.where(F.col("lang") == language).select("gram", "n").orderBy("gram").toArrow()
        grams[language] = (got.column(0).to_numpy(), got.column(1).to_numpy())
    common.discard(counts)
    return Model(grams)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score (which replace columns of these names), without the text unless ``keep_text``."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if (c != text_col or keep_text) and c.lower() not in ("lang_pred", "score")]
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        for batch in batches:
            names, scores = frozen.predict(batch.column(len(keep)).to_pylist())
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"]
            )

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Learn from the labelled two thirds of ``documents`` and predict all of them."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id").alias("held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), train(docs.where("not held_out")))
