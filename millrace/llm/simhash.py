"""SimHash near-duplicate groups, linked through sharded BK-trees.

Each text has a 64-bit fingerprint: a bit is set if it is set in over half of the hashes
of the text's word shingles.  Fingerprints within ``radius`` bits are linked, and linked
groups are connected components.

Two fingerprints that differ in at most two bits agree on two of the four 16-bit blocks,
so the distinct fingerprints are dealt to shards by each pair of blocks (six shards for
each).  A shard builds one BK-tree, whose children are keyed by their integer Hamming
distance to the parent, and a search follows only the edges within the radius of the
query's own distance.  A tree goes to the one task that holds its shard, not to all tasks,
since a corpus's trees have no size bound.  A shard with over ``shard_limit`` members is
split exactly: of three parts of the bits that its members may still differ in, one agrees
for every linked pair; after two splits at most 2**15 distinct fingerprints can be left.
A shard reports a spanning forest of its links, never all pairs.

Blocks of bits single nothing out at a large radius (a similarity of 0.8 is twelve bits).
There shards are dealt out by content instead: each of ``BANDS`` keys of a text is made of
its two least shingle hashes under two orders, so texts with a Jaccard similarity of 0.8
share no key once in 200,000 times, unrelated texts do not meet by chance, and only texts
that share a key and lie within the radius are linked.  In a large shard the members around
one of them are linked to it and leave; what is unlike is cut into bins, and every two bins
meet once.

Defined edge cases: very long texts are hashed whole; null and word-less texts have fingerprint zero, which links like any
other; fewer words than a shingle make one shingle; repeated rows share a fingerprint and
each get a row; null document ids never name a component unless it has no other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import common

SHINGLE_WORDS = 3
RADIUS = 2
#: Members over which a shard is split further.
SHARD_LIMIT = 1000
#: Largest radius at which shards by blocks of bits are exact.
BLOCK_RADIUS = 2
#: Content keys of a text, members of a bin in a large content shard.
BANDS = 12
BIN = 400
_SLICE = 1 << 15
_ORDERS = [pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(2 * BANDS)]


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a whole text, repeats included."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()  # bytes: only A-Z change case, only ASCII white space splits
    if not found:
        return np.zeros(0, np.uint64)
    n = max(1, len(found) - words + 1)
    shingles = map(b" ".join, zip(*(found[i : i + n] for i in range(words)))) if len(found) >= words else iter([b" ".join(found)])
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """The SimHash of a whole text."""
    return summed(shingle_hashes(text, words, seed))


def summed(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes; 0 if there are none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        part = hashes[at : at + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def content_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a text's shingle hashes."""
    least = np.array([(hashes * np.uint64(m)).min() if len(hashes) else 0 for m in _ORDERS], np.uint64)
    keys = (least[0::2] ^ (least[0::2] >> np.uint64(29))) * np.uint64(_ORDERS[1]) + least[1::2]
    return keys * np.uint64(_ORDERS[2]) + np.arange(BANDS, dtype=np.uint64)


class BKTree:
    """Distinct 64-bit integers under Hamming distance."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        listed = values.tolist()
        for i in range(1, len(listed)):
            at = 0
            while True:
                edge = (listed[i] ^ listed[at]).bit_count()
                below = self.children[at].get(edge)
                if below is None:
                    self.children[at][edge] = i
                    break
                at = below

    def links(self, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each node, which members lie within ``radius``; all members search the tree at once."""
        todo = [(0, np.arange(len(self.values)))]
        while todo:
            node, asking = todo.pop()
            distance = np.bitwise_count(self.values[asking] ^ self.values[node]).astype(np.int64)
            near = asking[distance <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                follow = asking[np.abs(distance - edge) <= radius]
                if len(follow):
                    todo.append((child, follow))


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of positions that join what is linked, without a cycle."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for node, near in BKTree(values).links(radius):
        top = root(node)
        for i in near.tolist():
            other = root(i)
            if other != top:
                parent[other] = top
                out.append((node, i))
    return out


def _masks() -> tuple[list[int], dict[int, list[int]]]:
    """Masks of block pairs, and for each mask those that it is split into."""
    blocks = [0xFFFF << (16 * i) for i in range(4)]
    first = [a | b for i, a in enumerate(blocks) for b in blocks[i + 1 :]]
    splits: dict[int, list[int]] = {}

    def split(mask: int) -> list[int]:
        free = [i for i in range(64) if not mask >> i & 1]
        return [mask | sum(1 << int(b) for b in part) for part in np.array_split(free, 3)]

    for mask in first:
        splits[mask] = split(mask)
        for below in splits[mask]:
            splits[below] = split(below)
    return first, splits


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of a shard that goes on in the next batch

        def work(rows: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
            starts = np.concatenate([[0], cut])
            ends = np.concatenate([cut, [len(rows)]])
            if not last:
                held[:] = [rows[starts[-1] :]]
                starts, ends = starts[:-1], ends[:-1]
            src, dst = [], []
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                values = np.ascontiguousarray(rows[a:b, 2])
                for i, j in _forest(values.view(np.uint64), radius):
                    src.append(values[i])
                    dst.append(values[j])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(src)), pa.array(np.array(dst))], names=["src", "dst"])

        for batch in batches:
            if batch.num_rows:
                rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
                if held:
                    rows = np.concatenate([held.pop(), rows])
                yield from work(rows, False)
        if held:
            yield from work(held.pop(), True)

    return run


def near_links(prints: DataFrame, *, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (src, dst) that connect the distinct longs ``fp`` within ``radius`` (at most two) bits."""
    if radius > BLOCK_RADIUS:
        raise ValueError("shards by pairs of four blocks are exact up to two differing bits")
    first, splits = _masks()
    shards = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in first])).alias("mask"))
    found = None
    for level in range(3):
        shards = shards.withColumn("shard", F.col("fp").bitwiseAND(F.col("mask")))
        large = None
        if level < 2:
            large = shards.groupBy("mask", "shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_limit).drop("n")
            large = common.stored(large, f"large-shards-{level}")
            if large.limit(1).count() == 0:
                large = None
        small = shards if large is None else shards.join(large, ["mask", "shard"], "left_anti")
        trees = small.repartition("mask", "shard").sortWithinPartitions("mask", "shard", "fp").select("mask", "shard", "fp")
        links = trees.mapInArrow(_search(radius), "src long, dst long")
        found = links if found is None else found.union(links)
        if large is None:
            break
        parts = F.create_map(*[x for m, below in splits.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(b)) for b in below]))])
        shards = shards.join(large, ["mask", "shard"]).select("fp", F.explode(parts[F.col("mask")]).alias("mask"))
    return found


def _bins(members: DataFrame, sizes: DataFrame, bin_size: int, among: bool = True) -> DataFrame:
    """Shards (mask, shard, fp) in which each of a key's core meets each of the rest of its members (key, fp, core), and, if asked, every two of the rest."""
    bins = sizes.select("key", *[F.ceil(F.col(c) / bin_size).alias(c) for c in ("cores", "rest")])
    placed = members.join(bins, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("rest"))))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    none = F.array().cast("array<struct<kind:int,x:long,y:long>>")
    pair = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    with_rest = F.when(F.col("rest") > 0, F.transform(every("rest"), lambda y: pair(0, F.col("mine"), y))).otherwise(none)
    with_core = F.when(F.col("cores") > 0, F.transform(every("cores"), lambda x: pair(0, x, F.col("mine")))).otherwise(none)
    with_others = F.transform(every("rest"), lambda y: pair(1, F.least("mine", y), F.greatest("mine", y)))
    met = placed.select("key", "fp", F.explode(F.when(F.col("core"), with_rest).otherwise(F.concat(with_core, with_others) if among else with_core)).alias("p"))
    return met.select(F.xxhash64("key", "p.kind").alias("mask"), F.xxhash64("key", "p.x", "p.y").alias("shard"), "fp")


def content_links(keyed: DataFrame, *, radius: int, bin_size: int = BIN) -> DataFrame:
    """Links (src, dst) that connect the longs ``fp`` that share a ``key`` and lie within ``radius`` bits.

    Of a key with over ``bin_size`` members one is taken as a centre.  If at least half of the
    members lie within the radius of it, they are linked to it and need not meet each other,
    only the rest, which then goes through the same again.  So a group of near copies costs
    one pass, however large it is; a key whose members are unlike each other is cut into
    bins of which every two meet.
    """
    left = common.stored(keyed.select("key", "fp").distinct(), "content-shards")
    none = left.limit(0)
    direct = none.select(F.col("fp").alias("src"), F.col("fp").alias("dst"))
    trees = none.select(F.col("key").alias("mask"), F.col("fp").alias("shard"), "fp")
    while True:
        centre = F.min_by("fp", F.struct(F.xxhash64("fp"), F.col("fp")))
        large = left.groupBy("key").agg(F.count("*").alias("n"), centre.alias("centre")).where(F.col("n") > bin_size)
        large = common.stored(large.select("key", "centre"), "large-content-shards")
        small = left.select(F.col("key").alias("mask"), F.lit(0).cast("long").alias("shard"), "fp")
        if not large.limit(1).count():
            trees = trees.union(small)
            break
        trees = trees.union(small.join(large.select(F.col("key").alias("mask")), "mask", "left_anti").select("mask", "shard", "fp"))
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= radius
        members = common.stored(left.join(large, "key").select("key", "fp", "centre", near.alias("core")), "content-members")
        sizes = members.groupBy("key").agg(F.count_if("core").alias("cores"), F.count_if(~F.col("core")).alias("rest"))
        sizes = common.stored(sizes.withColumn("peeled", F.col("cores") >= F.col("rest")), "content-sizes")
        peeled = members.join(sizes.where("peeled").select("key"), "key", "left_semi")
        direct = direct.union(peeled.where("core and fp <> centre").select(F.col("centre").alias("src"), F.col("fp").alias("dst")))
        # of a key that is not peeled all are rest
        other = sizes.where("not peeled").select("key", F.lit(0).cast("long").alias("cores"), (F.col("cores") + F.col("rest")).alias("rest"))
        flat = members.join(other.select("key"), "key", "left_semi").select("key", "fp", F.lit(False).alias("core"))
        trees = trees.union(_bins(flat, other, bin_size))
        # core and rest of a peeled key meet; the rest goes on
        trees = trees.union(_bins(peeled.select("key", "fp", "core"), sizes.where("peeled and rest > 0").select("key", "cores", "rest"), bin_size, False))
        left = common.stored(peeled.where("not core").select("key", "fp"), "content-shards")
    found = trees.repartition("mask", "shard").sortWithinPartitions("mask", "shard", "fp").mapInArrow(_search(radius), "src long, dst long")
    return found.union(direct)


def _fingerprints(words: int, keys: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, found = [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, words)
                prints.append(summed(hashes))
                if keys:
                    found.append(content_keys(hashes).view(np.int64))
            columns = [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))]
            if keys:
                flat = pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), flat))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "keys"][: len(columns)])

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    shard_limit: int = SHARD_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the least doc_id that links reach).

    Up to ``BLOCK_RADIUS`` bits every two fingerprints within the radius are linked; beyond,
    those whose texts share a content key as well.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = radius > BLOCK_RADIUS
    schema = "doc_id long, fp long" + ", keys array<long>" * keys
    prints = common.stored(rows.mapInArrow(_fingerprints(words, keys), schema), "fingerprints")
    with common.tracked() as scratch:
        nodes = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
        if keys:
            links = content_links(prints.select("fp", F.explode("keys").alias("key")), radius=radius)
        else:
            links = near_links(nodes, radius=radius, shard_limit=shard_limit)
    with common.tracked() as paths:
        links = common.stored(links, "fingerprint-links")
        member = connected_components(links).select(F.col("node").alias("fp"), "component")
        classes = nodes.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    classes = common.stored(classes, "fingerprint-classes")
    for path in [*paths, *scratch]:
        common.delete(docs.sparkSession, path)
    # stored, so that the join can split a component that holds very many
    least = common.stored(classes.groupBy("component").agg(F.min("least").alias("component_id")), "fingerprint-least")
    known = classes.join(least, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(known, "fp").select("doc_id", hexed, "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
