"""Near duplicates by SimHash: 64-bit fingerprints of word shingles, linked at ``RADIUS`` differing bits or fewer.

* Fingerprint: lower-cased words (A-Z only), shingles of ``SHINGLE`` words with repeats, XXH64 with seed 42; a bit is set if more than half the
  hashes have it.
* Search: equal fingerprints are one point. A fingerprint is cut into blocks, of which any two points within ``RADIUS`` bits have some equal;
  each choice of so many blocks is a table, and a table's equal values make a *bucket*. The more points, the more blocks are cut, so that
  buckets stay small at any size (``bands_for``). In a bucket a vantage-point tree over the Hamming distance finds the points within
  the radius: a subtree is passed over when the triangle inequality bounds it away. Buckets of more than ``BUCKET`` points are dealt to *shards* by
  distance to vantage points first; points whose ball crosses a shard's boundary are queried in every shard it reaches.
* Links: a bucket gives each point's link to the smallest point it reaches there, no pairs. Components grow from these by the smaller
  neighbour and pointer doubling, written out after each round.

Defined results: null and empty texts have no words and fingerprint zero, and link like any other; every row of ``docs`` gives a row; rows that share a
doc_id are points of their own; rows with a null doc_id link too, and a component has a null id only if no row of it has one; very long
texts are read whole; extra columns are ignored by ``components`` and kept by ``keep_one``, which keeps one row of each component: that with
the smallest doc_id (null ones last), of several of them the smallest hash of the text, and of equal rows one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._arrow import blocks
from strata.llm._stage import cut, row_key, salted

SHINGLE, SEED, RADIUS, LEAF, BUCKET, BLOCK = 4, 42, 4, 24, 4096, 1 << 21
NO_ONE = (1 << 63) - 1  # stands for a null doc_id: after all others


def tables(blocks: int, equal: int) -> list[tuple[tuple[int, int], ...]]:
    """Each choice of ``equal`` of ``blocks`` blocks of the 64 bits, as (first bit, width): two points that differ in ``blocks - equal`` bits share one."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return list(combinations([(a, b - a) for a, b in zip(cuts, cuts[1:])], equal))


def bands_for(points: int, radius: int = RADIUS, full: int = 256) -> list[tuple[tuple[int, int], ...]]:
    """Tables whose buckets hold about ``full`` points at most on average, out of 1 to 4 equal blocks; those of one block up to two million points."""
    for equal in range(1, 5):
        found = tables(radius + equal, equal)
        if points >> min(sum(w for _, w in t) for t in found) <= full:
            break
    return found


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n)
    return of_hashes(h)


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is set if more than half of them have it; none gives zero."""
    total, n = np.zeros(64, np.int64), len(h)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, __id, __key, fp): fp is the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            found = np.array([fingerprint(t or "", shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "__id", "__key")), pa.array(found.view(np.int64))], ["doc_id", "__id", "__key", "fp"])

    return docs.select("doc_id", "text", *row_key()).mapInArrow(run, "doc_id bigint, __id bigint, __key bigint, fp bigint")


def distance(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """Points in a tree of vantage points; each node splits its points at the median distance to one of them."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.leaf = points, leaf
        self.nodes: list[tuple] = []  # (vantage, inner lowest, inner highest, outer lowest, outer highest, inner node, outer node) or (indices,)
        stack = [(np.arange(len(points)), -1, 0)]
        while stack:
            index, parent, side = stack.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][5 + side] = at
            if len(index) <= leaf:
                self.nodes.append([index])
                continue
            d = distance(points[index], points[index[0]])
            median = np.partition(d, len(d) // 2)[len(d) // 2]
            near = d < median if (d < median).any() else d <= median
            if near.all():  # all at one distance
                self.nodes.append([index])
                continue
            inner, outer = d[near], d[~near]
            self.nodes.append([points[index[0]], int(inner.min()), int(inner.max()), int(outer.min()), int(outer.max()), -1, -1])
            stack += [(index[near], at, 0), (index[~near], at, 1)]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query's place, point's place) arrays of all pairs within the radius, a leaf and its queries at a time."""
        if not len(self.points):
            return
        stack = [(0, np.arange(len(queries)))]
        while stack:
            at, q = stack.pop()
            node = self.nodes[at]
            if len(node) == 1:
                index = node[0]
                step = max(1, (1 << 22) // len(index))
                for a in range(0, len(q), step):
                    i, j = np.nonzero(np.bitwise_count(queries[q[a : a + step], None] ^ self.points[index][None, :]) <= radius)
                    if len(i):
                        yield q[a : a + step][i], index[j]
                continue
            d = distance(queries[q], node[0]).astype(np.int64)
            for low, high, below in ((node[1], node[2], node[5]), (node[3], node[4], node[6])):
                reach = (d + radius >= low) & (d - radius <= high)  # triangle bounds
                if reach.any():
                    stack.append((below, q[reach]))


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that each place is linked to, over all pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


def _bucket_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, smallest point it reaches in the bucket) of the points that aren't alone; ``points`` ascend."""
    if len(points) == 2:
        near = int(points[0] ^ points[1]).bit_count() <= radius
        return (points[1:], points[:1]) if near else (points[:0], points[:0])
    root = _roots(len(points), VantageTree(points).within(points, radius))
    moved = np.flatnonzero(root != np.arange(len(points)))
    return points[moved], points[root[moved]]


def _banded(points: DataFrame, bands: list) -> DataFrame:
    value = lambda t: F.expr(" + ".join(f"shiftleft(shiftrightunsigned(fp, {at}) & {(1 << w) - 1}L, {sum(x for _, x in t[:k])})" for k, (at, w) in enumerate(t)))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), value(t).alias("value")) for k, t in enumerate(bands))))
    return points.select("fp", rows.alias("b")).select("fp", "b.band", "b.value")


def _shards(big: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Points of large buckets, with the shard of each and the further shards that their balls reach.

    Shards are cut by the distance to as many vantage points, taken from the bucket, as its size asks for; a point goes to both sides of a
    cut that it is within the radius of. Links inside a shard are therefore all that its side of the cuts holds.
    """
    sizes = big.groupBy("band", "value").agg(F.count(F.lit(1)).alias("points"), F.min("fp").alias("v1"), F.max("fp").alias("v2"), F.min_by("fp", F.xxhash64("fp")).alias("v3"))
    out = big.join(sizes, ["band", "value"])
    shard = F.lit("")
    for v in ("v1", "v2", "v3"):
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col(v)))
        middle = F.percentile_approx(F.bit_count(F.col("fp").bitwiseXOR(F.col(v))), 0.5, 100)
        out = out.join(out.groupBy("band", "value").agg(middle.alias(f"m_{v}")), ["band", "value"])
        sides = F.array_compact(F.array(F.when(d <= F.col(f"m_{v}") + radius, F.lit("i")), F.when(d > F.col(f"m_{v}") - radius, F.lit("o"))))
        out = out.withColumn(f"s_{v}", F.explode(sides))
        shard = F.concat(shard, F.col(f"s_{v}"))
    return out.select("fp", "band", "value", shard.alias("shard"))


def links(points: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): for each distinct fingerprint of ``points`` (fp) links enough to connect all that are within ``radius``; b is smaller as an unsigned number."""
    if not 0 <= radius < 32:
        raise ValueError("the radius must be from 0 to 31 bits")
    banded = _banded(points, bands_for(points.count()) if radius == RADIUS else tables(radius + 1, 1))
    counts = cut(banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("points")).where("points > 1"))
    sized = banded.join(counts, ["band", "value"])
    rows = sized.where(F.col("points") <= bucket).select("fp", "band", "value", F.lit("").alias("shard"))
    if counts.where(F.col("points") > bucket).limit(1).count():
        large = cut(sized.where(F.col("points") > bucket).select("fp", "band", "value"))
        rows = rows.unionByName(_shards(large, radius, bucket))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None  # rows of the bucket that the last batch may not have ended
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            key = list(zip(batch.column("band").to_pylist(), batch.column("value").to_pylist(), batch.column("shard").to_pylist()))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            groups = [(key[a], fp[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]
            if rest is not None and groups and groups[0][0] == rest[0]:
                groups[0] = (rest[0], np.concatenate([rest[1], groups[0][1]]))
            elif rest is not None:
                groups.insert(0, rest)
            rest = groups.pop() if groups else rest
            yield from out(groups)
        if rest is not None:
            yield from out([rest])

    def out(groups: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, fp in groups:
            if len(fp) > 1:
                x, y = _bucket_links(np.unique(fp), radius)
                a.append(x)
                b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    rows = rows.repartition("band", "value", "shard").sortWithinPartitions("band", "value", "shard")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def connected(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(node, label): the least label of each node's component; ``edges`` (a, b), ``least`` (node, label) gives nodes their own labels.

    Each round a node takes the least label among its neighbours', then its label's node's label; rounds end when no label changes.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.select(F.col("a").alias("node")).distinct().join(least, "node"))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        new = labels.join(heard.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "heard").alias("new"))
        # the label's own node may have heard of a smaller one: follow it
        step = new.groupBy("label").agg(F.min("new").alias("follow"))
        new = cut(new.join(step, "label").select("node", "label", F.least("new", "follow").alias("new")))
        changed = new.where("new < label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def named(prints: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """(doc_id, __id, __key, node, component_id) of each row of ``prints`` (doc_id, __id, __key, node), where ``edges`` link nodes."""
    own = F.when(F.col("doc_id").isNull(), F.lit(NO_ONE)).otherwise(F.col("doc_id"))
    points = cut(prints.groupBy(node).agg(F.min(own).alias("label")))
    labels = connected(edges, points.select(F.col(node).alias("node"), "label"))
    joined = points.join(labels.select(F.col("node").alias(node), F.col("label").alias("joined")), node, "left").select(node, F.coalesce("joined", "label").alias("component_id"))
    return salted(prints, joined, [node]).withColumn("component_id", F.nullif("component_id", F.lit(NO_ONE)))


def keep_first(docs: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """The row of ``docs`` that stays for each component of ``found`` (doc_id, __id, __key, node, component_id).

    A component without any doc_id is named by null, like others: its nodes tell it apart, each by its least text.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "__id", "__key")
    some = found.where("component_id IS NOT NULL AND doc_id = component_id").groupBy("component_id").agg(F.min(order).alias("x"))
    none = found.where("component_id IS NULL").groupBy(node).agg(F.min(order).alias("x"))
    chosen = some.select("x.__id", "x.__key").unionByName(none.select("x.__id", "x.__key"))
    rows = docs.select("*", *row_key()).join(chosen.distinct(), ["__id", "__key"])
    return rows.dropDuplicates(["__id", "__key"]).select(docs.columns)  # by the columns of the join: no further shuffle


def components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) of each row."""
    return _components(docs, radius, shingle).select("doc_id", "fp", "component_id")


def _components(docs: DataFrame, radius: int, shingle: int) -> DataFrame:
    prints = cut(fingerprints(docs, shingle))
    return named(prints, "fp", links(cut(prints.select("fp").distinct()), radius))


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each component."""
    return keep_first(docs, _components(docs, radius, shingle), "fp")
