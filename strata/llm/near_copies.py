"""Near copies by similarity: texts whose sets of ``WIDTH``-word shingles have a Jaccard similarity of ``SIMILAR`` or more.

* Shingles are those of ``simhash`` with five words: lower-cased (A-Z only), a shorter text is one shingle. Texts with equal sets are one *point*.
* Candidates share one of ``BANDS`` keys, each made of ``ROWS`` least hashes. A pair of similarity s shares none with probability
  ``(1 - s**ROWS)**BANDS``: 0.0002 at 0.8, 4e-8 at 0.9. That is all that can be missed; what shares a key is compared on whole sets,
  of 40-bit hashes.
* SimHash fingerprints of the same shingles propose groups as well: what its vantage-point trees link within 4 bits shares a key beside the ``BANDS``.
* In a bucket of one key a leader is compared with all points left. Those within the distance 0.2 are linked to it and go; since Jaccard
  distance is a metric, only points up to 0.4 from the leader can be linked to one that went, and these are compared with each of them. So
  a large group of near copies takes one comparison for each, and the links connect all that is similar in the bucket.

Defined results: null and empty texts have the empty set and are alike; very long texts are read whole; what stays of a group, with null, shared or
repeated doc_ids, is as in ``simhash``; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import simhash
from strata.llm._arrow import blocks
from strata.llm._stage import cut, row_key
from strata.llm.simhash import BLOCK, SEED

WIDTH, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 4
_RANDOM = np.random.default_rng(SEED)
ODD, SHIFT = (_RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
ODD = ODD * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n))


def keys(own: np.ndarray) -> np.ndarray:
    """The key of each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1 << 14):
        x = (own[None, at : at + (1 << 14)] ^ SHIFT[:, None]) * ODD[:, None]
        np.minimum(least, ((x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


PRINT = "doc_id bigint, __id bigint, __key bigint, point string, "


def _prints(docs: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, __id, __key, point, fp, keys), or with the sets (..., point, own); the point is a digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            texts = batch.column("text").to_pylist()
            sets = [shingles(t or "") for t in texts]
            points = pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets])
            ids = [batch.column(c) for c in ("doc_id", "__id", "__key")]
            if whole:
                yield pa.RecordBatch.from_arrays([*ids, points, pa.array([packed(s) for s in sets], pa.binary())], ["doc_id", "__id", "__key", "point", "own"])
            else:
                prints = np.array([simhash.of_hashes(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*ids, points, pa.array(prints), pa.array([keys(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "__id", "__key", "point", "fp", "keys"])

    return docs.select("doc_id", "text", *row_key()).mapInArrow(run, PRINT + ("own binary" if whole else "fp bigint, keys array<bigint>"))


def similar(one: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """(shared shingles, shingles of both) of one set and each of the sets that lie in ``flat``."""
    place = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    shared = np.add.reduceat(one[place] == flat, starts, dtype=np.int64)
    return np.stack([shared, len(one) + sizes - shared])


def bucket_links(sets: list[np.ndarray], least: float = SIMILAR) -> list[tuple[int, int]]:
    """Links (places) that connect all sets of similarity ``least`` or more, fewer than sets; sets aren't empty and differ."""
    tenths = round(least * 10)  # whole numbers, so that exactly 0.8 counts
    left, out, root = np.arange(len(sets)), [], list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(i: int, j: int) -> None:
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))

    while len(left) > 1:
        rest = [sets[i] for i in left]
        sizes = np.fromiter(map(len, rest), np.int64, len(rest))
        starts, flat = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.concatenate(rest)
        shared, both = similar(rest[0], sizes, starts, flat)
        near = 10 * shared >= tenths * both
        ring = ~near & (10 * shared >= (2 * tenths - 10) * both)
        for i in left[near][1:].tolist():
            link(int(left[0]), i)
        apart = [j for j in left[ring].tolist() if top(j) != top(int(left[0]))]  # what is linked already needs no comparison
        for i in left[near][1:].tolist():
            if not apart:
                break
            outer = [sets[j] for j in apart]
            n = np.fromiter(map(len, outer), np.int64, len(outer))
            s, b = similar(sets[i], n, np.concatenate([[0], np.cumsum(n)[:-1]]), np.concatenate(outer))
            for j in np.array(apart)[10 * s >= tenths * b].tolist():
                link(i, j)
            apart = [j for j in apart if top(j) != top(i)]
        left = left[~near]
    return out


def packed(own: np.ndarray) -> bytes:
    """A set of shingle hashes by their leading 40 bits, 5 bytes each: what is shuffled is compared in this form."""
    return np.unique(own >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _links(rows: DataFrame) -> DataFrame:
    """(a, b): the links of all buckets. ``rows`` has band, key, point, own."""

    def found(group: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
        names = sorted(group)
        pairs = bucket_links([unpacked(group[p]) for p in names])
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([names[p[k]] for p in pairs]) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, {}
        for batch in batches:
            for band, key, point, own in zip(*(batch.column(c).to_pylist() for c in ("band", "key", "point", "own")), strict=True):
                if (band, key) != at:
                    yield from found(group)
                    at, group = (band, key), {}
                group[point] = own
        yield from found(group)

    return rows.repartition("band", "key").sortWithinPartitions("band", "key").mapInArrow(run, "a string, b string").distinct()


def components(docs: DataFrame) -> DataFrame:
    """doc_id, __id, __key, point, component_id (the smallest doc_id reachable) of each row."""
    prints = cut(_prints(docs, False))
    some = prints.groupBy("point").agg(F.min(F.struct("__id", "__key")).alias("at"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    points = cut(some.where(F.col("point") != xxhash.xxh3_128_hexdigest(b"")).select("point", "at", "keys", "fp"))
    groups = simhash.links(cut(points.select("fp").distinct()))
    close = simhash.connected(groups, points.select(F.col("fp").alias("node"), F.col("fp").alias("label")).distinct())
    near = points.join(close.select(F.col("node").alias("fp"), F.col("label").alias("group")), "fp", "left").select("point", "at", F.lit(BANDS).alias("band"), F.coalesce("group", "fp").alias("key"))
    banded = points.select("point", "at", F.posexplode("keys").alias("band", "key")).unionByName(near)
    shared = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key")
    rows = cut(banded.join(shared, ["band", "key"]))
    wanted = rows.select("at.__id", "at.__key").distinct()
    sets = _prints(docs.select("*", *row_key()).join(wanted, ["__id", "__key"], "left_semi").select("doc_id", "text"), True).select("point", "own").dropDuplicates(["point"])
    edges = cut(_links(rows.select("band", "key", "point").join(sets, "point")))
    return simhash.named(prints.select("doc_id", "__id", "__key", "point"), "point", edges)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component."""
    return simhash.keep_first(docs, components(docs), "point")
