"""Short codes for vectors: each vector is cut into equal parts, and each part becomes the index of its nearest codebook entry.

Components are integers, floor(``SCALE`` * x). Codebooks are trained by Lloyd rounds in which every vector keeps, for each part, an upper bound of
the distance to its own entry and one lower bound of the distance to the second nearest. When entries move, the bounds move with them; only
where the upper bound isn't strictly below the lower one (or half the gap between the own entry and the next) is the part compared with all
entries again, in exact integers. A strict bound proves a single nearest entry, so ties still go to the lower index. Bounds are 32-bit
floats, rounded outwards.

The state of a round (integers, codes, bounds) is a table in the shared folder, and that of the round before is deleted; sums are made in each task,
one row for each used entry, and only the entries' sums (``parts`` * ``entries`` rows) reach the driver.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. The table's length is the most frequent
one that can be cut into equal parts (ties: the shorter); rows of another length are returned with null code and error. Null ids come after all others and equal ids
are ordered by vector when the first entries are chosen; repeated rows are trained on and coded each; fewer vectors than entries give fewer entries.
A null label is a label. Other columns are ignored. An empty table gives no rows. Components so large that squared distances would pass 62 bits raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._stage import discard, kept, salted

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 1 << 14  # vectors handled at once
FEW_LABELS = 10_000  # up to here the labels' sums are broadcast
OUT, IN = 1 + 1e-12, 1 - 1e-12  # more than the rounding of double arithmetic


@dataclass
class Codebooks:
    """entries[part, index, position]; largest: no component is larger in absolute value."""

    entries: np.ndarray
    largest: int

    @property
    def exact(self) -> type:
        """Doubles add exactly what stays below 2**53."""
        return np.float64 if 8 * self.entries.shape[2] * (self.largest + 1) ** 2 < 1 << 53 else np.int64

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _above(v: np.ndarray) -> np.ndarray:
    """32-bit floats not below ``v``."""
    near = v.astype(np.float32)
    return np.where(near < v, np.nextafter(near, np.float32(np.inf)), near)


def _below(v: np.ndarray) -> np.ndarray:
    return -_above(-v)


def _all(x: np.ndarray, books: np.ndarray, kind: type) -> np.ndarray:
    """Squared distances of parts x[n, width] from the entries books[k, width], exact."""
    x, books = x.astype(kind), books.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ books.T) + (books * books).sum(1)


def _scan(x: np.ndarray, books: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower index of equal ones), bound above its distance, bound below the second's."""
    d = _all(x, books, kind)
    best, at = d.argmin(1), np.arange(len(d))
    nearest = d[at, best].astype(np.float64)
    if d.shape[1] == 1:
        return best, _above(np.sqrt(nearest) * OUT), np.full(len(d), np.inf, np.float32)
    d[at, best] = d.max() + 1
    return best, _above(np.sqrt(nearest) * OUT), _below(np.sqrt(d.min(1).astype(np.float64)) * IN)


def _moves(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry of a part: how far it moved, the farthest that any other moved (bounds from above), half the gap to the next entry (from below)."""
    moved = np.sqrt((((new - old).astype(np.float64)) ** 2).sum(1)) * OUT
    order = np.argsort(-moved)
    others = np.full(len(moved), moved[order[0]])
    others[order[0]] = moved[order[1]] if len(moved) > 1 else 0.0
    gaps = np.sqrt((((new[:, None] - new[None]).astype(np.float64)) ** 2).sum(2))
    np.fill_diagonal(gaps, np.inf)
    return moved, others, gaps.min(1) / 2 * IN


def assign(x: np.ndarray, books: Codebooks, before: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, upper and lower bounds of the vectors x[n, length], and how many of each vector's parts were compared with all entries.

    ``before``: the entries before they moved, and the codes and bounds for those.
    """
    parts, _, width = books.entries.shape
    code, upper, lower = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts), np.float32), np.zeros((len(x), parts), np.float32)
    scans = np.zeros(len(x), np.int32)
    for p in range(parts):
        own, entries = x[:, p * width : (p + 1) * width], books.entries[p]
        left = np.arange(len(x))
        if before is not None:
            old, was, up, low = before
            a = was[:, p]
            moved, others, half = _moves(old[p], entries)
            u, m = up[:, p].astype(np.float64) + moved[a], low[:, p].astype(np.float64)
            m = np.where(np.isinf(m), m, m - others[a] - 1e-12 * (np.abs(m) + others[a]))
            bound = np.maximum(m, half[a])
            unsure = np.flatnonzero(~(u * OUT < bound))
            gap = (own[unsure] - entries[a[unsure]]).astype(books.exact)
            u[unsure] = np.sqrt((gap * gap).sum(1).astype(np.float64))  # the own distance first: one entry, not all
            left = unsure[~(u[unsure] * OUT < bound[unsure])]
            code[:, p], upper[:, p], lower[:, p] = a, _above(u * OUT), _below(m)
        if len(left):
            code[left, p], upper[left, p], lower[left, p] = _scan(own[left], entries, books.exact)
            scans[left] += 1
    return code, upper, lower, scans


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel(), kind))


def _bytes(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(m.shape[1]), len(m), [None, pa.py_buffer(np.ascontiguousarray(m).tobytes())]).cast(pa.binary())


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label and vector of the rows whose vector has only finite numbers."""
    v = F.col(column)
    fine = v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return vectors.select("vec_id", "label", v.alias("v")).where(fine)


def _whole(rows: DataFrame) -> DataFrame:
    """The vectors as integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x = np.floor(_matrix(b.column("v"), np.float64) * SCALE)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _lists(x.astype(np.int32), pa.int32())], ["vec_id", "label", "x"])

    return rows.mapInArrow(run, f"vec_id {_kind(rows, 'vec_id')}, label {_kind(rows, 'label')}, x array<int>")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _step(state: DataFrame, books: Codebooks, old: np.ndarray | None) -> DataFrame:
    """The state with codes and bounds for ``books``."""
    parts = books.entries.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                before = None if old is None else (old, _codes(b.column("code"), parts), _matrix(b.column("upper"), np.float32), _matrix(b.column("lower"), np.float32))
                code, upper, lower, scans = assign(_matrix(b.column("x"), np.int64), books, before)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), _bytes(code), _lists(upper, pa.float32()), _lists(lower, pa.float32()), pa.array(scans)], ["vec_id", "label", "x", "code", "upper", "lower", "scans"])

    return state.mapInArrow(run, f"vec_id {_kind(state, 'vec_id')}, label {_kind(state, 'label')}, x array<int>, code binary, upper array<float>, lower array<float>, scans int")


def _means(state: DataFrame, books: Codebooks) -> np.ndarray:
    """Each entry replaced by the floor of its parts' mean; unused entries stay."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, width, entries), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x, code = _matrix(b.column("x"), np.int64), _codes(b.column("code"), parts)
                for p in range(parts):
                    counts[p] += np.bincount(code[:, p], minlength=entries)
                    for k in range(width):
                        sums[p, k] += np.bincount(code[:, p], weights=x[:, p * width + k], minlength=entries).astype(np.int64)  # below 2**45 a block
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), _lists(sums[p, :, e], pa.int64())], ["part", "entry", "n", "sums"])

    rows = state.select("x", "code").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    total = rows.groupBy("part", "entry").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.array(*[F.sum(F.col("sums")[k].cast("decimal(38,0)")) for k in range(width)]).alias("sums"))
    new = books.entries.copy()
    for r in total.collect():  # at most parts * entries rows
        new[r.part, r.entry] = [int(s) // int(r.n) for s in r.sums]
    return new


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame, DataFrame]:
    """Codebooks after ``rounds`` rounds; the table of vec_id, label, x, code and bounds before the last assignment's; the rows of another length."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most"))
    top = sizes.where((F.col("n") > 0) & (F.col("n") % parts == 0)).orderBy(F.desc("rows"), "n").limit(1).collect()
    length = top[0].n if top else 0
    largest = int(SCALE * float(top[0].most)) + 1 if top else 0
    if 8 * max(length, 1) * (largest + 1) ** 2 >= 1 << 62:
        raise ValueError(f"components up to {top[0].most} are too large: squared distances would pass 62 bits")
    other, x = rows.where(F.size("v") != length), _whole(rows.where(F.size("v") == length))
    first = x.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    width = length // parts
    books = Codebooks(np.array([r.x for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy(), largest)
    state, old = x, None
    for _ in range(rounds if first else 0):
        was, state = state, kept(_step(state, books, old))
        if old is not None:
            discard(was)
        old, books = books.entries, Codebooks(_means(state, books), largest)
    return books, _step(state, books, old), other


def encode(x: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of a table of vec_id, label, x (integers) and, from an assignment, code; without one, all are compared."""
    rows = x if "code" in x.columns else _step(x, books, None)
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                gap = _matrix(b.column("x"), np.int64).reshape(-1, parts, width) - books.entries[np.arange(parts), _codes(b.column("code"), parts)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("code"), pa.array((gap * gap).sum((1, 2)))], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "x", "code").mapInArrow(run, f"vec_id {_kind(rows, 'vec_id')}, label {_kind(rows, 'label')}, code binary, error bigint")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and the vector that each ``code`` (bytes) stands for; null for null."""
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = b.filter(b.column("code").is_valid())
            if there.num_rows:
                near = books.entries[np.arange(parts), _codes(there.column("code"), parts)].reshape(there.num_rows, parts * width)
                yield pa.RecordBatch.from_arrays([there.column("vec_id"), _lists(((near + 0.5) / SCALE).astype(np.float32), pa.float32())], ["vec_id", "embedding"])
            gone = b.filter(b.column("code").is_null())
            if gone.num_rows:
                yield pa.RecordBatch.from_arrays([gone.column("vec_id"), pa.nulls(gone.num_rows, pa.list_(pa.float32()))], ["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, f"vec_id {_kind(codes, 'vec_id')}, embedding array<float>")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code (hexadecimal), error, label_error and codebooks_sha256 of every usable row."""
    books, state, other = train(vectors, parts, entries, rounds)
    coded = encode(state, books).withColumn("code", F.lower(F.hex("code")))
    key = [F.col("label").isNull().alias("__none"), F.coalesce(F.xxhash64("label"), F.lit(0)).alias("__label")]
    rows = kept(coded.unionByName(other.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))))
    sums = kept(rows.groupBy("label").agg(F.sum("error").alias("label_error")).select(*key, F.col("label").alias("__own"), "label_error"))
    keyed = rows.select("*", *key)
    if sums.count() <= FEW_LABELS:
        joined = keyed.join(F.broadcast(sums), ["__none", "__label"])
    else:
        joined = salted(keyed, sums, ["__none", "__label"])
    return joined.where(F.col("label").eqNullSafe(F.col("__own"))).select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
