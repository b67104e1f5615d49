"""Long repeats across a corpus: content-defined runs of windows, a count-min prefilter, and exact groups.

A *window* is a fixed number of consecutive units (bytes or words) of one document. Each window has an *anchor*: its least gram, leftmost on
ties, so that equal windows have equal anchors at equal places. Consecutive windows with one anchor form a *run*.

1. Parts: one pass over the texts gives, for each part of about ``PART_BYTES`` of text, a count-min sketch of its anchors and one entry for
   each different run, with its count and first place. What repeats inside the part is settled there.
2. Blocks: the sketch is cut into blocks by a hash of the anchors, as many as the input asks for, and is never in one place: the parts' cells and
   entries are sent to the anchor's block. There the parts' sketches are merged, entries whose anchor the sketch takes for single go (it
   overestimates, so none that repeats is lost), and what is left is grouped exactly. An entry comes once a part, so a frequent
   passage is not a long group; a block with more than ``HELD`` entries left is grouped by Spark instead.
3. A run that is alone under its anchor is settled by its count. Where several contents share an anchor, their windows are compared:
   by ``settle`` within a group of anchors, or, where more than ``GROUP`` contents share one anchor, by grouping window digests.

Rows are told apart by doc_id and a hash of the text; equal rows are treated alike. Long texts are looked at in overlapping stretches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._arrow import binary, blocks, utf8
from strata.llm._stage import NO_ID, SALT, bit_table, kept

TASKS = 4096  # reduce tasks that any driver can keep
BLOCK = 1 << 19  # bytes of text that are looked at together
PART_BYTES, PART_LOG2, DEPTH, ROW = 1 << 24, 18, 2, 90  # text of a part, cells of a block's row, rows, entries packed in a row
HELD, GROUP = 1 << 20, 2000
MASK = np.uint64((1 << 23) - 1)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= MIX[2]
    h ^= h >> np.uint64(29)
    h *= MIX[0]
    return h ^ (h >> np.uint64(32))


def least(key: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each ``span`` consecutive elements."""
    m, width = key, 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (span - width)], m[span - width :]) if span > width else m


class Bytes:
    """Units are bytes. Grams are multiples of 8 bytes: long enough that few of them repeat where no window does."""

    def __init__(self, window: int, gram: int = 32) -> None:
        self.window, self.gram = window, gram

    def parse(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, each unit's start and end in them, and each document's first unit, with one for the end."""
        at = np.arange(len(data), dtype=np.int64)
        return data, at, at + 1, off

    def grams(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) < self.gram:
            return np.zeros(0, np.uint64)
        v = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()
        m = len(data) - self.gram + 1
        h = v[:m] * MIX[1]
        for k in range(8, self.gram, 8):
            h = mix(h) ^ v[k : m + k] * MIX[0]
        return mix(h)


class Words:
    """Units are words: what ASCII white space separates, joined by one space."""

    TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)

    def __init__(self, window: int, gram: int = 8) -> None:
        self.window, self.gram = window, gram

    def parse(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        space = (data == 32) | ((data >= 9) & (data <= 13))
        border = np.zeros(len(data) + 1, bool)
        border[off] = True
        word = ~space
        first = word.copy()
        first[1:] &= space[:-1] | border[1:-1]
        doc_of_first = np.searchsorted(np.flatnonzero(first), off)
        last_space = np.zeros(len(data), bool)  # one space is kept before each word
        last_space[:-1] = space[:-1] & word[1:] & ~border[1:-1]
        keep = word | last_space
        kept = np.where(space, np.uint8(32), data)[keep]
        place = np.cumsum(keep) - 1
        starts = place[first]
        last = word.copy()
        last[:-1] &= space[1:] | border[1:-1]
        return kept, starts, place[last] + 1, doc_of_first

    def grams(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(starts) < self.gram:
            return np.zeros(0, np.uint64)
        n = len(data)
        at = np.arange(n, dtype=np.int64)
        begin = np.zeros(n, np.int64)
        begin[starts] = starts
        np.maximum.accumulate(begin, out=begin)
        value = (data.astype(np.uint64) + np.uint64(1)) * self.TABLE[(at - begin) & 1023]
        value[data == 32] = 0
        h = mix(np.add.reduceat(value, starts))
        m = len(h) - self.gram + 1
        g = h[:m].copy()
        for k in range(1, self.gram):
            g = (g ^ (g >> np.uint64(27))) * MIX[1] + h[k : m + k]
        return mix(g)


def runs(unit: Bytes | Words, off: np.ndarray, data: np.ndarray) -> Iterator[tuple]:
    """(document's place, first unit in it, windows, unit of the anchor from the first one, anchor, data, starts, ends, first's place) arrays."""
    data, starts, ends, docs = unit.parse(off, data)
    total = len(starts)
    step = 1 << 22
    for a in range(0, total, step):  # a long document is looked at in overlapping parts
        b = min(total, a + step + unit.window - 1)
        if b - a < unit.window:
            break
        base = int(starts[a])
        s, e = starts[a:b] - base, ends[a:b] - base
        part = data[base : int(ends[b - 1])]
        h = unit.grams(part, s, e)
        low = least((h & ~MASK) | np.arange(len(h), dtype=np.uint64), unit.window - unit.gram + 1)
        anchor = (low & MASK).astype(np.int64)
        first = np.arange(len(anchor))
        doc = np.searchsorted(docs, first + a, side="right") - 1
        fits = first + a + unit.window <= docs[doc + 1]
        first, anchor, doc = first[fits], anchor[fits], doc[fits]
        if not len(first):
            continue
        new = np.ones(len(first), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(first)))
        f = first[at]
        yield doc[at], f + a - docs[doc[at]], count, anchor[at] - f, h[anchor[at]], part, s, e, f


# --- entries: what a part of the texts says about its runs

#: A run of a part: how often it stands there and its first place. ``run`` is a digest of its content; with the anchor, 128 bits tell runs apart.
ENTRY = np.dtype([("anchor", "<u8"), ("run", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("n", "<i2"), ("lead", "<i2"), ("count", "<i4")])
PLACE = ("doc", "key", "start")
CELLS, RUNS, GONE = 0, 1, 2
PACKED = "block bigint, kind int, data binary"


def cells(anchor: np.ndarray, part_log2: int) -> list[np.ndarray]:
    """The anchor's cell in each row of its block of the sketch."""
    return [(mix(anchor + np.uint64((k + 1) * int(MIX[0]) & (1 << 64) - 1)) >> np.uint64(64 - part_log2)).astype(np.uint32) for k in range(DEPTH)]


def blocks_for(docs: DataFrame, bytes_per_run: int, part_log2: int) -> int:
    """log2 of the number of blocks: some cells for each run that the text can have. It grows with the input without a bound."""
    n = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(0, int(np.ceil(np.log2(4 * n / bytes_per_run + 1))) - part_log2)


def block_of(anchor: np.ndarray, blocks_log2: int) -> np.ndarray:
    """The anchor's block, by other bits than its cells: anchors are least hashes, so their own leading bits are mostly zero."""
    return (mix(anchor ^ MIX[1]) >> np.uint64(64 - blocks_log2)).astype(np.int64) if blocks_log2 else np.zeros(len(anchor), np.int64)


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), binary([r[2] for r in rows])], ["block", "kind", "data"])


def _groups(e: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """Whether an entry begins a group of equal ``names``; the entries are sorted by them."""
    new = np.ones(len(e), bool)
    if len(e) > 1:
        new[1:] = np.logical_or.reduce([e[c][1:] != e[c][:-1] for c in names])
    return new


def _sorted(e: np.ndarray) -> np.ndarray:
    return e[np.lexsort((e["start"], e["key"], e["doc"], e["run"], e["anchor"]))]


def _same_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([a[c] == b[c] for c in PLACE])


def part(held: list[np.ndarray], blocks_log2: int, part_log2: int, ordered: bool, task: int) -> Iterator[tuple[int, int, bytes]]:
    """(block, kind, data) of one part of the texts: its sketch, its runs once each, and what of it repeats inside the part already.

    However often a run stands in the part, one entry of it leaves: a frequent passage comes to its block once a part, not once a document.
    """
    e = _sorted(np.concatenate(held))
    new = _groups(e, ("anchor", "run"))
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    count = np.diff(np.append(at, len(e)))
    total = np.add.reduceat(e["count"], at)
    # repeats inside the part: all but the first place of a run, or every place where the order doesn't matter
    again = ~_same_place(e, e[at][group]) if ordered else (count > 1)[group]
    e, gone = e[at], e[again]
    e["count"] = total
    for a in range(0, len(gone), ROW):
        yield (task + a // ROW) & ((1 << blocks_log2) - 1), GONE, gone[a : a + ROW].tobytes()
    a_at = np.flatnonzero(_groups(e, ("anchor",)))
    anchors, often = e["anchor"][a_at], np.add.reduceat(e["count"], a_at) > 1
    anchors = np.concatenate([anchors, anchors[often]])  # an anchor counts 1 or 2
    for values, kind in ((anchors, CELLS), (e, RUNS)):
        block = block_of(values if kind == CELLS else e["anchor"], blocks_log2)
        order = np.argsort(block, kind="stable")
        values, block = values[order], block[order]
        data = np.stack(cells(values, part_log2), axis=1) if kind == CELLS else values
        edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            for i in range(a, b, ROW):
                yield int(block[a]), kind, data[i : min(i + ROW, b)].tobytes()


def parts(docs: DataFrame, unit: Bytes | Words, blocks_log2: int, part_log2: int, ordered: bool) -> DataFrame:
    """One pass over the keyed texts: the packed rows of each part of about ``PART_BYTES`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows, weight = [], 0
            for row in part(held, blocks_log2, part_log2, ordered, task):
                rows.append(row)
                weight += len(row[2])
                if weight > 1 << 21:
                    yield _packed(rows)
                    rows, weight = [], 0
            if rows:
                yield _packed(rows)

        for batch in blocks(batches, "text", BLOCK):
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("tkey").to_numpy()
            off, data = utf8(batch.column("text"))
            for doc, start, count, lead, anchor, said, s, e, f in runs(unit, off, data):
                view, out = memoryview(said), np.empty(len(doc), ENTRY)
                out["run"] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(s[f].tolist(), e[f + count + unit.window - 2].tolist())]
                for name, value in (("anchor", anchor), ("doc", ids[doc]), ("key", keys[doc]), ("start", start), ("n", count), ("lead", lead), ("count", 1)):
                    out[name] = value
                held.append(out)
            size += len(data)
            if size >= PART_BYTES and held:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, PACKED)


# --- blocks: the merged sketch and the exact groups

#: kind 0: windows to remove; 1: a run with rivals under its anchor, at its first place; 2: an entry of a block too large for one task's memory.
FOUND = "kind int, anchor bigint, run bigint, doc_id bigint, tkey bigint, start bigint, n int, lead int, n_occ bigint, contents bigint"
REMOVED, RIVAL, UNSETTLED = 0, 1, 2


class Block:
    """One block of the sketch and the runs whose anchors lie in it."""

    def __init__(self, part_log2: int, ordered: bool, most: int) -> None:
        self.table = np.zeros((DEPTH, 1 << part_log2), np.uint32)
        self.part_log2, self.ordered, self.most = part_log2, ordered, most
        self.held: list[np.ndarray] = []
        self.size, self.whole = 0, True
        self.seen = self.passed = 0

    def add_cells(self, data: bytes) -> None:
        own = np.frombuffer(data, "<u4").reshape(-1, DEPTH)
        for k in range(DEPTH):
            np.add.at(self.table[k], own[:, k], 1)

    def add_runs(self, data: bytes) -> Iterator[pa.RecordBatch]:
        """Keeps the runs that the merged sketch takes for repeated; it overestimates, so that no repeated one is lost."""
        e = np.frombuffer(data, ENTRY)
        estimate = np.minimum.reduce([self.table[k][c] for k, c in enumerate(cells(e["anchor"], self.part_log2))])
        self.seen += len(e)
        e = e[estimate > 1]
        self.passed += len(e)
        if len(e):
            self.held.append(e)
            self.size += len(e)
        if self.size > self.most:  # more different runs than a task holds: they are grouped by Spark
            self.whole = False
            yield found_rows(UNSETTLED, np.concatenate(self.held), None)
            self.held, self.size = [], 0

    def end(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        e = np.concatenate(self.held)
        if not self.whole:
            yield found_rows(UNSETTLED, e, None)
            return
        e = _sorted(e)
        new = _groups(e, ("anchor", "run"))
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        total = np.add.reduceat(e["count"].astype(np.int64), at)
        # parts have dealt with their own repeats: here their first places remain
        removed = ~_same_place(e, e[at][group]) if self.ordered else (total[group] > 1) & (e["count"] == 1)
        yield found_rows(REMOVED, e[removed], None)
        first = e[at]
        a_new = _groups(first, ("anchor",))
        a_at = np.flatnonzero(a_new)
        contents = np.diff(np.append(a_at, len(first)))[np.cumsum(a_new) - 1]
        rival = contents > 1
        yield found_rows(RIVAL, first[rival], contents[rival], total[rival])


def found_rows(kind: int, e: np.ndarray, contents: np.ndarray | None, total: np.ndarray | None = None) -> pa.RecordBatch:
    nothing = pa.nulls(len(e), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(e), kind, np.int32)),
            nothing if kind == REMOVED else pa.array(e["anchor"].astype(np.uint64).view(np.int64)),
            nothing if kind == REMOVED else pa.array(e["run"].astype(np.uint64).view(np.int64)),
            *(pa.array(e[c].astype(np.int64)) for c in PLACE),
            pa.array(e["n"].astype(np.int32)),
            pa.array(e["lead"].astype(np.int32)),
            pa.array((e["count"] if total is None else total).astype(np.int64)),
            nothing if contents is None else pa.array(contents.astype(np.int64)),
        ],
        [c.split()[0] for c in FOUND.split(", ")],
    )


def occurrences(docs: DataFrame, unit: Bytes | Words, bytes_per_run: int, ordered: bool, part_log2: int = PART_LOG2, most: int = HELD) -> DataFrame:
    """``FOUND`` rows: the windows known to go, and the first places of runs with rivals, in one pass over the keyed texts and one shuffle."""
    if unit.window > 1 << 15:
        raise ValueError("a window of more than 32768 units doesn't fit an entry")
    blocks_log2 = blocks_for(docs, bytes_per_run, part_log2)
    packed = parts(docs, unit, blocks_log2, part_log2, ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, Block(0, ordered, most)
        for batch in batches:
            for b, kind, data in zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("data")):
                if b != at:
                    yield from block.end()
                    at, block = b, Block(part_log2, ordered, most)
                said = data.as_buffer()
                if kind == CELLS:
                    block.add_cells(said)
                elif kind == RUNS:
                    yield from block.add_runs(said)
                else:
                    yield found_rows(REMOVED, np.frombuffer(said, ENTRY), None)
        yield from block.end()

    # about four blocks each while the cluster has room; beyond that a task handles more of them, one after the other
    tasks = min(1 << max(0, blocks_log2 - 2), max(TASKS, 8 * docs.sparkSession.sparkContext.defaultParallelism))
    return kept(packed.repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, FOUND))


def settled_by_spark(found: DataFrame, ordered: bool) -> DataFrame:
    """``FOUND`` rows of kinds 0 and 1 from the unsettled ones, by grouping."""
    rows = found.where(F.col("kind") == UNSETTLED)
    at = F.struct("doc_id", "tkey", "start")
    per_run = rows.groupBy("anchor", "run").agg(F.sum("n_occ").alias("total"), F.min(F.struct("doc_id", "tkey", "start", "n", "lead")).alias("f"))
    per_anchor = per_run.groupBy("anchor").agg(F.count(F.lit(1)).alias("all"))
    gone = rows.join(per_run.select("anchor", "run", "total", "f"), ["anchor", "run"])
    gone = gone.where(at > F.struct("f.doc_id", "f.tkey", "f.start")) if ordered else gone.where("total > 1 AND n_occ = 1")
    nothing = F.lit(None).cast("bigint")
    removed = gone.select(F.lit(REMOVED).alias("kind"), nothing.alias("anchor"), nothing.alias("run"), "doc_id", "tkey", "start", "n", "lead", "n_occ", nothing.alias("contents"))
    rivals = per_run.join(per_anchor.where("all > 1"), "anchor").select(F.lit(RIVAL).alias("kind"), "anchor", "run", "f.*", F.col("total").alias("n_occ"), F.col("all").alias("contents"))
    return removed.unionByName(rivals)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (``NO_ID`` for null), tkey (a hash of the text) and text (empty for null)."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))


# --- rivals: runs of different contents under one anchor

FULL = "anchor bigint, run bigint, n_occ bigint, doc_id bigint, tkey bigint, start bigint, n int, lead int, contents bigint, content binary"
MASK_ROW = "doc_id bigint, tkey bigint, start bigint, n int, ks array<int>"


def _contents(docs: DataFrame, unit: Bytes | Words, some: DataFrame) -> DataFrame:
    """The runs' contents, read again from the document of their first occurrence."""
    ranges = some.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("anchor", "run", "n_occ", "start", "n", "lead", "contents")).alias("ranges"))
    passes = bit_table(some.select("doc_id").distinct(), "doc_id")
    texts = docs.where(passes(F.col("doc_id"))).dropDuplicates(["doc_id", "tkey"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            off, data = utf8(batch.column("text"))
            kept, starts, ends, docs_at = unit.parse(off, data)
            own = batch.column("ranges")
            r, of = own.flatten(), np.repeat(np.arange(batch.num_rows), pc.list_value_length(own).to_numpy())
            value = {f: r.field(f) for f in ("anchor", "run", "n_occ", "start", "n", "lead", "contents")}
            u = docs_at[of] + value["start"].to_numpy()
            a, b = starts[u], ends[u + value["n"].to_numpy() + unit.window - 2]
            view = memoryview(np.ascontiguousarray(kept))
            text = binary([bytes(view[i:j]) for i, j in zip(a.tolist(), b.tolist())])
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([value["anchor"], value["run"], value["n_occ"], batch.column("doc_id").take(at), batch.column("tkey").take(at), value["start"], value["n"], value["lead"], value["contents"], text], [c.split()[0] for c in FULL.split(", ")])

    return texts.join(ranges, ["doc_id", "tkey"]).mapInArrow(cut_out, FULL)


def _by_windows(full: DataFrame, unit: Bytes | Words, ordered: bool) -> DataFrame:
    """``MASK_ROW`` by grouping window digests: for anchors with very many different contents."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512).to_pylist()
                out: list[list] = [[] for _ in range(9)]
                for r in rows:
                    text = np.frombuffer(r["content"], np.uint8)
                    _, s, e, _ = unit.parse(np.array([0, len(text)]), text)
                    for k in range(r["n"]):
                        digest = xxhash.xxh3_128_digest(r["content"][s[k] : e[k + unit.window - 1]])
                        for column, value in zip(out, (r["anchor"], digest, k, r["n_occ"], r["doc_id"], r["tkey"], r["start"], r["n"], k % SALT)):
                            column.append(value)
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["anchor", "w", "k", "n_occ", "doc_id", "tkey", "start", "n", "turn"])

    rows = full.mapInArrow(explode, "anchor bigint, w binary, k int, n_occ bigint, doc_id bigint, tkey bigint, start bigint, n int, turn int")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tkey", "start"), F.lit(SALT)).cast("int")).drop("turn")
    at = F.struct("doc_id", "tkey", (F.col("start") + F.col("k")).alias("start"))
    groups = rows.groupBy("anchor", "w").agg(F.sum("n_occ").alias("all"), F.min(at).alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1 OR all > 1")
    # a frequent window is one row here; its many places are spread by a salt
    spread = groups.select("anchor", "w", "all", "least", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    joined = rows.join(spread, ["anchor", "w", "salt"])
    flag = (at > F.col("least")) if ordered else ((F.col("all") >= 2) & (F.col("n_occ") == 1))
    return joined.where(flag).groupBy("anchor", "doc_id", "tkey", "start", "n").agg(F.array_sort(F.collect_list("k")).alias("ks")).drop("anchor")


def settled(docs: DataFrame, unit: Bytes | Words, rivals: DataFrame, settle: Callable, ordered: bool, group: int = GROUP) -> DataFrame:
    """``MASK_ROW``: of each run with rivals, at its first place, the windows ``ks`` that repeat (``ordered``: that also start earlier)."""
    full = kept(_contents(docs, unit, rivals))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def out() -> pa.RecordBatch:
            done = [(r, ks) for r, ks in zip(held, settle(held)) if ks and (ordered or r["n_occ"] == 1)]
            columns = [pa.array([r[c] for r, _ in done], t) for c, t in (("doc_id", pa.int64()), ("tkey", pa.int64()), ("start", pa.int64()), ("n", pa.int32()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([ks for _, ks in done], pa.list_(pa.int32()))], ["doc_id", "tkey", "start", "n", "ks"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for r in batch.slice(at, 1024).to_pylist():
                    if size > 1 << 20 and held[-1]["anchor"] != r["anchor"]:  # an anchor's contents stay together
                        yield out()
                        held, size = [], 0
                    held.append(r)
                    size += len(r["content"])
        if held:
            yield out()

    few = full.where(F.col("contents") <= group).drop("contents", "run")
    near = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(local, MASK_ROW)
    return near.unionByName(_by_windows(full.where(F.col("contents") > group).drop("contents", "run"), unit, ordered))


# --- results


def repeated(docs: DataFrame, unit: Bytes | Words, bytes_per_run: int, settle: Callable, ordered: bool) -> DataFrame:
    """(doc_id, tkey, ranges): of each keyed text with repeats, the runs with windows to remove; ``ks`` null there: all of the run's windows."""
    found = occurrences(docs, unit, bytes_per_run, ordered)
    large = settled_by_spark(found, ordered)
    rivals = found.where(F.col("kind") == RIVAL).unionByName(large.where(F.col("kind") == RIVAL))
    gone = found.where(F.col("kind") == REMOVED).unionByName(large.where(F.col("kind") == REMOVED))
    masks = settled(docs, unit, rivals, settle, ordered)
    every = gone.select("doc_id", "tkey", "start", "n", F.lit(None).cast("array<int>").alias("ks")).unionByName(masks)
    return every.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("start", "n", "ks")).alias("ranges"))


def copies(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tkey, n): of the keyed texts of ``window`` bytes or more, those that an equal text stands before.

    Texts are equal by SHA-256; the join spreads a group of copies over ``SALT`` keys.
    """
    own = docs.select("doc_id", "tkey", F.octet_length("text").cast("bigint").alias("n"), F.unhex(F.sha2("text", 256)).alias("h")).where(F.col("n") >= window)
    own = kept(own)  # narrow: the texts are hashed once
    first = own.groupBy("h").agg(F.min(F.struct("doc_id", "tkey")).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    spread = first.select("h", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    return kept(salted.join(spread, ["h", "salt"]).where("struct(doc_id, tkey) > first").select("doc_id", "tkey", "n").distinct())


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The keyed texts that aren't in ``gone`` (doc_id, tkey); texts that surely aren't are not moved."""
    passes = bit_table(gone, "doc_id")
    near = docs.where(passes(F.col("doc_id"))).join(gone.select("doc_id", "tkey"), ["doc_id", "tkey"], "left_anti")
    return docs.where(~passes(F.col("doc_id"))).unionByName(near.select(docs.columns))


def starts_of(ranges: list[dict], total: int, window: int) -> np.ndarray:
    """Which of ``total`` units are covered by a removed window."""
    edge = np.zeros(total + 1, np.int64)
    for r in ranges:
        s = r["start"]
        if r["ks"] is None:
            edge[s] += 1
            edge[s + r["n"] + window - 1] -= 1
        else:
            ks = np.asarray(r["ks"], np.int64) + s
            np.add.at(edge, ks, 1)
            np.add.at(edge, ks + window, -1)
    return np.cumsum(edge[:-1]) > 0


def apply(docs: DataFrame, ranges: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over all keyed texts with their ranges; texts of documents without any are not moved."""
    ranges = kept(ranges)
    passes = bit_table(ranges, "doc_id")
    texts = docs
    kind = "array<struct<start:bigint,n:int,ks:array<int>>>"
    near = texts.where(passes(F.col("doc_id"))).join(ranges, ["doc_id", "tkey"], "left")
    rest = texts.where(~passes(F.col("doc_id"))).withColumn("ranges", F.lit(None).cast(kind))
    columns = ["doc_id", "text", "ranges"]
    out = near.select(columns).mapInArrow(run, schema).unionByName(rest.select(columns).mapInArrow(run, schema))
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
