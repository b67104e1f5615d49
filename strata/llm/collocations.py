"""Phrases whose words stand together more often than their parts' counts suggest, found by hashing the next length's phrases into buckets (PCY, DHP).

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs; phrases never cross pieces, and everything
is counted for each language. Pass n counts exactly the phrases of n words that can still be frequent, and meanwhile counts the buckets of the phrases of n + 1 words
made of such. Before pass n, the buckets that reached ``floor`` become a broadcast bitmap, and so do the frequent phrases of n - 1 words (Apriori): a phrase is counted
only if its bucket's bit and the bits of its two parts of n - 1 words are set. A bucket never holds less than each of its phrases, and a frequent phrase's bit is always set, so no frequent phrase is lost;
counts are exact, by whole words.

Bitmaps have about one bit for 8 bytes of text, 2**``MOST_LOG2`` (32 MB) at most: they depend on a parameter, not on the data. Past some ten gigabytes of text the buckets fill up and
prune less; the rest is done by Apriori and by the sums made for each block of text before anything is shuffled. Counts are the same at every size.

A pass's rows (sums of a block of text, and packed bucket counts) are one compressed table in the shared folder, deleted once both have been added up.

Defined results: null text is empty; a null lang is ``und``, and so is one called ``und``; texts without words count for nothing; very long texts are counted in blocks cut between pieces (memory is bounded by
``BLOCK`` or the longest piece); repeated rows count each; ids and other columns are ignored. Phrases of equal score and count are ordered by their UTF-8 bytes. No words, or no frequent phrase: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm._arrow import blocks
from strata.llm._stage import discard, kept

FLOOR, LONGEST, TOP, INSIDE = 10, 3, 2000, 50
BLOCK, LEAST_LOG2, MOST_LOG2, LOW = 1 << 21, 16, 28, 16  # LOW: bits of a slot within its range
SALTS = 64
UNKNOWN = "und"

#: Lower case for A-Z, one byte for all that ends a piece, one for what ends a word.
PLAIN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b" \t" else c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _pieces(texts: list[str | None], langs: list[str | None]) -> Iterator[tuple[bytes, str]]:
    """Translated texts with their language, cut between pieces where longer than ``BLOCK``."""
    for text, lang in zip(texts, langs):
        data, at = (text or "").encode().translate(PLAIN), 0
        while len(data) - at > BLOCK:
            to = data.rfind(b"\n", at, at + BLOCK)
            to = to if to > at else data.find(b"\n", at + BLOCK)
            if to < 0:
                break
            yield data[at:to], lang if lang is not None else UNKNOWN
            at = to + 1
        yield data[at:], lang if lang is not None else UNKNOWN


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Pieces gathered into blocks."""
    data, langs, held = [], [], 0
    for batch in blocks(batches, "text", BLOCK):
        for d, lang in _pieces(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            data.append(d)
            langs.append(lang)
            held += len(d) + 1
            if held >= BLOCK:
                yield data, langs
                data, langs, held = [], [], 0
    if held:
        yield data, langs


def _hash(word: bytes, lang: str) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang.encode()))


class Words:
    """The words of a block in order: number (the same for equal words of a language), piece, hash."""

    def __init__(self, data: list[bytes], langs: list[str]) -> None:
        raw = np.frombuffer(b"\n".join(data), np.uint8)
        ends = raw == 10
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = ends | (raw == 32)
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        first, last = edges[0::2], edges[1::2]
        self.piece = np.cumsum(ends)[first] if len(first) else first
        offsets = np.zeros(len(first) + 1, np.int64)
        np.cumsum(last - first, out=offsets[1:])
        letters = np.ascontiguousarray(raw[~gap[1:-1]])
        encoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.word, self.words = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
        known = sorted(set(langs))
        number = {x: i for i, x in enumerate(known)}
        starts = np.cumsum([0] + [len(d) + 1 for d in data[:-1]])
        self.langs = pa.array(known, pa.string())
        self.lang = np.array([number[x] for x in langs])[np.searchsorted(starts, first, "right") - 1]
        own, self.id = np.unique(self.lang * len(self.words) + self.word, return_inverse=True)
        spelled = self.words.to_pylist()
        size = max(len(spelled), 1)
        self.hash = np.array([_hash(spelled[k % size], known[k // size]) for k in own.tolist()], np.uint64)[self.id]

    def __len__(self) -> int:
        return len(self.word)

    def whole(self, n: int) -> np.ndarray:
        """For each word whether n words from it on lie in one piece."""
        out = np.zeros(len(self), bool)
        if n <= len(self):
            out[: len(self) - n + 1] = self.piece[: len(self) - n + 1] == self.piece[n - 1 :]
        return out

    def slots(self, at: np.ndarray, n: int, log2: int) -> np.ndarray:
        return _slots([self.hash[at + k] for k in range(n)], log2)

    def counted(self, at: np.ndarray, n: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Language, phrase and count of each different phrase of n words at the places ``at``."""
        key, base = self.id[at], int(self.id.max(initial=0)) + 1
        for k in range(1, n):
            if len(key) and int(key.max()) + 1 >= (1 << 62) // base:
                key = np.unique(key, return_inverse=True)[1]
            key = key * base + self.id[at + k]
        _, where, count = np.unique(key, return_index=True, return_counts=True)
        where = at[where]
        words = [self.words.take(pa.array(self.word[where + k])) for k in range(n)]
        phrase = words[0] if n == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
        return self.langs.take(pa.array(self.lang[where])), phrase.cast(pa.large_string()).cast(pa.string()), count


def _slots(hashes: list[np.ndarray], log2: int) -> np.ndarray:
    """The bucket of each phrase, from its words' hashes."""
    h = hashes[0].copy()
    for other in hashes[1:]:
        h = (h ^ (h >> np.uint64(29))) * MIX + other
    h = (h ^ (h >> np.uint64(31))) * STEP
    return (h ^ (h >> np.uint64(30))) >> np.uint64(64 - log2)


def _set(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _packed(slots: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Counts of slots, as one row for each range of 2**``LOW`` slots: range, low bits, counts (at most 255)."""
    slot, count = np.unique(slots, return_counts=True)
    of = (slot >> np.uint64(LOW)).astype(np.int32)
    ranges, begin = np.unique(of, return_index=True)
    offsets = np.append(begin, len(of)).astype(np.int32)
    low, most = (slot & np.uint64((1 << LOW) - 1)).astype(np.uint16), np.minimum(count, 255).astype(np.uint8)
    binary = lambda data, o: pa.BinaryArray.from_buffers(pa.binary(), len(ranges), [None, pa.py_buffer(np.ascontiguousarray(o)), pa.py_buffer(np.ascontiguousarray(data))])
    return ranges, binary(low, offsets * 2), binary(most, offsets)


SCHEMA = "lang string, phrase string, f bigint, range int, slots binary, counts binary"
_FIELDS = ["lang", "phrase", "f", "range", "slots", "counts"]


def _bucket_rows(slots: np.ndarray) -> pa.RecordBatch:
    ranges, low, counts = _packed(slots)
    n = len(ranges)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(ranges, pa.int32()), low, counts], _FIELDS)


def _bitmap(rows: DataFrame, log2: int, floor: int) -> np.ndarray:
    """One bit for each bucket whose counts add up to ``floor``. The driver gets 2**(``log2`` - 3) bytes."""
    most = min(floor, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # a byte a bucket: 2**LOW bytes for each range of the task
        for batch in batches:
            for r, low, counts in zip(*(batch.column(c).to_pylist() for c in ("range", "slots", "counts"))):
                sums = held.setdefault(r, np.zeros(1 << LOW, np.uint8))
                at = np.frombuffer(low, np.uint16)
                sums[at] = np.minimum(sums[at].astype(np.int32) + np.frombuffer(counts, np.uint8), most)
        for r, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(sums >= most, bitorder="little").tobytes()], pa.binary())], ["range", "bits"])

    out = np.zeros(1 << (log2 - 3), np.uint8)
    for r in rows.where("range IS NOT NULL").select("range", "slots", "counts").repartition("range").mapInArrow(run, "range int, bits binary").collect():
        out[r.range << (LOW - 3) : (r.range + 1) << (LOW - 3)] = np.frombuffer(r.bits, np.uint8)
    return out


def _frequent_bits(frequent: DataFrame, log2: int, floor: int) -> np.ndarray:
    """One bit for the bucket of each phrase of ``frequent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                split = [[_hash(w.encode(), lang) for w in p.split(" ")] for p, lang in zip(batch.column("phrase").to_pylist(), batch.column("lang").to_pylist())]
                slots = _slots(list(np.array(split, np.uint64).T), log2)
                ranges, low, counts = _packed(np.unique(slots))
                full = pa.array([b"\xff" * len(c) for c in counts.to_pylist()], pa.binary())
                n = len(ranges)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(ranges, pa.int32()), low, full], _FIELDS)

    return _bitmap(frequent.select("lang", "phrase").mapInArrow(run, SCHEMA), log2, floor)


def _pass(docs: DataFrame, n: int, log2: int, more: bool, parts: np.ndarray | None, buckets: np.ndarray | None) -> DataFrame:
    """Sums of the phrases of n words that can be frequent, for each block; with ``more``, bucket counts of those of n + 1 words."""
    sent = None if parts is None else docs.sparkSession.sparkContext.broadcast((parts, buckets))  # two bitmaps of 2**(log2 - 3) bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _gathered(batches):
            w = Words(*block)
            fine = w.whole(n)
            if sent is not None:
                shorter, own = sent.value
                part = w.whole(n - 1)
                at = np.flatnonzero(part)
                part[at] = _set(shorter, w.slots(at, n - 1, log2))
                fine[:-1] &= part[:-1] & part[1:]
                at = np.flatnonzero(fine)
                fine[at] = _set(own, w.slots(at, n, log2))
            at = np.flatnonzero(fine)
            if not len(at):
                continue
            lang, phrase, count = w.counted(at, n)
            m = len(count)
            yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(count, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], _FIELDS)
            if more:
                longer = w.whole(n + 1)
                longer[:-1] &= fine[:-1] & fine[1:]
                at = np.flatnonzero(longer)
                if len(at):
                    yield _bucket_rows(w.slots(at, n + 1, log2))
                del longer
            del w, fine, at, lang, phrase, count  # one block at a time in memory

    return docs.select("lang", "text").mapInArrow(run, SCHEMA)


def frequent(docs: DataFrame, longest: int = LONGEST, floor: int = FLOOR, log2: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """For 1 to ``longest`` words the tables (lang, phrase, f) of the phrases with f >= ``floor``; and all words of each lang (lang, n)."""
    if log2 is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        log2 = min(max((size // 8).bit_length(), LEAST_LOG2), MOST_LOG2)
    found, totals, parts, buckets = [], None, None, None
    for n in range(1, longest + 1):
        rows = kept(_pass(docs, n, log2, n < longest, parts, buckets))
        phrases = rows.where("phrase IS NOT NULL")
        if n == 1:
            totals = kept(phrases.groupBy("lang").agg(F.sum("f").alias("n")))
        found.append(kept(phrases.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= floor)))
        if n < longest:
            parts, buckets = _frequent_bits(found[-1], log2, floor), _bitmap(rows, log2, floor)
        discard(rows)
    return found, totals


def _joined(words: Column, first: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def score(found: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words or more, by the cut with the lowest score.

    Both joins are on a language and a part of the phrase; adaptive execution splits a part with many phrases.
    """
    every = found[0]
    for more in found[1:-1]:
        every = every.unionByName(more)
    candidates = found[1]
    for more in found[2:]:
        candidates = candidates.unionByName(more)
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("w"), 1, F.col("k")).alias("first"), _joined(F.col("w"), F.col("k") + 1, F.size("w")).alias("rest"))
    left = every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    big = lambda c: f"CAST({c} AS DECIMAL(38,0))"
    both = both.withColumn("score", F.expr(f"({big(1000000)} * a * a) DIV ({big('l')} * r)"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def not_inside(scored: DataFrame, found: list[DataFrame], share: int = INSIDE) -> DataFrame:
    """Without the phrases that a longer one holds, which has at least ``share`` per cent of their occurrences."""
    if len(found) < 3:
        return scored
    longer = found[2]
    for more in found[3:]:
        longer = longer.unionByName(more)
    w = F.split("phrase", " ")
    lengths = longer.select("lang", "f", w.alias("w"), F.explode(F.sequence(F.lit(2), F.size(w) - 1)).alias("k"))
    inner = lengths.select("lang", "f", F.explode(F.expr("transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))")).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("outer"))
    return scored.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("outer") < share * F.col("a"), F.lit(True))).drop("outer")


def ranked(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each lang by score, count and phrase, with their rank; first within shares of each lang, so no task sorts all of one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = scored.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("rank") <= top)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top).drop("__salt")


def mine(docs: DataFrame, longest: int = LONGEST, floor: int = FLOOR, top: int = TOP, share: int = INSIDE, log2: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best phrases of 2 to ``longest`` words."""
    found, totals = frequent(docs, longest, floor, log2)
    best = ranked(not_inside(score(found), found, share), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
