"""Repeated byte strings: every byte covered by a string of ``WINDOW`` bytes that also starts earlier is removed.

Earlier means a smaller doc_id, or the same document and a smaller start. A text that equals an earlier one is removed whole, and only the
first of equal texts is looked at further. Runs of windows are found and grouped as in ``repeats``. Where
different contents share an anchor, they are cut into blocks of ``CHUNK`` bytes counted from the anchor, and a suffix array of the blocks, by
linear grouping construction (``gsaca``), groups equal stretches of ``FULL_BLOCKS`` blocks, which every window holds; the bytes of
a window before and after them are compared exactly.

Defined results: null text is empty; texts shorter than a window are kept; rows with equal doc_id and text are at the same place and don't
remove each other; rows with equal doc_id and different texts are ordered by a hash of the text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import repeats
from strata.llm._arrow import blocks
from strata.llm.gsaca import common_prefixes, suffix_array

WINDOW, CHUNK, PAIRS = 100, 33, 8


def _shared(a: bytes, b: bytes) -> int:
    """How many bytes two strings begin with in common."""
    n = min(len(a), len(b))
    return (8 * n - (int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length()) // 8


def _settle(window: int, chunk: int):
    full = (window - chunk + 1) // chunk  # whole blocks that any window holds
    width = full * chunk

    def settle(held: list[dict]) -> list[list[int]]:
        symbols: list[int] = []
        names: dict[bytes, int] = {}
        starts, offsets = [], []  # of each content: its first symbol, and where that begins in the bytes
        for r in held:
            text, o = r["content"], r["lead"] % chunk
            offsets.append(o)
            starts.append(len(symbols))
            symbols.extend([names.setdefault(text[b : b + chunk], len(names)) for b in range(o, len(text) - chunk + 1, chunk)])
            symbols.append(-1)  # a stretch that is asked for never reaches a content's end
        order = suffix_array(symbols)
        shared = common_prefixes(symbols, order, full)
        group, g, lone = [0] * len(symbols), 0, [True]
        for s, h in zip(order, shared):
            if h < full:
                g += 1
                lone.append(True)
            else:
                lone[g] = False
            group[s] = g
        # contents of one anchor that share a stretch at the same distance from it, in the order of their places
        classes: dict[tuple, list[int]] = {}
        for i, (r, o, first) in enumerate(zip(held, offsets, starts)):
            for j in range(-(-(r["n"] - 1 - o) // chunk) + 1 if r["n"] > o else 1):
                if not lone[group[first + j]]:
                    classes.setdefault((r["anchor"], group[first + j], o + j * chunk - r["lead"]), []).append(i)
        found: list[set[int]] = [set() for _ in held]
        for (_, _, at), members in classes.items():
            if len(members) < 2:
                continue
            members.sort(key=lambda i: (held[i]["doc_id"], held[i]["tkey"], held[i]["start"] + at + held[i]["lead"]))
            tails: list[tuple[bytes, bytes]] = []  # what stands before the stretch, backwards, and after it
            least: dict[tuple, tuple] = {}
            for i in members:
                r = held[i]
                text, b = r["content"], at + r["lead"]
                low, high = max(0, b - chunk + 1), min(b, r["n"] - 1)  # windows whose first whole block this is
                if len(members) <= PAIRS:
                    mine = (text[low:b][::-1], text[b + width : high + window])
                    for before, after in tails:
                        k0, k1 = b - _shared(mine[0], before), b + width + _shared(mine[1], after) - window
                        found[i].update(range(max(low, k0), min(high, k1) + 1))
                    tails.append(mine)
                    continue
                for k in range(low, high + 1):
                    key = (b - k, text[k:b], text[b + width : k + window])
                    if least.setdefault(key, (r["doc_id"], r["tkey"], r["start"] + k)) < (r["doc_id"], r["tkey"], r["start"] + k):
                        found[i].add(k)
        return [sorted(ks) for ks in found]

    return settle


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (remaining bytes) of each row."""
    unit, docs = repeats.Bytes(window), repeats.keyed(docs)
    gone = repeats.copies(docs, window)
    own = repeats.without(docs, gone)
    found = repeats.repeated(own, unit, 35, _settle(window, CHUNK), ordered=True)
    whole = gone.select("doc_id", "tkey", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), (F.col("n") - window + 1).cast("int").alias("n"), F.lit(None).cast("array<int>").alias("ks"))).alias("ranges"))
    ranges = found.unionByName(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", repeats.BLOCK):
            out: list[list] = [[], [], [], [], []]
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                raw = text.encode()
                removed = spans = 0
                left = raw
                if ranges:
                    gone = repeats.starts_of(ranges, len(raw), window)
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for column, value in zip(out, (len(raw), removed, spans, hashlib.sha256(left).hexdigest(), left)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return repeats.apply(docs, ranges, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
