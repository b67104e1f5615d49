"""Repeated passages: every word covered by a window of ``WINDOW`` words that starts anywhere else too is removed.

Windows are found over a count-min prefilter and grouped exactly (see ``repeats``). Defined results: null text has no words; texts shorter
than a window are kept whole; equal rows count as repeats of each other; windows are judged on the input; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm import repeats
from strata.llm._arrow import blocks, utf8

WINDOW = 35


def _settle(unit: repeats.Words):
    def settle(held: list[dict]) -> list[list[int]]:
        seen: Counter = Counter()
        windows = []
        for r in held:
            text = np.frombuffer(r["content"], np.uint8)
            _, s, e, _ = unit.parse(np.array([0, len(text)]), text)
            own = [r["content"][s[k] : e[k + unit.window - 1]] for k in range(r["n"])]
            windows.append(own)
            for w in own:
                seen[w] += r["n_occ"]
        return [[k for k, w in enumerate(own) if seen[w] > 1] for own in windows]

    return settle


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the remaining words joined by one space) of each row."""
    unit, docs = repeats.Words(window), repeats.keyed(docs)
    ranges = repeats.repeated(docs, unit, 60, _settle(unit), ordered=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", repeats.BLOCK):
            n_words, n_removed, sha, kept = [], [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                words = text.encode().split()
                gone = repeats.starts_of(ranges, len(words), window) if ranges else None
                left = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g])
                n_words.append(len(words))
                n_removed.append(0 if gone is None else int(gone.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return repeats.apply(docs, ranges, run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
