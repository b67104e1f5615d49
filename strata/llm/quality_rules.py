"""Quality rules in a short-circuit cascade.

Each rule rejects a text or lets it pass; a text is kept if all pass. The rules are first run, each on its own, on a sample of at most
``SAMPLE`` documents (those with the smallest hashes of their doc_id), which gives each one's seconds and the share it rejects; over all
texts they run in descending order of rejections per second, and stop at the first that rejects. The order changes the work, never the verdict.

Words are what ASCII white space separates. Defined results: null text is empty and has no words; an empty sample leaves the rules in
the order given; repeated rows are treated alike; extra columns are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._arrow import blocks

SAMPLE, BLOCK = 1000, 1 << 21
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
CONTINUED = bytes(range(0x80, 0xC0))
SPACES = b"\t\n\x0b\x0c\r "
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
NOT_UPPER, NOT_LETTER = bytes(b for b in range(256) if b not in UPPER), bytes(b for b in range(256) if b not in UPPER + LOWER)


class Text:
    """What the rules look at, each part made when it is first asked for."""

    def __init__(self, text: str | None) -> None:
        self.raw = (text or "").encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, SPACES + CONTINUED))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw.translate(None, NOT_SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def ids(self) -> np.ndarray:
        """A number for each word, the same for equal words."""
        known: dict[bytes, int] = {}
        return np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, len(self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        ids = self.ids
        n = len(ids) - 2
        if n < 2:
            return 0
        _, pair = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)
        _, window, count = np.unique(pair[:-1] * (int(ids.max()) + 1) + ids[2:], return_inverse=True, return_counts=True)
        again = np.zeros(len(ids), bool)
        hit = count[window] > 1
        for k in range(3):
            again[k : n + k] |= hit
        return int(again.sum())

    @cached_property
    def base_failed(self) -> bool:
        n = len(self.words)
        return n < 50 or 100 * self.n_repeat_words > 50 * n


def _stutters(t: Text) -> bool:
    return len(t.ids) > 1 and 5 * int((t.ids[1:] == t.ids[:-1]).sum()) > len(t.ids)


def _shouts(t: Text) -> bool:
    letters = len(t.raw.translate(None, NOT_LETTER))
    return letters > 0 and 2 * len(t.raw.translate(None, NOT_UPPER)) > letters


#: name and whether the rule rejects a text
RULES: list[tuple[str, Callable[[Text], bool]]] = [
    ("few words", lambda t: len(t.words) < 50),
    ("repeated windows", lambda t: 100 * t.n_repeat_words > 50 * len(t.words)),
    ("symbols", lambda t: 10 * t.n_symbols > 3 * len(t.words)),
    ("upper case", _shouts),
    ("word length", lambda t: not 2 * len(t.words) <= t.word_chars <= 25 * len(t.words)),
    ("duplicate lines", lambda t: t.n_dup_lines > 3 and 2 * t.n_dup_lines > len(t.lines)),
    ("adjacent words", _stutters),
]


def plan(docs: DataFrame, rules: list = RULES, sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(name, seconds a text, share rejected) of each rule on the sample, in the order to run."""
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            seconds, rejected = [0.0] * len(rules), [0] * len(rules)
            for text in batch.column("text").to_pylist():
                for i, (_, rejects) in enumerate(rules):
                    began = time.perf_counter()
                    rejected[i] += bool(rejects(Text(text)))  # each on its own: no part is shared
                    seconds[i] += time.perf_counter() - began
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(seconds), pa.array(rejected, pa.int64()), pa.array([batch.num_rows] * len(rules), pa.int64())], ["rule", "seconds", "rejected", "n"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(run, "rule int, seconds double, rejected bigint, n bigint")
    found = {r.rule: r for r in rows.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()}
    out = [(name, found[i].seconds / found[i].n, found[i].rejected / found[i].n) if i in found else (name, 0.0, 0.0) for i, (name, _) in enumerate(rules)]
    return sorted(out, key=lambda x: -x[2] / max(x[1], 1e-9))


def ordered(planned: list[tuple[str, float, float]], rules: list = RULES) -> list:
    by_name = dict(rules)
    return [(name, by_name[name]) for name, _, _ in planned]


def first_rejection(text: Text, cascade: list) -> str | None:
    for name, rejects in cascade:
        if rejects(text):
            return name
    return None


def judge(docs: DataFrame, rules: list = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by of each row."""
    cascade = ordered(plan(docs, rules), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            out: list[list] = [[] for _ in range(8)]
            for raw in batch.column("text").to_pylist():
                t = Text(raw)
                by = first_rejection(t, cascade)
                for column, value in zip(out, (len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed, by is None and not t.base_failed, by)):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, kinds))], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, rejected_by string")


def keep(docs: DataFrame, rules: list = RULES) -> DataFrame:
    """The rows of ``docs`` that every rule passes, with all their columns."""
    cascade = ordered(plan(docs, rules), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            yield batch.filter(pa.array([first_rejection(Text(t), cascade) is None for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
