"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. A line's numbers are its own and its two neighbours'; neighbouring labels are tied by
transition weights. The marginal probability of *good*, by the forward-backward recursion and weighted by the lines' words, is the
document's score. The field is fitted here, by gradient ascent on the penalised conditional likelihood, each line of a labelled document
taking its document's label.

Training reads at most ``SAMPLE`` labelled documents, of each at most ``LINES`` lines in a row: those with the smallest hashes of their doc_id, among rows whose
``crc32(doc_id as text) % 4`` isn't 2. Labels, language, source and doc_id are never inputs of a score.

Defined results: null and empty texts, and texts without words, get the share of good documents in training; without labelled rows every
score is 0.5; repeated rows and ties are treated alike; rows with a null doc_id are scored, not held out and never learnt from; very long texts are scored
whole, one step a line; empty tables give empty results; extra columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm._arrow import blocks, utf8
from strata.llm.repeats import Words, mix

SAMPLE, LINES, THRESHOLD, STEPS, PENALTY, BLOCK = 4000, 512, 0.7, 200, 1e-3, 1 << 21
OWN, NEAR = 8, 5  # numbers of a line; the first NEAR of them are taken from its neighbours too
SIZE = 1 + OWN + 2 * NEAR + 3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>~^=_{}[]\\")] = True


def line_features(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's place, words, features) of every line with a word, in order."""
    n, docs = len(data), len(off) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SIZE), np.float32)
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    first[1:] |= data == 10
    first = first[:n]
    start = np.flatnonzero(first)
    end = np.append(start[1:], n)
    doc = np.searchsorted(off, start, side="right") - 1
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1] | first[1:]

    def each(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[end] - total[start]).astype(np.float64)

    words = each(begins)
    upper, lower = each((data >= 65) & (data <= 90)), each((data >= 97) & (data <= 122))
    at = np.flatnonzero(begins)
    same = np.zeros(n, bool)
    if len(at):
        begin = np.zeros(n, np.int64)
        begin[at] = at
        np.maximum.accumulate(begin, out=begin)
        value = (data.astype(np.uint64) + np.uint64(1)) * Words.TABLE[(np.arange(n) - begin) & 1023]
        value[space] = 0
        h = mix(np.add.reduceat(value, at))
        line_of = np.cumsum(first)[at]
        same[at[1:]] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    per_word = np.maximum(words, 1)
    own = np.stack(
        [
            upper / np.maximum(upper + lower, 1),
            np.minimum(2 * each(SYMBOLS[data]) / per_word, 1),
            np.minimum(each(data == 33) / per_word, 1),
            each(same) / per_word,
            np.minimum(each((data >= 48) & (data <= 57)) / np.maximum(each(~space), 1), 1),
            np.log1p(words) / 6,
            np.minimum(each(~space) / per_word, 30) / 30,
            (words < 4).astype(np.float64),
        ],
        axis=1,
    )
    full = words > 0
    own, doc, words = own[full], doc[full], words[full].astype(np.int64)
    out = np.zeros((len(own), SIZE), np.float32)
    out[:, 0] = 1
    linked = doc[1:] == doc[:-1]
    own[:, [5, 7]] *= (np.append(linked, False) | np.append(False, linked))[:, None] if len(own) else 1  # lengths tell something beside neighbours
    out[:, 1 : 1 + OWN] = own
    if len(own) > 1:
        out[1:, 1 + OWN : 1 + OWN + NEAR] = own[:-1, :NEAR] * linked[:, None]
        out[:-1, 1 + OWN + NEAR : 1 + OWN + 2 * NEAR] = own[1:, :NEAR] * linked[:, None]
        out[1:, -3] = linked
        out[:-1, -2] = linked
    out[:, -1] = 1 - np.maximum(out[:, -3], out[:, -2])  # alone in its document
    return doc, words, out


class Field:
    """Weights of label *good* against *bad* for each feature, and of the four transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, share: float) -> None:
        self.weights, self.moves, self.share = weights, moves, share

    def marginals(self, doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, expected transitions, and each document's log partition. Documents run side by side."""
        good = x @ self.weights
        ids, first, length = np.unique(doc, return_index=True, return_counts=True)
        by_length = np.argsort(-length, kind="stable")
        first, length = first[by_length], length[by_length]
        live = np.searchsorted(-length, -np.arange(int(length[0])), side="left") if len(length) else np.zeros(0, int)
        emit = np.stack([np.zeros(len(x)), good], axis=1)
        forward, backward = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        both = lambda a: np.logaddexp(a[:, 0], a[:, 1])
        for t, k in enumerate(live):
            i = first[:k] + t
            if not t:
                forward[i] = emit[i]
            else:
                p = forward[i - 1]
                forward[i] = emit[i] + np.logaddexp(p[:, :1] + self.moves[0], p[:, 1:] + self.moves[1])
        for t in range(len(live) - 2, -1, -1):
            i = first[: live[t + 1]] + t
            q = backward[i + 1] + emit[i + 1]
            backward[i] = np.logaddexp(q[:, :1] + self.moves[:, 0], q[:, 1:] + self.moves[:, 1])
        z = np.zeros(len(x))
        total = both(forward[first + length - 1]) if len(first) else np.zeros(0)
        np.put(z, first, total)
        z = z[np.repeat(np.sort(first), length[np.argsort(first)])]
        p = np.exp(forward[:, 1] + backward[:, 1] - z)
        chained = np.flatnonzero(doc[1:] == doc[:-1])
        pair = forward[chained][:, :, None] + self.moves[None] + (emit[chained + 1] + backward[chained + 1])[:, None, :] - z[chained][:, None, None]
        return p, np.exp(pair).sum(axis=0), total

    def scores(self, docs: int, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        doc, words, x = line_features(off, data)
        out = np.full(docs, self.share)
        if len(doc):
            p, _, _ = self.marginals(doc, x.astype(np.float64))
            weight = np.bincount(doc, words, docs)
            some = weight > 0
            out[some] = (np.bincount(doc, words * p, docs)[some] / weight[some]).clip(0, 1)
        return out


def fit(doc: np.ndarray, x: np.ndarray, label: np.ndarray, share: float, steps: int = STEPS) -> Field:
    """Gradient ascent with step sizes by running moments; ``label`` is each line's."""
    x = x.astype(np.float64)
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)), share)
    chained = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[chained], label[chained + 1]), 1)
    m = v = np.zeros(x.shape[1] + 4)
    for step in range(1, steps + 1):
        p, moves, _ = field.marginals(doc, x)
        gradient = np.concatenate([x.T @ (label - p), (seen - moves).ravel()]) / max(1, len(x))
        gradient -= PENALTY * np.concatenate([field.weights, field.moves.ravel()])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        change = 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        field.weights = field.weights + change[:-4]
        field.moves = field.moves + change[-4:].reshape(2, 2)
    return field


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = LINES) -> Field:
    """A field fitted on at most ``sample`` labelled documents (of rows with one doc_id, that with the least text), and of each at most ``most`` lines in a
    row, from a place that its text decides. So the driver holds at most ``sample * most`` lines' numbers, 180 MB.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("q"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            doc, _, x = line_features(*utf8(batch.column("text")))
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            held = []
            for a, b in zip(at.tolist(), at[1:].tolist()):
                if b - a > most:
                    a += zlib.crc32(x[a:b].tobytes()) % (b - a - most + 1)
                    b = a + most
                held.append(x[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("q"), pa.array(held, pa.binary())], ["q", "x"])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("q").alias("q"))
    found = found.select("text", "q").mapInArrow(run, "q int, x binary").collect()  # bounded as said above
    found = sorted(found, key=lambda r: (r.q, r.x))
    if not found:
        return Field(np.zeros(SIZE), np.zeros((2, 2)), 0.5)
    lines = [np.frombuffer(r.x, np.float32).reshape(-1, SIZE) for r in found]
    doc = np.repeat(np.arange(len(lines)), [len(a) for a in lines])
    label = np.array([r.q for r in found])[doc] if len(doc) else np.zeros(0, int)
    return fit(doc, np.concatenate(lines), label, float(np.mean([r.q for r in found])))


def score(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(field.scores(batch.num_rows, *utf8(batch.column("text"))))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            yield batch.filter(pa.array(field.scores(batch.num_rows, *utf8(batch.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
