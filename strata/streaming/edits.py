"""The edit log and clock alignment as streams: the same semantics as the batch operators, kept up to date. The machine keeps its state between batches; the log is never read again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle


def item_counts(log: DataFrame) -> DataFrame:
    """doc, tier, items, last: how many items each tier has had added, as the log grows (update mode)."""
    return log.where("op = 'add_item'").groupBy("doc", "tier").agg(F.count(F.lit(1)).alias("items"), F.max("seq").alias("last"))


def ticks(events: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """doc, window, n: events in clock ticks; a tick is final once the watermark has passed it, later events are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "doc").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """doc, session_window, n: runs of events with pauses shorter than ``gap``."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "doc").agg(F.count(F.lit(1)).alias("n"))


APPLIED = "doc string, seq bigint, op string, tier string, idx bigint, status string, reason string"
_HELD = ["op", "tier", "index", "id", "name", "lexical"]


class Machine(StatefulProcessor):
    """One document's machine: what it needs to judge the next op, and the ops that came before their turn.

    State is the next place, a buffer of ops that wait for it, each tier's size and the values attached so far: no log is kept or read again. An op is applied when all
    before it have been; the first refusal stops the document. An op of a place that has had its turn is late. Where an op stays away for ``patience`` milliseconds while later ones
    wait, a timer stops the document as incomplete.
    """

    def __init__(self, patience: int) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "next bigint, stopped boolean, deadline bigint")
        self.waiting = handle.getMapState("waiting", "seq bigint", "op string, tier string, idx bigint, id string, name string, lexical string")
        self.sizes = handle.getMapState("sizes", "tier string", "n bigint")
        self.values = handle.getMapState("values", "tier string, idx bigint, name string", "seq bigint")

    def _judge(self, op: tuple, sizes: dict) -> tuple[int | None, str | None]:
        """(the item's place, why the op is refused)."""
        kind, tier, index, _, name, _ = op
        if kind not in ("add_item", "attach_value", "promote_item"):
            return None, None
        if tier not in sizes:
            sizes[tier] = self.sizes.getValue((tier,))[0] if self.sizes.containsKey((tier,)) else 0
        if kind == "add_item":
            sizes[tier] += 1
            return sizes[tier] - 1, None
        if not 0 <= index < sizes[tier]:
            return index, "no such item"
        if kind == "attach_value":
            if self.values.containsKey((tier, index, name)):
                return index, "value attached twice"
            self.values.updateValue((tier, index, name), (0,))
        return index, None

    def _dropped(self) -> dict[int, tuple]:
        """The ops that waited, which will not be applied any more."""
        held = {int(k[0]): tuple(v) for k, v in self.waiting.iterator()}
        self.waiting.clear()
        return held

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        next_, stopped, deadline = self.progress.get() if self.progress.exists() else (0, False, None)
        fresh, out, sizes, began = {}, [], {}, next_
        row = lambda seq, op, idx, status, reason=None: out.append((key[0], seq, op[0], op[1], idx, status, reason))
        for frame in rows:
            for seq, *op in frame[["seq", *_HELD]].itertuples(index=False, name=None):
                op = tuple(None if v is None or v != v else int(v) if c == "index" else v for c, v in zip(_HELD, op))
                if stopped or seq < next_ or seq in fresh or self.waiting.containsKey((int(seq),)):
                    row(int(seq), op, op[2], "stopped" if stopped else "late", None)
                else:
                    fresh[int(seq)] = op
        while not stopped:
            op = fresh.pop(next_, None)
            if op is None:
                if not self.waiting.containsKey((next_,)):
                    break
                op = tuple(self.waiting.getValue((next_,)))
                self.waiting.removeKey((next_,))
            idx, reason = self._judge(op, sizes)
            row(next_, op, idx, "applied" if reason is None else "refused", reason)
            stopped = reason is not None
            next_ += 0 if stopped else 1
        if stopped:
            fresh.update(self._dropped())
        for seq, op in fresh.items():
            if stopped:
                row(seq, op, op[2], "stopped")
            else:
                self.waiting.updateValue((seq,), op)
        for tier, n in sizes.items():
            self.sizes.updateValue((tier,), (n,))
        gap = not stopped and next(iter(self.waiting.keys()), None) is not None
        if deadline is not None and (not gap or next_ > began):
            self.handle.deleteTimer(deadline)
            deadline = None
        if gap and deadline is None:
            deadline = timerValues.getCurrentProcessingTimeInMs() + self.patience
            self.handle.registerTimer(deadline)
        self.progress.update((next_, stopped, deadline))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        next_, stopped, _ = self.progress.get()
        self.progress.update((next_, True, None))
        if not stopped:
            left = [(key[0], seq, op[0], op[1], op[2], "stopped", None) for seq, op in self._dropped().items()]
            yield _frame([(key[0], next_, None, None, None, "refused", "an op is missing"), *left])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = [c.split()[0] for c in APPLIED.split(", ")]
    frame = pd.DataFrame(rows, columns=columns)
    return frame.astype({"seq": "Int64", "idx": "Int64"} | {c: "object" for c in columns if c not in ("seq", "idx")})


def applied(log: DataFrame, patience: int = 600_000) -> DataFrame:
    """doc, seq, op, tier, idx, status, reason of each op of a stream of edits, in whatever order they arrive: ``applied`` with the item's place, ``refused``, ``late``, or ``stopped`` after a refusal.

    ``log`` has doc, seq (from 0 without gaps), op, tier, index, id, name, lexical. Append mode: a row is written once, when its turn has come.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = log.select(F.col("doc").cast("string").alias("doc"), "seq", *_HELD)
    return keyed.groupBy("doc").transformWithStateInPandas(statefulProcessor=Machine(patience), outputStructType=APPLIED, outputMode="Append", timeMode="ProcessingTime")


def dumped(log: DataFrame, path: str, checkpoint: str, patience: int = 600_000) -> DataStreamWriter:
    """A writer of every op's outcome, as it comes: each micro-batch appends its own rows."""
    return applied(log, patience).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
