"""The stateful edit stream against the batch replay, under shuffled arrival."""

import random
import time

from strata.operators import machine
from strata.streaming import edits

SCHEMA = "doc string, seq bigint, op string, tier string, index bigint, id string, name string, lexical string, rel string, l bigint, r bigint"


def op(doc, seq, kind, tier="t", index=None, id=None, name=None, lexical=None):
    return (doc, seq, kind, tier, index, id, name, lexical, None, None, None)


def logs():
    rng = random.Random(3)
    rows = []
    for d in range(6):
        n, seq = {"t": 0, "u": 0}, 0
        for _ in range(25):
            tier = rng.choice("tu")
            if n[tier] == 0 or rng.random() < 0.5:
                rows.append(op(f"d{d}", seq, "add_item", tier))
                n[tier] += 1
            elif rng.random() < 0.5:
                rows.append(op(f"d{d}", seq, "promote_item", tier, rng.randrange(n[tier]), f"i{seq}"))
            else:
                rows.append(op(f"d{d}", seq, "attach_value", tier, rng.randrange(n[tier] + (d % 2)), None, f"n{rng.randrange(9 if d % 3 else 3000)}", "1"))
            seq += 1
    return rows


def played(spark, path, name, batches, patience=600_000):
    """The outcomes when the rows come in the given batches, one file and one micro-batch each."""
    made = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{path}/in")
        stream = spark.readStream.schema(SCHEMA).json(f"{path}/in")
        q = edits.dumped(stream, f"{path}/out", f"{path}/check", patience).start()  # timers need batches without data: the query goes on until it is stopped
        deadline, read = time.time() + 60, 0
        while read < len(rows) and time.time() < deadline and q.isActive:
            time.sleep(0.2)
            read = sum(p.numInputRows for p in q.recentProgress)
        last = q.lastProgress.batchId
        while q.lastProgress.batchId < last + 2 and time.time() < deadline and q.isActive:
            time.sleep(0.2)
        q.stop()
        assert q.exception() is None and read == len(rows)
        made.append(k)
    return spark.read.schema(edits.APPLIED).parquet(f"{path}/out").collect()


def test_shuffled_arrival_equals_the_batch(spark, tmp_path):
    rows = logs()
    log = spark.createDataFrame(rows, SCHEMA)
    stops = {r.doc: (r.seq, r.reason) for r in machine.first_refusal(log).collect()}
    assert 0 < len(stops) < 6
    mixed = rows[:]
    random.Random(5).shuffle(mixed)
    size = len(mixed) // 3 + 1
    batches = [mixed[k : k + size] for k in range(0, len(mixed), size)] + [[r for r in rows if r[0] == "d2"][:4]]
    got = played(spark, str(tmp_path), "a", batches)
    refused = {r.doc: (r.seq, r.reason) for r in got if r.status == "refused"}
    assert refused == stops
    applied = {(r.doc, r.seq): r for r in got if r.status == "applied"}
    assert set(applied) == {(r[0], r[1]) for r in rows if r[0] not in stops or r[1] < stops[r[0]][0]}
    items = {(r.doc, r.seq): (r.tier, r.idx) for r in machine.replay_items(log).collect()}
    assert all((r.tier, r.idx) == items[k] for k, r in applied.items() if r.op == "add_item")
    # what came twice is late where the document went on, and after a refusal nothing is applied
    again = [r for r in got if r.status in ("late", "stopped") and r.doc == "d2"]
    assert len(again) >= 4 and len(got) == len(rows) + 4


def test_a_missing_op_stops_the_document_after_a_while(spark, tmp_path):
    rows = [op("a", 0, "add_item"), op("a", 2, "add_item"), op("b", 0, "add_item"), op("b", 1, "add_item")]
    got = played(spark, str(tmp_path), "b", [rows, [op("c", 0, "add_item")], [op("a", 1, "add_item"), op("b", 2, "add_item")]], patience=1)
    by = {}
    for r in got:
        by.setdefault(r.doc, []).append((r.seq, r.status, r.reason))
    assert (1, "refused", "an op is missing") in by["a"] and (1, "stopped", None) in by["a"]
    assert sorted(by["b"]) == [(0, "applied", None), (1, "applied", None), (2, "applied", None)]
