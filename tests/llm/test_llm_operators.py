"""Each operator against a plain version, with odd rows, equal rows, extra columns and empty tables."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from strata.llm import decontaminate, gsaca, html_extract, near_copies, packing, pii, quality_crf, quality_rules, repeats, simhash, substring_dedup, suffix_dedup, warc
from strata.llm.queries import ORACLE, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# --- 1


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * k, 10)) for k in d[1::2])


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= sum(map(str.isdigit, m)) <= 19 and luhn(m) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(map(str.isdigit, m)) <= 15),
}


def spans_of(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in PII.items() for m in re.finditer(p, text) if ok(m[0])]


def test_personal_data_spans(spark, docs):
    odd = ["a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111111111111111-", "1 4111-1111-1111-1111", "+1 (017) 555-7713)..9 ++12345678", "é 4111111111111111\n5105105105105100", "@@a@b.co 9.9.9.9@a.b", "4" * 5000, "a" * 3000, "+1" * 50]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd, 95000)), "doc_id bigint, text string"))
    truth = {r.doc_id: spans_of(r.text or "") for r in more.collect()}
    got = pii.detect(more).collect()
    assert len(got) == len(truth)
    for r in got:
        want = truth[r.doc_id]
        assert r.base_sha256 == sha(",".join(want))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in PII]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_disclosing_terms(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = [(i, " ".join(word() for _ in range(12)) + f" zanzibar {word()} joe@x.org common {word()} " + " ".join(word() for _ in range(8))) for i in range(5)]
    rows += [(100 + i, f"{word()} common {word()}") for i in range(200)] + [(400, "zanzibar alone, without the address")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    terms = {(r.value, r.term): r.action for r in pii.disclosing_terms(docs).collect()}
    assert terms[("email:joe@x.org", "zanzibar")] == "remove" and ("email:joe@x.org", "common") not in terms
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    assert all("term:" in got[i].spans for i in range(5)) and got[400].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert len(clean) == len(rows) and clean[400] == rows[-1][1]
    assert all("[EMAIL]" in clean[i] and "zanzibar" not in clean[i] and "common" in clean[i] for i in range(5))


def plain_terms(rows):
    """(value, term) to (bits, content, action) by the definition, over (doc_id, text) rows."""
    words = [[w.lower() for w in re.findall(r"[^\W\d_]+", t or "") if len(w) >= 4] for _, t in rows]
    df, classes, pairs, values = Counter(), Counter(), {}, {}
    for own in words:
        df.update(set(own))
        classes.update({w[:3] for w in own})
    for i, (_, t) in enumerate(rows):
        for span in spans_of(t or ""):
            kind, s, e = span.split(":")[0], *map(int, span.split(":")[1:])
            value = f"{kind}:{t[s:e].lower()}"
            values.setdefault(value, set()).add(i)
            a, z = max(0, s - 60), min(len(t), e + 60)
            frag = (" " + t + " ")[a : z + 2]
            for m in re.finditer(r"(?<![^\W\d_])[^\W\d_]{4,}(?![^\W\d_])", frag):
                at = a - 1 + m.start()
                if m.start() > 0 and m.end() < len(frag) and (at + len(m[0]) <= s or at >= e):
                    pairs.setdefault((value, m[0].lower()), set()).add(i)
    out, n = {}, len(rows)
    for (value, term), docs in pairs.items():
        content, k = math.log2(n / len(values[value])), len(docs)
        bits = math.log2(k * n / (len(values[value]) * (df[term] + 1)))
        if content > 0 and bits >= 0.7 * content:
            coarse = math.log2(k * n / (len(values[value]) * (classes[term[:3]] + 1)))
            out[value, term] = (bits, content, "generalise" if bits < 0.9 * content and coarse < 0.7 * content else "remove")
    return out


def test_disclosing_terms_against_a_plain_version(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_terms(rows)
    got = {(r.value, r.term): r for r in pii.disclosing_terms(docs).collect()}
    assert set(got) == set(want) and len(want) > 20 and {w[2] for w in want.values()} == {"remove", "generalise"}
    for k, (bits, content, action) in want.items():
        assert abs(got[k].bits - bits) < 1e-9 and abs(got[k].content - content) < 1e-9 and got[k].action == action


def test_personal_data_without_or_with_shared_ids(spark):
    said = "zanzibar " + "alpha beta gamma delta " * 30
    rows = [(None, f"zanzibar writes joe{k % 2}@x.org today") for k in range(4)] + [(7, "zanzibar writes joe0@x.org today"), (7, "the quick brown fox jumps over"), (8, f"{said} joe1@x.org zanzibar {said}")]
    rows += [(100 + k, f"other words of number {k} alpha beta gamma delta") for k in range(400)] + [(3000, "mail a@b.co " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = pii.detect(docs).collect()
    assert len(got) == len(rows) and sorted(r.n_email for r in got if r.doc_id == 7) == [0, 1] and max(r.n_email for r in got) == 2000
    assert all(("term:" in r.spans) == bool(r.n_email) for r in got if r.doc_id in (None, 7))
    out = pii.sanitise(docs).collect()
    assert sorted(r.text for r in out if r.doc_id == 7)[1] == "the quick brown fox jumps over"
    assert not any("zanzibar" in r.text for r in out if r.doc_id in (None, 8)) and sum("zanzibar" in r.text for r in out) == 0
    assert [r.text for r in out if r.doc_id == 3000][0].count("[EMAIL]") == 2000


def test_sanitising_keeps_rows_and_columns(docs, texts):
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        assert (r.text or "") == texts[r.doc_id] or spans_of(texts[r.doc_id])
        assert not re.search(PII["email"][0], r.text or "")


# --- 2


def test_rules(docs, texts):
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        w = WORD.findall(t)
        c, again = Counter(zip(w, w[1:], w[2:])), bytearray(len(w))
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                again[i : i + 3] = b"\1\1\1"
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), sum(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * sum(again) > 50 * len(w))
        assert r.kept == all(not rule(quality_rules.Text(t)) for _, rule in quality_rules.RULES)


def test_cascade_order_is_rejections_per_cost(docs):
    planned = quality_rules.plan(docs)
    rate = [share / max(seconds, 1e-9) for _, seconds, share in planned]
    assert rate == sorted(rate, reverse=True) and {n for n, *_ in planned} == {n for n, _ in quality_rules.RULES}
    assert quality_rules.first_rejection(quality_rules.Text("one two"), [("a", lambda t: True), ("b", lambda t: 1 / 0)]) == "a"


# --- 3

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_contamination(spark, docs, texts):
    base = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = base.unionByName(spark.createDataFrame([(9001, "the OF and"), (9002, ""), (9003, None), (9004, "same text twice"), (9005, "a")], base.schema))
    windows: dict = {}
    for r in items.collect():
        w = BENCH_WORD.findall((r.text or "").translate(UP))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(r.item_id)
    sizes = {len(k) for k in windows}
    got = decontaminate.report(docs, items).collect()
    assert len(got) == len(texts)
    for r in got:
        w = BENCH_WORD.findall(texts[r.doc_id].translate(UP))
        hit, found = bytearray(len(w)), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if k := windows.get(tuple(w[i : i + n])):
                    found |= k
                    hit[i : i + n] = b"\1" * n
        h = sum(hit)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), h, len(found), sha(",".join(sorted(map(str, found)))), h > 0 and 20 * h >= len(w))
    bad = {r.doc_id for r in got if r.contaminated}
    out = decontaminate.clean(docs, items)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(texts) - bad


def test_contamination_without_or_with_shared_ids(spark):
    item = " ".join(f"item{k}" for k in range(20))
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(None, item), (None, "clean text"), (5, item), (5, "also clean"), (5, item), (6, "w " * 30000 + item)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.contaminated) for r in decontaminate.report(docs, items).collect())
    assert got == [("5", 2, 0, False), ("5", 20, 20, True), ("5", 20, 20, True), ("6", 30020, 20, False), ("None", 2, 0, False), ("None", 20, 20, True)]
    assert sorted(r.text[:10] for r in decontaminate.clean(docs, items).collect()) == ["also clean", "clean text", "w w w w w "]


# --- 4 and 10


@pytest.mark.parametrize("group", [2000, 1])
def test_repeated_passages(docs, texts, group, monkeypatch):
    monkeypatch.setattr(repeats.settled, "__defaults__", (group,))
    words = {k: t.encode().split() for k, t in texts.items()}
    count = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    for r in substring_dedup.deduplicate(docs).collect():
        w = words.pop(r.doc_id)
        gone = bytearray(len(w))
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = b"\1" * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept) == (len(w), sum(gone), sha(kept), kept.decode())
    assert not words


@pytest.mark.parametrize("group", [2000, 1])
def test_repeated_bytes(docs, texts, group, monkeypatch):
    monkeypatch.setattr(repeats.settled, "__defaults__", (group,))
    seen, want = set(), {}
    for k in sorted(texts):
        b = texts[k].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        want[k] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(docs).collect()}
    assert got == want


def test_equal_rows_are_defined(spark):
    rows = spark.createDataFrame([(1, "w " * 40), (1, "w " * 40), (2, None), (None, "z " * 40)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.deduplicate(rows).collect()) == [(0, 40), (1, 40), (1, 40), (2, 0)]
    assert {r.n_removed for r in substring_dedup.deduplicate(rows).where("doc_id IS NULL").collect()} == {40}
    assert suffix_dedup.deduplicate(rows).count() == 4


def test_suffix_arrays():
    rng = random.Random(0)
    for _ in range(3000):
        s = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 24))]
        order = gsaca.suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        for r, h in enumerate(gsaca.common_prefixes(s, order, 5)):
            if r:
                a, b = s[order[r - 1] :], s[order[r] :]
                assert h == min(5, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


@pytest.mark.parametrize("copies, blocks_log2", [(1, 0), (8, 3)])
def test_sketch_loses_nothing_and_filters_at_any_size(copies, blocks_log2):
    """The blocks grow with the input: the share of single runs that pass stays low, and none that repeats is lost."""
    rng, unit, part_log2 = random.Random(5), repeats.Words(35), 10
    shared = " ".join(f"s{rng.random()}" for _ in range(300))
    held = []
    for k in range(20 * copies):
        text = " ".join(f"w{rng.random()}" for _ in range(200)) + (" " + shared if k % (10 * copies) == 3 else "")
        data = np.frombuffer(text.encode(), np.uint8)
        for doc, start, count, lead, anchor, said, s, e, f in repeats.runs(unit, np.array([0, len(data)]), data):
            out = np.zeros(len(doc), repeats.ENTRY)
            out["run"] = [xxhash.xxh3_64_intdigest(said[a:b].tobytes()) for a, b in zip(s[f], e[f + count + 33])]
            for name, value in (("anchor", anchor), ("doc", k), ("start", start), ("n", count), ("lead", lead), ("count", 1)):
                out[name] = value
            held.append(out)
    rows = [r for half in (held[::2], held[1::2]) for r in repeats.part(half, blocks_log2, part_log2, False, 0)]
    seen = passed = 0
    gone = []
    for b in range(1 << blocks_log2):
        block = repeats.Block(part_log2, False, 1 << 20)
        for _, kind, data in sorted((r for r in rows if r[0] == b), key=lambda r: r[1]):
            if kind == repeats.CELLS:
                block.add_cells(data)
            elif kind == repeats.RUNS:
                list(block.add_runs(data))
            else:
                gone.append(np.frombuffer(data, repeats.ENTRY)["anchor"].tolist())
        seen, passed = seen + block.seen, passed + block.passed
        gone += [x.column("doc_id").to_pylist() for x in block.end() if x.column("kind").to_pylist()[:1] == [repeats.REMOVED]]
    every = np.concatenate(held)
    anchors, n = np.unique(every["anchor"], return_counts=True)
    assert sum(map(len, gone)) >= int((n > 1).sum()) > 10
    single = int((n == 1).sum())
    assert passed - int(n[n > 1].sum()) < 0.1 * single


@pytest.mark.parametrize("ordered", [False, True])
def test_blocks_too_large_for_a_task_give_the_same(docs, ordered, monkeypatch):
    operator = (substring_dedup, suffix_dedup)[ordered]
    want = sorted(map(str, operator.deduplicate(docs).drop("kept").collect()))
    monkeypatch.setattr(repeats.occurrences, "__defaults__", (9, 20))  # tiny blocks, and tiny memory for each
    assert sorted(map(str, operator.deduplicate(docs).drop("kept").collect())) == want


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_many_small_parts_give_the_same(docs, operator, monkeypatch):
    want = sorted(map(str, operator.deduplicate(docs).drop("kept").collect()))
    monkeypatch.setattr(repeats, "PART_BYTES", 1)
    monkeypatch.setattr(repeats, "BLOCK", 1)
    assert sorted(map(str, operator.deduplicate(docs).drop("kept").collect())) == want


# --- 5


def test_archives(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x"), (2, "http://b/ c\n", "<p>x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 70000), (6, "u", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for page_id, _, h in rows:
        b = (h or "").encode()
        last = max(p for p, _, x in rows if (x or "") == (h or ""))
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last == page_id else ("revisit", last))
        assert r.payload == (b if last == page_id else None)
    assert "\n" not in got[2].url
    (tmp_path / "one.warc.gz").write_bytes(b"".join(warc.member(warc.record(i, "u", b"p" * i, None)) for i in range(3)))
    assert sorted(r.payload_bytes for r in warc.read_files(spark, str(tmp_path)).collect()) == [0, 1, 2]


def test_broken_archives_raise():
    good = warc.record(1, "u", b"payload", None)
    with pytest.raises(ValueError, match="inside a member"):
        list(warc.records(warc.member(good)[:-12]))
    with pytest.raises(ValueError, match="frame"):
        list(warc.records(warc.member(good + b"x")))
    with pytest.raises(ValueError, match="digest"):
        [warc.parsed(*r) for r in warc.records(warc.member(good.replace(b"payload\r\n", b"Payload\r\n")))]
    assert len(list(warc.records(warc.member(good) * 3, step=7))) == 3


def test_warc_of_other_writers(spark, tmp_path):
    def foreign(kind, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1b4e28ba-2fa1-11d2-883f-0016d3cca427>", *more, f"Content-Length: {len(block)}"]
        return warc.member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhello"
    parts = [foreign("warcinfo", b"software: x"), foreign("response", page), foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n"), warc.member(warc.record(5, None, b"ours", None))]
    (tmp_path / "mixed.warc.gz").write_bytes(b"".join(parts))
    got = sorted((r.record_type, r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_files(spark, str(tmp_path)).where("payload IS NOT NULL").collect() if r.page_id)
    assert got == [("response", 5, 4, warc.digest(b"ours"))]
    rows = {(r.record_type, r.page_id, r.payload_bytes, r.refers_to) for r in warc.read_files(spark, str(tmp_path)).collect()}
    assert rows == {("response", None, 5, None), ("revisit", None, None, None), ("response", 5, 4, None)}
    run = lambda data: [warc.parsed(*r) for r in warc.records(data)]
    assert run(foreign("response", page, "WARC-Payload-Digest: sha256:2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"))[0][1] == 5
    nameless = warc.member(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    unframed = warc.member(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n\r\n\r\n")
    for bad in (nameless, unframed, b"not gzip at all", foreign("response", page, "WARC-Payload-Digest: sha1:AAAA"), foreign("response", page, "WARC-Block-Digest: crc:1")):
        with pytest.raises(ValueError):
            run(bad)


# --- 6


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    field = quality_crf.Field(rng.normal(size=quality_crf.SIZE), rng.normal(size=(2, 2)), 0.5)
    doc, x = np.array([0, 0, 0, 1, 2, 2]), rng.normal(size=(6, quality_crf.SIZE))
    p, moves, total = field.marginals(doc, x)
    emit, want, pairs = x @ field.weights, np.zeros(6), np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        weights = {}
        for code in range(1 << len(at)):
            y = [code >> i & 1 for i in range(len(at))]
            weights[tuple(y)] = np.exp(sum(emit[i] * v for i, v in zip(at, y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        for y, w in weights.items():
            want[at] += np.array(y) * w / z
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w / z
    assert np.allclose(p, want) and np.allclose(moves, pairs)


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    field = quality_crf.train(docs, labels)
    got = quality_crf.score(docs, field).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() > 0.93
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) for i in got.doc_id)


def test_scores_of_odd_texts(spark, docs, nothing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    field = quality_crf.train(docs, labels)
    got = {r.doc_id: r for r in quality_crf.score(docs, field).collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[90001].score == got[90002].score == field.share
    kept = quality_crf.keep_good(docs, field)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}
    assert quality_crf.train(docs, labels.where("false")).share == 0.5
    assert quality_crf.score(nothing, field).count() == 0


# --- 7


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(tokenizer_path())
    extra = {97001: "a  b   c \n d \n \n e  ", 97002: "I'm <|endoftext|> x  y \t z", 97003: " 　 a  ", 97004: "\x1c  \x1d x  ", 97005: "a.  <|endoftext|>   b\n\n\n c\u00a0 d \u3000e é  ü   x", 97006: "word " * 50000 + "x" * 70000}
    both = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(list(extra.items()), "doc_id bigint, text string"))
    by_doc: dict = {}
    rows = packing.pack(both, tokenizer_path(), with_ids=True).collect()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.offset == 0 and len(r.ids) == r.length and r.length & (r.length - 1) == 0 and r.length <= 1024
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        own = by_doc.setdefault(r.doc_id, [])
        assert r.start == len(own)
        own += r.ids
    assert len({r.sequence_id for r in rows}) == len(rows)
    everything = texts | extra
    assert by_doc == {k: codec.encode(t, add_special_tokens=False).ids + [0] for k, t in everything.items()}
    assert all(1 << r.bucket == r.length for r in rows)
    assert packing.pieces(2500) == [1024, 1024, 256, 128, 64, 4] and sum(packing.pieces(1023)) == 1023


def test_packing_forgets_within_its_bound(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3000)
    words, spaced = packing._Words(tokenizer_path()), packing._Words(tokenizer_path(), " ")
    text = " ".join(f"w{k}" for k in range(300)) + " " + "y" * 1000
    assert packing.token_ids(text, words, spaced) == words.ids(text) and len(spaced) < 20 and not any(len(k) > 200 for k in spaced)
    packing.write_buckets(packing.pack(docs.limit(50), tokenizer_path()), f"{tmp_path}/buckets")
    back = docs.sparkSession.read.parquet(f"{tmp_path}/buckets")
    assert back.where("length != shiftleft(1, bucket)").count() == 0 and back.count() > 50


def test_packing_knows_added_tokens(spark, tmp_path):
    """The query and the pipeline's stage against tokenizers with its defaults."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from strata.llm.queries import op7_packing

    texts = ["stop <|endoftext|> go", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "<|endoftext|", "x  <|endoftext|>\n y", "plain", ""]
    codec = Tokenizer.from_file(tokenizer_path())
    want = {k: codec.encode(t, add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}
    assert want[0] == [11338, 220, 50256, 467, 0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got: dict = {}
    for r in sorted(corpus_pipeline.packed(spark, docs, "").collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == want
    crc = {(r.doc_id, r.start): (r.ids_crc32, r.doc_tokens) for r in op7_packing(spark, str(tmp_path)).collect()}
    assert all(crc[k, a] == (zlib.crc32(np.array(want[k][a : a + n], "<u4").tobytes()), len(want[k])) for k in want for a, n in zip(np.cumsum([0, *packing.pieces(len(want[k]))]).tolist(), packing.pieces(len(want[k]))))


# --- 8


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [4096, 4, 3])
def test_near_duplicates(docs, texts, bucket, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (4, bucket))
    if bucket == 3:
        monkeypatch.setattr(simhash, "bands_for", lambda n: simhash.tables(6, 2))
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    ids = sorted(prints)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= 4 and least[j] < least[i]:
                    least[i], changed = least[j], True
    got = {r.doc_id: r for r in simhash.components(docs).collect()}
    assert {k: r.fp % 2**64 for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == least
    if bucket == 4096:
        out = simhash.keep_one(docs)
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(set(least.values()))


@pytest.mark.parametrize("n", [100, 3 << 20, 1 << 29, 1 << 40])
def test_bands_follow_the_number_of_points(n):
    tables = simhash.bands_for(n)
    rng = random.Random(n)
    bits = [sum(w for _, w in t) for t in tables]
    assert n < 1 << 21 or n >> min(bits) <= 256 or len(tables) == 70
    for _ in range(300):
        flips = sum(1 << k for k in rng.sample(range(64), 4))
        assert any(all(not flips >> at & (1 << w) - 1 for at, w in t) for t in tables)


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "same words here and there again"), (None, "other text entirely, nobody has it"), (5, "same words here and there again"), (5, "same words here and there again"), (3, "unique words of its own and more"), (9, "same words here and there again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for keep in (simhash.keep_one, near_copies.keep_one):
        assert sorted(map(str, keep(docs).collect())) == sorted(map(str, docs.where("doc_id = 3 OR text LIKE 'other%'").collect() + docs.where("doc_id = 5").limit(1).collect()))
    assert {r.component_id for r in simhash.components(docs).collect()} == {5, 3, None}


def test_vantage_trees_find_all_pairs():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    points[200:] = points[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    found = {(int(a), int(b)) for i, j in simhash.VantageTree(points, leaf=4).within(points, 4) for a, b in zip(i, j)}
    assert found == {(i, j) for i in range(400) for j in range(400) if int(points[i] ^ points[j]).bit_count() <= 4}


# --- 9


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div class="cookie-notice">We use cookies on this site and you should agree to them now.</div><article><h1>A &amp; B</h1><p>First   paragraph,<br>with a line &lt;break&gt; and some more words in it.<p>Ti.</p><aside>Read this too, it is
a related story.</aside><form><input><label>Your name</label></form><p>Last&nbsp;words</article><div id="comments"><p>I like this a lot and say so in many words.</div><footer>(c)</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "A & B First paragraph, with a line <break> and some more words in it. Ti. Last words"
    for odd in ("", "<", "<p", "<!-- open", "<a href='x>y</a>", "&", "</p></p>", "<script>", "text only with a good number of words in it, as it should be"):
        assert isinstance(html_extract.main_text(odd), str)


WRAPPED = ['<body class="no-sidebar">{}</body>', '<div class="main-content with-sidebar">{}</div>', '<article class="post has-comments">{}</article>', '<div class="site footer-widgets-3">{}</div>', '<div class="sidebar">{}</div>']


@pytest.mark.parametrize("wrapped", WRAPPED)
def test_names_of_classes_do_not_drop_an_article(wrapped):
    text = "Sentence number words go here. " * 22
    page = f"<html><ul><li><a href=x>Home</a><li><a href=y>News</a></ul>{wrapped.format(f'<p>{text}</p>')}</html>"
    assert html_extract.main_text(page) == text.strip()
    if "sidebar\">" not in wrapped or "-" in wrapped:  # a plain sidebar keeps its mark beside other text
        remarks = page.replace("</html>", f"<div class=comments><p>{text[:93]}</p></div></html>")
        assert html_extract.main_text(remarks) == text.strip()


@pytest.mark.parametrize("unit", ["<a<b '<script>/", "<a href='x\" ", '<p class="a', "< ", "<!x", "<a b='", "<div class=ad><p>x ", "&amp;<b>", "</p>"])
def test_hostile_pages_take_linear_time(unit):
    took = []
    for size in (1 << 16, 1 << 18):
        began = time.perf_counter()
        html_extract.main_text(unit * (size // len(unit)))
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.2  # four times the text


def test_tree_fits_its_labelled_pages():
    rows = html_extract.labelled()
    assert len(rows) > 100 and all(html_extract.decide(html_extract.tree(), r[:-1]) == r[-1] for r in rows)
    assert html_extract.tree()[0] in (0, 1, 6, 7, 8, 9)  # the first question is about words or link density


#: Held-out pages, none of them with an article or a main element: fragments in order, each main text (1) or not (0).
HELD_OUT = [
    [(0, "<div>Menu</div>"), (1, "<div><h1>Title</h1><p>Short text of ten words here is all there is</p></div>")],
    [(1, "<h1>Title</h1><p>Only one short paragraph here on this page</p>")],
    [(1, "<p>Only one short paragraph here on this page</p>")],
    [(1, "<h1>The mill</h1>" + "".join(f"<p>{x} the wheel turns in the stream</p>" for x in "again slowly still always once under behind below softly never".split() * 2))],
    [(1, "<h2>Words</h2><dl>" + "".join(f"<dt>{x}</dt><dd>a part of the {x} that moves</dd>" for x in "sail mast keel rudder deck hull bow stern anchor line".split()) + "</dl>")],
    [
        (0, "<div class='topMenu'><ul><li><a href=/>Home</a><li><a href=/b>Boats</a></ul></div>"),
        (1, "<h1>Repairing a hull</h1><p>Dry the boat for a week before you begin with any of the work below.</p>"),
        (0, "<div class='advert__inner'>Buy the new paint today and save ten per cent on everything</div>"),
        (1, "<p>Then sand it down, first with coarse and then with fine paper.</p><p>Paint it twice.</p>"),
        (0, "<div class='socialShare'>Tell your friends about this page</div><div class='commentThread'><p>Mine took two weeks to dry, so be patient with yours.</p></div>"),
    ],
    [
        (0, "<div id='cookieBar'>We use cookies to make this page better for you and for us</div>"),
        (1, "<div class='storyContent'><h1>Rain at last</h1><p>It rained on Monday for the first time since the spring.</p><ul><li>Fields are green again</li><li>Rivers rise</li></ul><p>More is on its way.</p></div>"),
        (0, "<div class='js-newsletter-form'><p>Leave your address and get our letters every week</p></div><div>All rights reserved 2024</div>"),
    ],
    [
        (0, "<table><tr><td><a href=/>Start</a></td><td><a href=/a>Archive</a></td></tr></table>"),
        (1, "<div>The old bridge was built of oak and stood for a hundred years until the great flood took it away one night in March.</div><div>Nobody was hurt that night.</div><div>The new one is made of stone, is wider, and has a small house for the keeper at its northern end.</div>"),
        (0, "<h3>Read also</h3><ul><li><a href=/1>The flood of that year</a></li><li><a href=/2>How the mill was lost</a></li></ul>"),
    ],
]


def test_held_out_pages_without_articles():
    right = total = 0
    for page in HELD_OUT:
        done, whole = 0, html_extract.blocks_of("".join(x for _, x in page))
        decided = [html_extract.decide(html_extract.tree(), x) for x in html_extract.features(whole)]
        for k, (label, _) in enumerate(page):
            n = len(html_extract.blocks_of("".join(x for _, x in page[: k + 1])))
            right, total, done = right + sum(d == label for d in decided[done:n]), total + n - done, n
    assert total > 70 and right >= 0.97 * total, (right, total)
    for page in HELD_OUT[:5]:  # short pages lose nothing
        text = " ".join(b[0] for b in html_extract.blocks_of("".join(x for label, x in page if label)))
        assert html_extract.main_text("".join(x for _, x in page)) == text


@pytest.mark.parametrize("name", "ad-slot advert__inner AdBox adsbygoogle promo-unit share-buttons related-stories author-bio discussion gdpr-notice paywall outbrain advertContainer js-newsletter-form socialShare commentThread cookieBar".split())
def test_names_in_an_article(name):
    assert name in html_extract.BESIDE_NAMES or html_extract.beside(name) > 0.5
    page = "<article><h1>Rain at last</h1><p>It rained on Monday for the first time since the spring began.</p>{}<p>More is on its way, they say.</p></article>"
    unit = f"<div class='{name}'>Some thirteen words that are no part of what this page is about</div>"
    assert html_extract.main_text(page.format(unit)) == html_extract.main_text(page.format(""))


@pytest.mark.parametrize("name", "articleText storyContent textBlock reading-list shadow-box no-sidebar col-12 chapter-two wp-caption poem-line adventure-story entry__text news-text".split())
def test_names_that_keep_text(name):
    page = f"<article><h1>Rain at last</h1><p>It rained on Monday.</p><div class='{name}'>Some thirteen words that are a part of what this page is about</div></article>"
    assert "thirteen" in html_extract.main_text(page)


def test_a_footer_longer_than_its_article():
    page = "<article><h1>Rain</h1><p>It rained.</p></article><footer>A house of news since the year of the great flood, in the old town by the river, and proud of it</footer>"
    assert html_extract.main_text(page) == "Rain It rained."


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html

    whole = {r.page_id: r.html for r in pages.collect()}
    got = html_extract.extract(pages.unionByName(spark.createDataFrame([(9001, None, None)], pages.schema))).collect()
    assert len(got) == len(whole) + 1
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id == 9001:
            assert r.text == ""
            continue
        inside = re.search(r"<article>(.*?)</article>", whole[r.page_id], re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|br|h1)>", inside))
        assert r.text == " ".join(x for x in parts if x)


def test_mass_copies_in_archives(spark):
    rows = [(i, "u", "copy " * 50) for i in range(300)] + [(None, "u", "copy " * 50), (900, "u", None), (901, "u", ""), (902, "u", "single"), (None, "u", "nameless"), (None, "v", "nameless")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    want = [(i, "response" if i == 299 else "revisit", None if i == 299 else 299) for i in range(300)]
    want += [(None, "revisit", 299), (900, "revisit", 901), (901, "response", None), (902, "response", None), (None, "response", None), (None, "response", None)]
    assert got == sorted(want, key=str)


def test_training_is_bounded_in_lines(spark):
    text = "\n".join(f"line {i} of words that say something" for i in range(3000))
    rows = [(i, text if i % 2 else "BUY!!! NOW $$$ " * 4) for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([*rows, *rows[:5], (None, text)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    seen = []
    fit = quality_crf.fit
    try:
        quality_crf.fit = lambda doc, x, label, share: seen.append((len(x), len(set(doc.tolist())), max(np.bincount(doc)))) or fit(doc, x, label, share, 60)
        field = quality_crf.train(docs, labels, most=16)
    finally:
        quality_crf.fit = fit
    assert seen[0][1] == len(rows) and seen[0][2] == 16 and seen[0][0] == sum(16 if i % 2 else 1 for i, _ in rows)
    got = quality_crf.score(docs, field).collect()
    assert len(got) == len(rows) + 6 and all((r.score >= 0.7) == (r.doc_id is None or r.doc_id % 2 == 1) for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)


# --- all


def test_empty_tables(spark, nothing):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for df in (pii.detect(nothing), pii.sanitise(nothing), quality_rules.judge(nothing), decontaminate.report(nothing, bench), substring_dedup.deduplicate(nothing), suffix_dedup.deduplicate(nothing), packing.pack(nothing, tokenizer_path()), simhash.components(nothing)):
        assert df.count() == 0
    pages = spark.read.parquet(f"{SF}/pages.parquet").where("false")
    assert warc.round_trip(pages).count() == html_extract.extract(pages).count() == 0


def test_empty_benchmark(spark, docs):
    none = spark.read.parquet(f"{SF}/benchmark.parquet").where("false")
    assert decontaminate.report(docs, none).where("contaminated OR n_hit > 0").count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES} and set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
