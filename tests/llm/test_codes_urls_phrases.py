"""Vector codes, URL verdicts and collocations against plain versions and SQL, with odd rows, equal rows, extra columns and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from strata.llm import collocations, url_filter, vector_codes
from strata.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_url_filter", "op13_collocations"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF), c.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, c.sql(f"select {','.join(columns)} from want").fetchall()))


# --- vector codes


def plain_codes(rows, parts, entries, rounds):
    """The contract by definition, over (vec_id, integers)."""
    rows = sorted(rows)
    width = len(rows[0][1]) // parts
    cut = [[tuple(x[p * width : (p + 1) * width]) for p in range(parts)] for _, x in rows]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, book: min(range(len(book)), key=lambda k: (gap(v, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v in cut:
                members[nearest(v[p], books[p])].append(v[p])
            books[p] = [tuple(sum(c) // len(c) for c in zip(*members[k])) if k in members else b for k, b in enumerate(books[p])]
    codes = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(gap(v[p], books[p][k]) for p, k in enumerate(c)) for v, c in zip(cut, codes)]
    return {i: ("".join(f"{k:02x}" for k in c), e) for (i, _), c, e in zip(rows, codes, errors)}, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vectors(n, length, spread, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.randint(-spread, spread) / 256 + rng.choice([0, 0.001]) for _ in range(length)], rng.choice([None, 1, 2])) for i in rng.sample(range(10 * n), n)]


SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("spread, rounds, few", [(2, 2, 10_000), (40, 5, 0), (1 << 24, 2, 10_000)])
def test_codes(spark, monkeypatch, spread, rounds, few):
    """Small spreads make ties and equal entries, large ones pass what doubles add exactly."""
    monkeypatch.setattr(vector_codes, "FEW_LABELS", few)
    rows = vectors(300, 8, spread)
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5), 4, 16, rounds).collect()
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows]
    want, digest = plain_codes(whole, 4, 16, rounds)
    assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}
    label = {i: x for i, _, x in rows}
    sums = Counter()
    for i, (_, e) in want.items():
        sums[label[i]] += e
    assert all(r.label_error == sums[r.label] == sums[label[r.vec_id]] for r in got)


def test_bounds_spare_scans_and_hold():
    """Most parts of well-separated vectors are never compared with all entries again, and the bounds enclose the true distances."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-5000, 5000, (8, 4))
    x = centres[rng.integers(0, 8, 2000)] + rng.integers(-20, 20, (2000, 4))
    books = vector_codes.Codebooks(centres[None].astype(np.int64) + 3, 6000)
    code, upper, lower, scans = vector_codes.assign(x, books, None)
    assert scans.sum() == 2000
    moved = vector_codes.Codebooks(books.entries + rng.integers(-30, 30, books.entries.shape), 6000)
    code2, upper2, lower2, scans2 = vector_codes.assign(x, moved, (books.entries, code, upper, lower))
    assert scans2.sum() < 100
    d = np.sqrt(((x[:, None] - moved.entries[0][None]) ** 2).sum(2))
    assert (code2[:, 0] == d.argmin(1)).all()
    own = d[np.arange(2000), code2[:, 0]]
    d[np.arange(2000), code2[:, 0]] = np.inf
    assert (upper2[:, 0].astype(float) >= own).all() and (lower2[:, 0].astype(float) <= d.min(1)).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(1, [0.1] * 16, 1), (2, [0.5] * 16, None), (2, [0.25] * 16, None), (2, [0.5] * 16, None), (None, [-0.1] * 16, 7)]
    odd = [(5, None, 1), (6, [None] * 16, 1), (7, [nan] * 16, 1), (8, [inf] * 16, 2), (9, [], 2), (10, [1.0] * 5, None)]
    df = spark.createDataFrame(fine + odd, SCHEMA).selectExpr("*", "'x' AS code", "1 AS x", "2 AS error", "3 AS v")
    got = vector_codes.compress(df).collect()
    assert len(got) == len(fine) + 2
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append((r.code, r.error))
    assert by[9] == by[10] == [(None, None)] and by[1] == [("00" * 16, 0)]
    assert sorted(by[2]) == [("01" * 16, 0), ("02" * 16, 0), ("02" * 16, 0)] and by[None] == [("04" * 16, 0)]
    assert vector_codes.compress(df.where("false")).collect() == []
    assert [r.code for r in vector_codes.compress(df.where("vec_id = 10")).collect()] == [None]
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 16, 1)], SCHEMA))


def test_codes_come_back_as_vectors(spark):
    df = spark.createDataFrame(vectors(64, 16, 100), SCHEMA)
    books, state, _ = vector_codes.train(df, 16, 64, 1)
    codes = vector_codes.encode(state, books).unionByName(spark.createDataFrame([(None, None, None, None)], "vec_id bigint, label int, code binary, error bigint"))
    got = {r.vec_id: r.embedding for r in vector_codes.decode(codes, books).collect()}
    assert got.pop(None) is None
    assert all(abs(x - y) <= 1 / 256 for r in df.collect() for x, y in zip(r.embedding, got[r.vec_id]))


# --- URLs


def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, slash, tail = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + tail
    best = None
    for verdict, own, start in url_filter.RULES:
        if (host == own or host.endswith("." + own)) and path.startswith(start) and (best is None or len(own + start) > len(best[1])):
            best = (verdict, own + start)
    return host, path, best


ODD_URLS = [
    None, "", "://", "x", "http://", "http://NET", "http://net/", "HTTP://A.Net/x?y/../", "http://internet/", "http://example.net/en/1", "http://a.example.net/en/", "http://example.net/en", "http://example.com/de/",
    "http://notexample.com/de/", "http://example.org/fr/#a", "http://org/fr/", "http://x.org?/fr/", "a://b://c.net/x", "http://é.net/ü", "http://😀.org/fr/😀", "http://example.com:80/de/", "http://u@example.com/de/x", "http://e.com#f/g", "http://" + "a" * 50000 + ".net/", "//no.scheme.net/",
]


def test_verdicts(spark):
    rows = [(i, u) for i, u in enumerate(ODD_URLS)] + [(None, "http://free-casino-bets.example.com/en/1"), (3, "http://x.net/")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'h' AS host", "'p' AS path", "'r' AS rule", "1 AS by")
    model = url_filter.train(url_filter.labelled(spark))
    got = url_filter.judge(df, model).collect()
    assert len(got) == len(rows)
    url = {i: u for i, u in enumerate(ODD_URLS)}
    for r in got:
        if r.page_id is None:
            assert r.rule is None and r.verdict == "block"
        elif r.host != "x.net":
            host, path, best = plain_verdict(url[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, best and best[1]), url[r.page_id]
            assert r.verdict == (best[0] if best else "block" if r.probability >= 0.5 else "allow")
    assert [r.verdict for r in got if r.page_id == 0] == ["allow"]
    kept = url_filter.keep(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.verdict == "allow" for r in got)
    assert url_filter.judge(df.where("false"), model).collect() == []


def plain_features(url):
    host, path, _ = plain_verdict(url)
    out = Counter()
    for text, seed in zip((host, path), url_filter.SEEDS):
        p = [ord(c) for c in f"^{text}$"] + [0]
        for i in range(max(len(text), 1)):
            out[(((p[i] * 8191 + p[i + 1]) * 8191 + p[i + 2]) * 31 + seed) % 1_000_003 % url_filter.BUCKETS] += 1
    length = math.sqrt(sum(v * v for v in out.values()))
    return {k: v / length for k, v in out.items()}


def test_regression_is_gradient_descent(spark):
    """Against the same descent on the weights themselves, and on URLs it hasn't seen."""
    w, bias = defaultdict(float), 0.0
    rows = [(plain_features(u), y) for u, y in url_filter.LABELLED]
    for _ in range(url_filter.STEPS):
        slopes = [1 / (1 + math.exp(-(bias + sum(w[k] * v for k, v in x.items())))) - y for x, y in rows]
        shrink = 1 - url_filter.RATE * url_filter.PENALTY
        w, bias = defaultdict(float, {k: v * shrink for k, v in w.items()}), bias * shrink
        for (x, _), s in zip(rows, slopes):
            bias -= url_filter.RATE * s / len(rows)
            for k, v in x.items():
                w[k] -= url_filter.RATE * s / len(rows) * v
    model = url_filter.train(url_filter.labelled(spark))
    assert abs(model.bias - bias) < 1e-9
    assert all(abs(model.weights[k] / url_filter.SCALE - v) < 1e-6 for k, v in w.items()) and sum(map(bool, model.weights)) <= len(w)
    bad = ["http://casino-win.example.com/en/5", "http://www.free-bets.example.com/es/6.html", "https://spam-farm.example.org/en/1", "http://cheap-pills.example.com/fr/9", "https://m.adult-x.example.com/en/2", "http://ads-track.example.com/es/3"]
    good = ["http://thornton.example.com/en/5", "http://www.nations.example.com/es/6.html", "https://bookshop.example.org/en/1", "http://teacher.example.com/fr/9", "https://m.painting.example.com/en/2", "http://river.example.com/es/3"]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(list(enumerate(bad + good)), "page_id bigint, url string"), model).collect()}
    assert [got[i] for i in range(12)] == ["block"] * 6 + ["allow"] * 6
    with pytest.raises(ValueError, match="labelled rows"):
        url_filter.train(url_filter.labelled(spark).where("false"))


def test_url_plan_reads_only_urls_and_moves_nothing(spark):
    model = url_filter.Model([0] * url_filter.BUCKETS, 0.0)
    plan = url_filter.judge(spark.read.parquet(f"{SF}/pages.parquet"), model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and "html" not in plan


# --- collocations


def plain_phrases(rows, longest=3, floor=10, top=2000, share=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= floor}
        outer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    outer[p[i : i + k]] = max(outer[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            if p in outer and 100 * outer[p] >= share * a:
                continue
            s, k = min((math.floor(Fraction(1000000 * a * a, count[p[:k]] * count[p[k:]])), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrases(df, **more):
    return sorted(tuple(r) for r in collocations.mine(df, **more).collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "'p' AS phrase", "2 AS f", "3 AS score").repartition(3)


ODD_TEXTS = [
    ("en", None), ("en", ""), (None, "New York " * 30), ("und", "new york. new\tyork; NEW YORK"), ("x", "a a a a a a a a a a a a a a"), ("x", "a,a a.a a"), ("é", "Éa Éa ß😀 ß😀 " * 20), ("y", "p q r\x0bp q r\x0cp q r\r" * 9), ("y", "p q. " * 30 + "q r " * 12), ("z", " \t .,;:!?\n" * 50),
]


@pytest.mark.parametrize("more", [{}, {"log2": 16, "floor": 3}, {"longest": 4, "floor": 2, "share": 80}, {"longest": 2, "top": 3}])
def test_phrases(spark, more):
    rng = random.Random(7)
    rows = ODD_TEXTS + [(rng.choice(["en", "de"]), " ".join(rng.choice("abcdefg") + rng.choice(["", "", ",", ".", "X"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    plain = {k: v for k, v in more.items() if k != "log2"}
    got = phrases(table(spark, rows), **more)
    assert got == plain_phrases(rows, **plain) and len(got) > 10


def test_long_texts_and_full_buckets(spark, monkeypatch):
    """Blocks much smaller than the texts, pieces longer than a block, and buckets that all reach the floor give the same."""
    rng = random.Random(8)
    rows = [("en", " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice([""] * 9 + ["."]) for _ in range(4000))), ("en", "long piece " * 500), ("de", "a b c. " * 300)]
    want = plain_phrases(rows)
    for block in (300, 1 << 20):
        monkeypatch.setattr(collocations, "BLOCK", block)
        assert phrases(table(spark, rows)) == want
    monkeypatch.setattr(collocations, "_set", lambda bits, slots: np.ones(len(slots), bool))
    assert phrases(table(spark, rows)) == want


def test_buckets_never_lose_a_phrase():
    rng = np.random.default_rng(2)
    slots = rng.integers(0, 1 << 20, 5000, dtype=np.uint64)
    ranges, low, counts = collocations._packed(slots)
    back = Counter()
    for r, a, b in zip(ranges.tolist(), low.to_pylist(), counts.to_pylist()):
        for s, c in zip(np.frombuffer(a, np.uint16).tolist(), b):
            back[(r << collocations.LOW) + s] += c
    assert back == Counter(slots.tolist())


def test_pruning_by_buckets_and_parts(spark):
    """Hardly anything that isn't frequent is counted exactly in the second pass."""
    rng = random.Random(9)
    rows = [("en", " ".join([f"w{rng.randint(0, 5000)}" for _ in range(300)] + ["often said"])) for _ in range(40)]
    df = table(spark, rows)
    log2 = 22
    one = collocations._pass(df, 1, log2, True, None, None).cache()
    words = one.where("phrase IS NOT NULL").groupBy("lang", "phrase").sum("f").where("`sum(f)` >= 10")
    second = collocations._pass(df, 2, log2, True, collocations._frequent_bits(words, log2, 10), collocations._bitmap(one, log2, 10))
    assert {r.phrase for r in second.where("phrase IS NOT NULL").collect()} == {"often said"}


def test_no_phrases(spark):
    assert phrases(table(spark, ODD_TEXTS).where("false")) == [] and phrases(table(spark, [("en", None), (None, "one two three")])) == []
