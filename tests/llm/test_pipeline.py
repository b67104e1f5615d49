"""The pipeline: each stage on what the one before it kept."""

import corpus_pipeline as P
from strata.llm import quality_crf

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, sizes = docs.columns, {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
            assert set(after) <= set(before)
            if name != "personal_data":
                assert all(before[k] == t for k, t in after.items())
            else:
                assert set(after) == set(before)
            before = after
        sizes[name] = docs.count()
    assert sizes["quality"] > sizes["near_duplicates"] > sizes["decontamination"] == sizes["personal_data"] > 0
    assert {r.doc_id for r in docs.collect()} == set(before)


def test_quality_stage_follows_the_classifier(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = quality_crf.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality_crf.score(docs, field).where("predicted = 1").collect()}
    assert {r.doc_id for r in P.quality(spark, docs, SF).collect()} == want


def test_run_gives_all_pieces(spark):
    got = P.run(spark, SF)
    assert {"doc_id", "start", "length", "ids"} <= set(got.columns) and got.count() > 0


def test_near_duplicates_are_those_of_similarity(spark):
    """Against all pairs of sets: copies with a few words changed, chains, and the texts of the table."""
    import random

    rng = random.Random(5)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()}
    for g in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for k in range(5):
            texts[10_000 + 10 * g + k] = " ".join(words)
            words[rng.randrange(120)] = f"x{g}{k}"
            words = words[: rng.choice([120, 116, 112])] + [f"y{rng.randrange(10**6)}" for _ in range(120 - len(words))]
            words += [f"z{i}{g}{k}" for i in range(120 - len(words))]
    texts |= {20_001: "", 20_002: " ", 20_003: "One two", 20_004: "one TWO"}
    sets = {}
    for k, t in texts.items():
        w = t.lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {k: k for k in texts}
    alike = [(a, b) for a in texts for b in texts if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0)]
    for _ in texts:
        for a, b in alike:
            least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id for r in P.near_duplicates(spark, docs, SF).collect()} == set(least.values())


def test_bucket_links_connect_what_is_similar():
    import numpy as np
    from strata.llm import near_copies

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(100)[: rng.integers(60, 100)]], rng.integers(0, 1 << 63, rng.integers(0, 15), dtype=np.uint64)])) for _ in range(80)]
    group = list(range(80))
    exact = list(range(80))
    similar = lambda a, b: 10 * (n := len(np.intersect1d(a, b))) >= 8 * (len(a) + len(b) - n)
    pairs = [(i, j) for i in range(80) for j in range(i) if similar(sets[i], sets[j])]
    found = near_copies.bucket_links(sets)
    assert all(similar(sets[i], sets[j]) for i, j in found)
    for least, links in ((group, found), (exact, pairs)):
        for _ in range(80):
            for i, j in links:
                least[i] = least[j] = min(least[i], least[j])
    assert group == exact and 1 < len(set(exact)) < 80
