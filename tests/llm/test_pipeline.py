"""The corpus pipeline stage by stage."""

import random

import corpus_pipeline
from plumbline.llm import quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_pack_all_that_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    judged = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns and 0 < docs.count() <= n
        if k == 0:
            assert {r["doc_id"] for r in docs.collect()} == judged
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}


def test_stages_take_awkward_and_no_rows(spark, awkward):
    for docs in (awkward, awkward.filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.columns[:2] == ["doc_id", "piece"]


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_groups(texts):
    """Smallest id of each text's group over all pairs of five-word Jaccard 0.8 or more."""
    sets, up = {k: shingle_set(t) for k, t in texts.items()}, {k: k for k in texts}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in ids}


def grouped(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.similar(df).collect()}


def test_edited_copies_of_every_kind_are_found(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    texts, pairs = {}, {}
    for k in range(60):
        w = [word() for _ in range(rng.randrange(80, 900))]
        texts[10 * k] = " ".join(w)
        cut = rng.uniform(0.03, 0.195)
        texts[10 * k + 1] = " ".join(w[: len(w) - int(cut * len(w))])
        texts[10 * k + 2] = " ".join(w + [word() for _ in range(int(len(w) * cut / (1 - cut)))])
        scattered = list(w)
        for at in rng.sample(range(len(w)), len(w) // 60):
            scattered[at] = word()
        texts[10 * k + 3] = " ".join(scattered)
    want, got = brute_groups(texts), grouped(spark, texts)
    assert got == want
    assert all(want[10 * k + j] == 10 * k for k in range(60) for j in (1, 2))


def test_chains_of_versions_in_large_groups_stay_whole(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [word() for _ in range(12)]
    texts = {}
    for g in range(3):
        versions = [[word() for _ in range(150)]]
        while len(versions) < 80:
            w = list(rng.choice(versions[-12:]))
            for at in rng.sample(range(len(w)), 2):
                w[at] = word()
            versions.append(w)
        texts |= {1000 * g + k: " ".join(w) for k, w in enumerate(versions)}
    texts |= {5000 + k: " ".join(common + [word() for _ in range(30)]) for k in range(80)}
    want = brute_groups(texts)
    assert len(set(want.values())) == 3 + 80
    assert grouped(spark, texts) == want
