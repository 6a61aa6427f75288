"""The n-gram join and the vector forest against all pairs, and the pipeline on a small table."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import forest, ngram_join
from threadloom.llm.common import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_components(spark):
    random.seed(1)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)]
    want = roots({n for e in edges for n in e if e[0] != e[1]}, edges)
    got = {r.node: r.group for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_is_that_of_all_pairs(spark):
    random.seed(7)
    vocabulary = [f"v{i}" for i in range(400)] + ["É", "é"]
    passage = random.choices(vocabulary, k=60)
    texts = ["", None, " \t", "one two", "One  TWO", "one two three", "É a b c d", "é a b c d"]
    for _ in range(25):
        base = random.choices(vocabulary, k=random.randint(3, 150)) + (passage if random.random() < 0.5 else [])
        texts.append(" ".join(base))
        for _ in range(random.randint(0, 5)):
            copy = list(base)
            for _ in range(random.randint(0, 6)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append("\n".join(copy).upper() if random.random() < 0.2 else " ".join(copy))
    chain = random.choices(vocabulary, k=120)
    for i in range(8):
        texts.append(" ".join(chain[i * 5 : i * 5 + 70]))
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.mark_groups(df).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(rows) - 20


def test_near_copies_that_do_not_link(spark, monkeypatch):
    """Copies of one text with so many changes that most do not link, some of them linked by changes they share: all links are found, and
    few of the pairs are compared."""
    random.seed(11)
    base = [f"v{random.randint(0, 3000)}" for _ in range(140)]
    edits = [[(random.randrange(140), f"x{random.randint(0, 9**9)}") for _ in range(random.randint(2, 6))] for _ in range(25)]
    texts = [" ".join(base)]
    for _ in range(220):
        copy = list(base)
        for i, word in random.choice(edits) if random.random() < 0.4 else []:
            copy[i] = word
        for _ in range(random.randint(0, 9)):
            copy[random.randrange(140)] = f"y{random.randint(0, 9**9)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    compared, verified = [], ngram_join._verified

    def counted(documents, found, pairs, **more):
        compared.append(pairs.count())
        return verified(documents, found, pairs, **more)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.mark_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert 20 < len(set(want.values())) < 180
    assert compared[0] <= ngram_join.PIVOTS * len(rows) and sum(compared) < 600, compared


def test_what_the_join_sends_is_small(spark):
    """Sets take less than 5.4 bytes a token, counts as many bytes as the largest needs, and no row is repeated for the blocks of its list."""
    rng = np.random.default_rng(3)
    for n in (1, 5, 800, 70_000):
        tokens = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (ngram_join._unpacked(ngram_join._packed(tokens)) == tokens >> np.uint64(16)).all()
    assert len(ngram_join._packed(tokens[::90].copy())) < 5.4 * len(tokens[::90])
    for most, width in ((255, 1), (256, 2), (1 << 16, 4), (1 << 32, 8)):
        part = np.arange(ngram_join.SLICE) % 200
        part[7] = most
        raw = ngram_join._narrow(part)
        assert len(raw) == width * ngram_join.SLICE and (ngram_join._wide(raw) == part).all()
    # Sizes whose blocks are 17 (two sets), 18 and 20: the pivot of a block is met from the block itself and from the ones beside it.
    lists = spark.createDataFrame([(t, k, s, t) for t in (1, 2, 3) for k, s in ((11, 45), (12, 46), (13, 60), (14, 90))], "token long, key long, size long, place long")
    pairs = ngram_join._pivot_pairs(lists)
    plan = pairs._jdf.queryExecution().toString()
    assert "Generate" not in plan
    assert sorted(map(tuple, pairs.collect())) == [(12, 11), (12, 13), (13, 11), (13, 12)]


def test_empty_join(spark):
    assert ngram_join.mark_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_vector_links(spark):
    random = np.random.default_rng(5)
    rows, at = [], 0
    for label in (1, 2):
        for _ in range(40):
            centre = random.normal(size=16)
            for _ in range(int(random.integers(1, 7))):
                rows.append((at, (centre + random.normal(size=16) * 0.1).astype(np.float32).tolist(), label))
                at += 1
    rows += [(at + i, rows[0][1], 1) for i in range(3)] + [(at + 3, rows[0][1], 2), (at + 4, rows[0][1], None)]
    rows += [(at + 5, None, 1), (at + 6, [0.0] * 16, 1), (at + 7, [float("nan")] * 16, 1), (at + 8, [float("inf")] + [0.0] * 15, 1), (at + 9, [], 1), (at + 10, [1.0, 2.0], 1)]
    usable = [r for r in rows if r[1] and r[2] is not None and np.isfinite(r[1]).all() and any(r[1])]
    links = []
    for a, b in combinations(usable, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1], dtype=np.float64), np.array(b[1], dtype=np.float64)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((a[0], b[0]))
    want = roots([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    got = {r.vec_id: r for r in forest.link_vectors(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in want)
    assert all(got[i].n_links == sum(i in link for link in links) for i in want)
    assert len(links) > 60


def test_recall_with_real_trees():
    """Trees deep enough to part vectors, against all pairs."""
    random = np.random.default_rng(9)
    centres = random.normal(size=(900, 32))
    vectors = np.concatenate([centres, centres + random.normal(size=centres.shape) * 0.15])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    near = {(i, j) for i, j in zip(*np.nonzero(np.triu(vectors @ vectors.T >= 0.98, 1)), strict=True)}
    shared = set()
    for seed in range(forest.TREES):
        tree = forest.grow(vectors, 40, np.random.default_rng(seed), [0])
        leaves = forest.leaves_of(vectors, tree)
        shared |= {(i, j) for i, j in near if set(leaves[i]) & set(leaves[j])}
        assert max(map(len, leaves)) >= 1
    assert len(near) > 200 and len(shared) / len(near) >= 0.9


def test_large_clique_is_linked_in_full(spark):
    """A clique of distinct near copies of many leaves' size, among others, and rows in few dimensions, which are cut."""
    random = np.random.default_rng(4)
    clique = random.normal(size=64) + random.normal(size=(2500, 64)) * 0.1
    flat = random.normal(size=(1500, 2)) @ random.normal(size=(2, 64))
    rows = [(v, 1) for v in np.concatenate([clique, random.normal(size=(1500, 64))])] + [(v, 2) for v in flat]
    rows = [(i, v.astype("f4").tolist(), label) for i, (v, label) in enumerate(rows)]
    got = {r.vec_id: r for r in forest.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    for label in (1, 2):
        ids = np.array([i for i, _, k in rows if k == label])
        vectors = np.array([v for _, v, k in rows if k == label], dtype="f4").astype(float)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        near = vectors @ vectors.T >= forest.COSINE
        assert [got[i].n_links for i in ids.tolist()] == (near.sum(axis=1) - 1).tolist()
        assert near.sum() > 10 * len(ids)
    tree = forest.grow(vectors, 100, random, [0])
    leaves = [set(x) for x in forest.leaves_of(vectors, tree)]
    assert tree.leaf < 0 and all(leaves[i] & leaves[j] for i, j in zip(*np.nonzero(near), strict=True))


def test_pair_counted_once():
    a, b = forest.padded([[1, 5], [2, 7], [3]], -1), forest.padded([[5, 9], [2, 7], [4]], -2)
    assert forest.counted_here(a, b, 5).tolist()[0] is True
    assert forest.counted_here(a, b, 7).tolist()[1] is False


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_pipeline(spark, sf):
    import corpus_pipeline

    sf_dir = f"/root/testdata/{sf}"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.run(spark, sf_dir)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 0 < len(ids) < documents.count() and len(corpus_pipeline.STAGES) == 5
    texts = {r.doc_id: r.text for r in documents.collect()}
    sets = {i: shingles(texts[i]) for i in ids}
    assert not any(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in combinations(sets, 2))
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(item in texts[i] for i in ids for item in items)


def test_pipeline_rows_without_or_with_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    random.seed(2)
    a, b, c, item = (" ".join(random.choices([f"{k}{i}" for i in range(300)], k=60)) for k in "abci")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    decided = lambda stage, rows: sorted(map(tuple, stage(spark, frame(rows), str(tmp_path)).collect()), key=str)
    rows = [(None, item, "en", "x"), (None, a, "en", "x"), (1, item, "en", "x"), (1, b, "en", "x"), (2, c, "en", "x")]
    assert decided(corpus_pipeline.drop_contaminated, rows) == sorted([rows[1], rows[3], rows[4]], key=str)
    # A row without words and a group without ids put null among the kept ids before; id 5 stands for c and repeats b.
    rows = [(None, "", "en", "x"), (None, a, "en", "x"), (None, a + " more", "en", "x"), (None, b, "en", "x"), (3, b, "en", "x"), (5, c, "en", "x"), (5, b + " more", "en", "x")]
    rows += [(7, c + " more", "en", "x"), (5, c, "en", "x")]
    got = decided(corpus_pipeline.keep_one_of_each_group, rows)
    assert sum(t in (a, a + " more") for _, t, _, _ in got) == 1
    assert [r for r in got if r[1] not in (a, a + " more")] == sorted([rows[0], rows[4], rows[5], rows[8]], key=str)


def test_pipeline_stage_called_alone_sends_small_batches(spark):
    import corpus_pipeline

    rows, size = corpus_pipeline.BATCHES
    before = {name: spark.conf.get(name, None) for name in corpus_pipeline.BATCHES}
    count = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    longest = lambda: max(r.n for r in spark.range(0, 4000, 1, 1).mapInArrow(count, "n long").collect())
    docs = spark.createDataFrame([(1, "some words", "en", "x")], "doc_id long, text string, lang string, source string")
    try:
        for own, expected in ((None, 1000), ("3000", 3000)):
            spark.conf.unset(size)
            spark.conf.unset(rows) if own is None else spark.conf.set(rows, own)
            corpus_pipeline.encode(spark, docs, "")
            assert longest() == expected
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
