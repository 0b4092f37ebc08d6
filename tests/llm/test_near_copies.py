"""Near copies of the pipeline's stage: recall by similarity, large groups, and repeated ids."""

import random

import numpy as np

import corpus_pipeline
from sparkbrook.llm import bk_trees, near_copies


def test_copies_from_08_to_095_go_and_others_stay(spark):
    r = random.Random(4)
    rows, copies, others = [], set(), set()
    for k in range(240):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice((100, 200, 400)))]
        changed = list(words)
        for at in r.sample(range(len(words)), r.choice((1, 2, 4, 8))):
            changed[at] = f"x{r.randrange(10**6)}"
        texts = " ".join(words), " ".join(changed)
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(words) - 4)} for t in texts)
        s = len(a & b) / (len(a) * len(b)) ** 0.5
        rows += [(2 * k, texts[0]), (2 * k + 1, texts[1])]
        (copies if s >= 0.8 else others).add(2 * k + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {x.doc_id for x in corpus_pipeline.simhash_dedup(spark, df, "").collect()}
    assert len(copies) > 100 and len(others) > 20
    assert left >= {i for i, _ in rows} - copies and len(left & copies) <= 0.08 * len(copies)


def test_recall_by_similarity():
    r = np.random.default_rng(7)
    for least, wanted in ((2 / 3, 0.6), (0.75, 0.87), (0.8, 0.94), (0.9, 0.98)):  # Jaccard
        met = 0
        for _ in range(400):
            n = int(r.choice((20, 60, 300, 1_000)))
            same = int(np.ceil(2 * least / (1 + least) * n))
            a = r.integers(0, 2**64, n, dtype=np.uint64)
            b = np.concatenate((a[:same], r.integers(0, 2**64, n - same, dtype=np.uint64)))
            (x, k), (y, m) = near_copies.sketch(a), near_copies.sketch(b)
            met += bool({*near_copies.keys_of(k)} & {*near_copies.keys_of(m)}) and sum(((p ^ q) & 2**64 - 1).bit_count() for p, q in zip(x, y, strict=True)) <= near_copies.RADIUS
        assert met >= wanted * 400


def test_shard_keys_are_the_same_on_the_jvm(spark):
    r = np.random.default_rng(3)
    sure = [near_copies.sketch(r.integers(0, 2**64, n, dtype=np.uint64))[1] for n in (4, 9, 200)]
    df = spark.createDataFrame(sure, "s0 long, s1 long, s2 long, s3 long")
    assert sorted(list(x.k) for x in df.select(near_copies.shard_keys(df.columns).alias("k")).collect()) == sorted(map(near_copies.keys_of, sure))
    assert len(set(near_copies.keys_of(sure[0]))) == 60


def test_one_large_group_in_many_blocks(spark):
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(k, " ".join([*base[: k % 190], f"x{k}", *base[k % 190 + 1 :]])) for k in range(300)] + [(1000 + k, " ".join(f"y{r.randrange(10**6)}" for _ in range(50))) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {x.doc_id for x in near_copies.deduplicated(df, block=48).collect()}
    assert left == {0, *range(1000, 1050)}


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(2, "a b c d e f", 1, 5, "x"), (1, "a b c d e f", 2, 6, "y"), (3, None, None, None, None)], "doc_id long, text string, node long, `a.b` long, keys string")
    out = near_copies.deduplicated(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_one_id_with_unlike_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (3, b), (None, a), (4, None), (5, "")], "doc_id long, text string")
    left = sorted(((x.doc_id or 0, x.text) for x in near_copies.deduplicated(df).collect()), key=str)
    assert left == sorted([(1, a), (2, b), (0, a), (4, None)], key=str)
    assert near_copies.deduplicated(df.limit(0)).count() == 0


def test_every_pair_at_the_similarity_is_linked(spark):
    """Pairs at just 0.8 (brute force), chains of them, and a frequent passage: no link is lost."""
    r, rows = random.Random(12), []
    passage = [f"p{i}" for i in range(30)]
    for k in range(150):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice((10, 60, 150)))] + (passage if k % 5 == 0 else [])
        for _ in range(3):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for at in r.sample(range(len(words)), max(1, len(words) // 28)):
                words[at] = f"x{r.randrange(10**6)}"
    sets = [near_copies.shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    bare = 0
    for i in range(len(rows)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if n * n * 100 >= 64 * len(sets[i]) * len(sets[j]):
                bare += n * n * 100 < 72 * len(sets[i]) * len(sets[j])
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {x.doc_id for x in near_copies.deduplicated(df).collect()}
    assert bare > 50 and left == {root(i) for i in range(len(rows))}


def test_prefixes_of_sets_at_the_similarity_meet():
    r = np.random.default_rng(5)
    for _ in range(2_000):
        n, m = (int(x) for x in r.integers(2, 60, 2))
        same = int(np.ceil(0.8 * (n * m) ** 0.5 - 1e-9))
        if same > min(n, m):
            continue
        pool = r.integers(0, 2**64, n + m, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate((pool[:same], pool[n : n + m - same])))
        frequent = np.unique(r.choice(pool, 8))
        assert np.intersect1d(near_copies.prefix(a, frequent, 80), near_copies.prefix(b, frequent, 80)).size


def test_pairs_of_long_lists_are_made_in_blocks(spark):
    """Every pair of two groups that may be near, once over all parts of its lists; the many pairs that can't be don't become rows."""
    r = np.random.default_rng(6)
    passage = r.integers(0, 2**64, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate((passage, r.integers(0, 2**64, 300, dtype=np.uint64)))) for _ in range(60)]
    sets += [np.unique(np.concatenate((s[:300], r.integers(0, 2**64, 30, dtype=np.uint64)))) for s in sets[:20]]  # each near one of the first
    component = {i: 40 for i in range(41, 60)}
    lists = spark.createDataFrame([(t, i, 1 if t < 3 else 20) for t in range(90) for i in range(80) if t < 3 or i in (t % 20, t % 20 + 60)], "list long, node long, weight long")
    sizes = spark.createDataFrame([(i, len(s), bytearray(near_copies.parities(s))) for i, s in enumerate(sets)], "node long, size long, bits binary")
    near = spark.createDataFrame(list(component.items()), "node long, component long")
    for block in (7, 1_000):
        made = near_copies.open_pairs(lists, sizes, near, 80, block)
        assert sorted((x.a, x.b) for x in made.collect()) == [(i + 60, i) for i in range(20)]


def test_parities_refuse_no_pair_at_the_similarity():
    r = np.random.default_rng(9)
    refused = 0
    for _ in range(1_500):
        n, m = (int(x) for x in r.integers(2, r.choice((60, 700, 9_000)), 2))
        same = int(r.integers(0, min(n, m) + 1))
        pool = r.integers(0, 2**64, n + m - same, dtype=np.uint64)
        a, b = pool[:n], np.concatenate((pool[:same], pool[n:]))
        left = len(near_copies.may_be_near((np.array([0]), np.array([1])), np.array([n, m]), [near_copies.parities(a), near_copies.parities(b)], 80))
        assert left or same * same * 100 < 64 * n * m
        refused += not left
    assert refused > 700


def test_components_alone_and_by_rounds(spark):
    r = random.Random(2)
    edges = [(max(a, b), min(a, b)) for a, b in ((r.randrange(600), r.randrange(600)) for _ in range(400)) if a != b] + [(k + 1, k) for k in range(700, 760)]
    df = spark.createDataFrame(edges, "a long, b long")
    alone, rounds = (sorted(map(tuple, bk_trees.components(df, n).select("node", "component").collect())) for n in (1_000, 0))
    assert alone == rounds and len(alone) > 300 and (760, 700) in alone
    assert bk_trees.components(df.limit(0)).count() == 0
