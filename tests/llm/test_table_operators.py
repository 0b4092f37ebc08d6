"""Operators 2, 3, 6 and 7 and the pipeline."""

import random
import re

import numpy as np
import pytest
import xxhash
from compare import SF, check, connect
from pyspark.sql import functions as F

import corpus_pipeline
from sparkbrook.llm import bk_trees, fixity, mixing, near_copies, quality, queries, secrets, simhash, subwords, url_filter
from sparkbrook.llm.common import read


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert check(spark, connect(), queries.queries()[name], queries.oracle_sql()[name]) > 0


# 2


def test_warc_files_parse(spark, tmp_path):
    pages = read(spark, SF, "pages")
    recs = [r.record.encode() for r in fixity.records(pages).orderBy("id").collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(recs))
    got = fixity.read_warc(spark.read.format("binaryFile").load(f"file://{tmp_path}/a.warc").select("path", "content")).collect()
    assert [bytes(r.record) for r in got] == recs
    m = {r.offset: r.length for r in fixity.manifest(fixity.records(pages)).collect() if r.file == 0}
    assert m == {r.offset: r.length for r in got}
    assert fixity.parse_warc(b"WARC/1.0\r\n") == [(0, 10, b"WARC/1.0\r\n")] and fixity.parse_warc(b"") == []


def damaged_files(tmp_path, spark):
    recs = [r.record.encode() for r in fixity.records(read(spark, SF, "pages")).orderBy("id").limit(30).collect()]
    ours = {f"f{k}.warc": recs[10 * k : 10 * k + 10] for k in range(3)}
    theirs = {name: list(x) for name, x in ours.items()}
    theirs["f0.warc"][3] = b"JUNK" + theirs["f0.warc"][3][4:]  # a damaged header, the length as before
    theirs["f1.warc"][5] = theirs["f1.warc"][5].replace(b"Content-Length", b"Content-Lenght")
    theirs["f2.warc"].insert(4, b"stray bytes\r\n\r\n")
    frames = []
    for side, files in (("a", ours), ("b", theirs)):
        (tmp_path / side).mkdir()
        for name, x in files.items():
            (tmp_path / side / name).write_bytes(b"".join(x))
        frames.append(spark.read.format("binaryFile").load(f"file://{tmp_path}/{side}").select(F.element_at(F.split("path", "/"), -1).alias("path"), "content"))
    return ours, theirs, frames


def test_files_with_damage_are_audited_by_offset(spark, tmp_path):
    ours, theirs, frames = damaged_files(tmp_path, spark)
    got = sorted((r.path, r.offset, r.status) for r in fixity.audit_files(*frames).collect())
    expected = []
    for name, x in ours.items():
        starts = lambda y: [(sum(map(len, y[:k])), y[k]) for k in range(len(y))]
        a, b = starts(x), starts(theirs[name])
        for k in range(max(len(a), len(b))):
            if k >= len(a):
                expected.append((name, b[k][0], "extra"))
            else:
                expected.append((name, a[k][0], "changed" if a[k][1] != b[k][1] else "moved" if a[k][0] != b[k][0] else "ok"))
    assert got == sorted(expected) and {s for _, _, s in got} == {"ok", "changed", "extra"}


def test_shifted_records_are_faults(spark):
    ours = {i: f"r{i}" for i in range(600)}
    theirs = dict(ours) | {4: "longer"}
    del theirs[590]
    a, b = (spark.createDataFrame([(i, t, 1, 2) for i, t in x.items()], "id long, record string, file long, slot long") for x in (ours, theirs))
    got = {x.id: x.status for x in fixity.audit(a, b).collect()}
    assert got == {i: "changed" if i == 4 else "missing" if i == 590 else "moved" if 4 < i < 512 or i > 590 else "ok" for i in ours}


@pytest.mark.parametrize("seed", range(2))
def test_audit_against_comparing_all(spark, seed):
    r = random.Random(seed)
    ours = {i: f"r{i}" * r.randint(1, 5) for i in r.sample(range(-3000, 9000), 150)}
    theirs = {i: t + "x" * (r.random() < 0.1) for i, t in ours.items() if r.random() > 0.1} | {20000: "new"}
    a, b = (spark.createDataFrame(list(x.items()), "id long, record string") for x in (ours, theirs))
    got = {x.id: x.status for x in fixity.audit(a, b).collect()}
    expected = {i: "missing" if i not in theirs else "extra" if i not in ours else "ok" if ours[i] == theirs[i] else "changed" for i in ours | theirs}
    starts = {}
    for name, side in (("a", ours), ("b", theirs)):
        at = {}
        for i in sorted(side):
            starts[name, i] = at.get(i // 512, 0)
            at[i // 512] = starts[name, i] + len(side[i])
    expected |= {i: "moved" for i, s in expected.items() if s == "ok" and starts["a", i] != starts["b", i]}
    assert got == expected


def test_audit_edges(spark):
    empty = spark.createDataFrame([], "id long, record string")
    one = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "id long, record string")
    assert fixity.audit(empty, empty).count() == 0
    assert sorted(r.status for r in fixity.audit(one, one).collect()) == ["ok"] * 3
    assert [r.status for r in fixity.audit(empty, one).collect()] == ["extra"] * 3
    pages = spark.createDataFrame([(None, "u", "h"), (1, None, None)], "page_id long, url string, html string")
    assert fixity.records(pages).count() == 1
    many = spark.createDataFrame([(1, f"a{k}") for k in range(500)] + [(2**63 - 1, "z"), (-(2**63), "y")], "id long, record string")
    assert {r.status for r in fixity.audit(many, many).collect()} == {"ok"}
    assert {(r.id, r.status) for r in fixity.audit(many, many.where("record <> 'a7'")).collect()} == {(1, "changed"), (2**63 - 1, "ok"), (-(2**63), "ok")}
    top = spark.createDataFrame([(2**63 - 1, "u", "h"), (100, "u", "h")], "page_id long, url string, html string")
    assert fixity.planted_replica(top).count() >= 2


# 3


def fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by rounds: the excess over caps is shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        goal = {s: cap * sizes[s] if s in capped else rest * w[s] / free for s in names}
        over = {s for s in names if s not in capped and goal[s] > cap * sizes[s]}
        if not over:
            return goal
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_against_rounds(spark, seed):
    r = random.Random(seed)
    sizes = {**{f"s{i}": int(r.lognormvariate(5, 2)) for i in range(17)}, None: 40, "": 7}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {x.source: pytest.approx(x.target) for x in got.collect()} == fill(sizes)


def test_mixture_is_near_its_targets(spark):
    got = queries.op3_source_mix(spark, "/root/testdata/sf0.1").withColumn("doc", F.col("doc_id")).join(read(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "source"), "doc_id")
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect()
    assert all(abs(x.taken - x.target) <= x.largest for x in sums)
    assert got.where("taken > 2 * size").count() == 0


def test_mix_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (None, "d e", None), (3, "", None), (4, "f " * 40, "y"), (5, "g", "y"), (5, "h", "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size long")
    a = mixing.mixture(df).collect()
    assert len(a) == len(rows) and sorted(map(str, a)) == sorted(map(str, mixing.mixture(df.repartition(3)).collect()))
    assert mixing.mix(df).columns == df.columns and mixing.mix(df).count() == sum(r.copies for r in a)
    assert mixing.mixture(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    assert mixing.mixture(spark.createDataFrame([(1, None, "x")], "doc_id long, text string, source string")).first().taken == 0


# 6


def brute_fingerprint(text, k=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: id -> fingerprint."""
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def test_simhash_query(spark):
    docs = {r.doc_id: r.text for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    parts = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash_neardup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (f"{fps[i]:016x}", parts[i]) for i in docs}


def test_fingerprint_is_the_hash_of_spark(spark):
    s = "née wörld x"
    assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] % 2**64 == simhash.fingerprint("Née WöRLD X")
    assert simhash.fingerprint("İ A") == brute_fingerprint("İ A") and simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("seed", range(3))
def test_links_of_clusters_balls_and_chains(spark, seed):
    r = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    fps = [0, 1, 7, 15]
    for _ in range(15):
        c = r.getrandbits(64)
        fps += [flip(c, r.randint(0, 4)) for _ in range(r.randint(1, 25))]
    ball = r.getrandbits(64)
    fps += [flip(ball, r.randint(1, 3)) for _ in range(150)]
    chain = r.getrandbits(64)
    for _ in range(40):
        fps.append(chain := flip(chain, 3))
    fps = dict(enumerate(dict.fromkeys(fps)))
    want = {i: c for i, c in brute_components(fps).items() if c != i}
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()], "node long, w0 long")
    # a block of 40 cuts the ball's shards into many; minimum forests in blocks: test_one_large_group_in_many_blocks
    for blocks, block, least in (((5, 2048, True),), ((4, 2048, False),), ((5, 40, False),))[seed]:
        nodes = df.select("node", simhash.block_keys("w0", 3, blocks).alias("keys"), "w0")
        found = bk_trees.components(bk_trees.links(nodes, 3, least=least, block=block)).collect()
        assert {x.node: x.component for x in found} == want
    points, at = np.array(list(fps.values()), np.uint64)[:, None], np.arange(len(fps))
    a, b = bk_trees.block_edges(at, points, at >= 0, 3, False)
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == want
    # a tree yields every linked pair once, and a minimum forest is as light as Kruskal's
    pairs = sorted((d, *sorted((i, int(j)))) for i, near, dist in bk_trees.grow_and_search(points, at, at[:0], 3, None) for j, d in zip(near, dist.tolist(), strict=True))
    plain = sorted((int(points[i, 0] ^ points[j, 0]).bit_count(), i, j) for j in at.tolist() for i in range(j) if int(points[i, 0] ^ points[j, 0]).bit_count() <= 3)
    assert pairs == plain
    up, weight = list(at.tolist()), 0
    for d, i, j in plain:
        while up[i] != i:
            i = up[i]
        while up[j] != j:
            j = up[j]
        if i != j:
            up[max(i, j)] = min(i, j)
            weight += d
    ds, xs, ys = (np.array(x) for x in zip(*pairs, strict=True))
    assert ds[bk_trees.least_forest(xs, ys, ds, len(at))].sum() == weight


def test_queries_pass_through_a_tree_in_pieces(spark):
    r = np.random.default_rng(1)
    centre = np.uint64(0x0123456789ABCDEF)
    tree = [(0, 0, 0, i, int(centre ^ np.uint64(1 << i % 20))) for i in range(40)]
    asking = [(0, 0, 1, 100 + i, int(centre ^ np.uint64(1 << 20 | 1 << 21)) if i % 2 else int(r.integers(0, 2**62))) for i in range(9_000)]
    df = spark.createDataFrame(tree + asking, "key long, block long, query int, node long, w0 long").repartition(7)
    found = bk_trees.components(bk_trees.searched(df, 3, False)).collect()
    assert {x.node for x in found if x.component == 0} == {*range(1, 40), *(100 + i for i in range(1, 9_000, 2))}


def test_simhash_edges(spark):
    rows = [(5, "one two three four five"), (3, "ONE two three four five"), (5, "one two three four five"), (7, None), (8, ""), (None, "x y"), (None, "one two three four five")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp long")
    got = sorted(((r.id is None, r.id or 0, r.component) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(False, 5, 3), (False, 5, 3), (False, 3, 3), (False, 7, 7), (False, 8, 7), (True, 0, None), (True, 0, 3)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# 7


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.NET/en/1?x", "https://net/", "http://x.net", "ftp://example.net/en/", "http://badnet/", "http://w.org/fr/2#a?b", "http://example.com/de/", "nothing", None, "a://b://c/d", "http://É.org/fr/", "http://h.example.com/de"]
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).orderBy("page_id").collect()]
    assert got == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("net", "/", "net/", "block"), ("x.net", "", None, "allow"), ("example.net", "/en/", "example.net/en/", "allow"), ("badnet", "/", None, "allow"),
        ("w.org", "/fr/2", "org/fr/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("É.org", "/fr/", "org/fr/", "allow"), ("h.example.com", "/de", None, "allow")]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_templates_learn_from_labelled_siblings(spark):
    urls = [f"http://h.com/bad/w{chr(97 + i % 26)}{chr(97 + i // 26)}/x" for i in range(60)] + [f"http://h.com/good/{i}" for i in range(30)]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    rules = [("block", f"h.com/bad/w{c}") for c in "abcdefghijklmnopqrstuvw"]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df, rules=rules).collect()}
    assert all(got[i] == "block" for i in range(60)) and all(got[i] == "allow" for i in range(60, 90))


def test_url_templates_learn_from_content(spark):
    """Spam pages make their template rejected, also for its pages without content; a few among many don't. Repeated and null ids, and long urls, count."""
    rows = [(1, f"http://s.com/buy/{i}", "<p>Cheap PILLS</p>" if i < 8 else None) for i in range(10)] + [(None, f"http://s.com/about/{i}", "about us") for i in range(10)]
    rows += [(i, f"http://g.com/x/{i}", "casino" if i < 4 else "bluebells, casinos") for i in range(30)] + [(99, "http://g.com/" + "a/" * 50_000, "x" * 500_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.host, r.path[:6], r.verdict) for r in url_filter.judge_urls(df).collect()]
    assert sorted(set(got)) == [("g.com", "/a/a/a", "allow"), ("g.com", "/x/0", "allow"), *[("g.com", f"/x/{i}", "allow") for i in sorted(map(str, range(1, 30)))], *[("s.com", "/about", "allow")], *[("s.com", f"/buy/{i}", "block") for i in range(10)]]
    assert len(got) == len(rows)


def test_url_method_decides_on_the_table(spark):
    """Verdicts beyond the rules, on the table."""
    r = queries.op7_url_filter(spark, "/root/testdata/sf0.1").where("rule is null").groupBy("verdict").count().collect()
    n = {x.verdict: x["count"] for x in r}
    assert n["block"] >= 40 and n["allow"] > 20 * n["block"] * 0.5


# The pipeline


def brute_groups(texts):
    """id -> text: the smallest id of each group by the similarity (cosine) of their sets of five-word shingles, 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    ids, up = sorted(sets), {i: i for i in sets}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both * both * 25 >= 16 * len(sets[i]) * len(sets[j]):
                a, b = i, j
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)
    for i in ids:
        up[i] = up[up[i]]
    return up


def test_near_copies_on_the_table(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    parts = brute_groups({r.doc_id: r.text for r in docs.collect()})
    left = {r.doc_id for r in near_copies.deduplicated(docs).collect()}
    plain = {i for i, c in parts.items() if i == c}
    assert left >= plain and len(left - plain) <= 0.08 * (len(parts) - len(plain))


def test_pipeline_against_a_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in read(spark, folder, "documents").collect()}
    judged = {r.doc_id for r in queries.op8_quality_forest(spark, folder).where("kept").collect()}
    frame = read(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    a = stages["quality_rules"](spark, frame, folder)
    assert {r.doc_id for r in a.collect()} == judged
    parts = brute_groups({i: docs[i].text for i in judged})
    b = stages["simhash_dedup"](spark, a, folder)
    left = {i for i, c in parts.items() if i == c}
    assert {r.doc_id for r in b.collect()} == left
    c = stages["secret_scan"](spark, b, folder)
    assert {r.doc_id: r.text for r in c.collect()} == {i: secrets.redact_text(docs[i].text) for i in left}
    assert not any(k != "entropy" for r in c.collect() for k, _, _ in secrets.scan_text(r.text))
    d = stages["source_mix"](spark, c, folder)
    assert a.columns == b.columns == c.columns == d.columns == frame.columns
    copies = {r.doc_id: r.copies for r in mixing.mixture(c).collect()}
    assert {r.doc_id: r.n for r in d.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {i: n for i, n in copies.items() if n}
    out = corpus_pipeline.run(spark, folder).collect()
    texts = {r.doc_id: r.text for r in d.collect()}
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in d.collect())
    pieces = subwords.Pieces(queries.tokenizer_file("piece_bpe_32k.model"))
    for r in out:
        assert r.n_tokens == len(r.ids) and pieces.decode(np.array(r.ids, "<u4").tobytes()) == texts[r.doc_id]
    assert len({(r.doc_id, tuple(r.ids)) for r in out}) == len(out)  # a document that was taken twice is split anew


def test_pipeline_stages_at_the_edges(spark):
    folder = "/root/testdata/sf0.001"
    long = " ".join(f"word{k % 5000} and{k}" for k in range(150_000))
    key = "A8d9Kq27LmZx04TbVcYwR5uEs1HjP6n"
    prose = " ".join(f"some{k} words" for k in range(60))
    rows = [
        (1, prose, "en", "web", 5, "x", 1), (1, prose, "en", "web", 5, "x", 1), (2, prose, None, None, None, None, None), (3, long, "en", "web", len(long), "y", 2), (None, f"{prose} {key}", "en", None, 3, None, 3),
        (None, None, None, None, None, None, None), (4, "", "de", "web", 0, "z", 4), (5, None, "de", "book", None, "z", 5), (6, f"secret={key} {prose[:400]} more and more of it " * 3, "fr", "book", 9, None, 6),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `spans` string, `__mix_size2` long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, folder)
        got = out.collect()
        assert stage(spark, df.limit(0), folder).count() == 0
        ids = sorted(str(r.doc_id) for r in got)
        if name == "sentencepiece_encode":
            assert out.columns == ["doc_id", "n_tokens", "ids"] and len(got) == len(rows)
            continue
        assert out.columns == df.columns
        if name == "quality_rules":
            assert {"4", "5"}.isdisjoint(ids) and all(r.text for r in got)
        if name == "simhash_dedup":
            assert ids == ["1", "3", "4", "6", "None", "None"]  # 4 and 5 have no words both
        if name == "secret_scan":
            assert len(got) == len(rows) and not any(key in (r.text or "") for r in got)
        if name == "source_mix":
            assert set(ids) <= {str(r[0]) for r in rows} and len(got) > 0


def test_very_long_texts(spark):
    """One text of several megabytes goes through every operator on texts like any other."""
    words = [f"w{k * 7919 % 100_003}" for k in range(400_000)]
    text = " ".join(words)
    df = spark.createDataFrame([(1, text, "a"), (2, text + " end", "a"), (3, "short text", "b")], "doc_id long, text string, source string")
    sizes = {r.doc_id: r["size"] for r in mixing.mixture(df).collect()}
    assert sizes == {1: 400_000, 2: 400_001, 3: 2}
    assert {r.doc_id: r.n for r in secrets.scan(df).select("doc_id", F.size("spans").alias("n")).collect()} == {1: 0, 2: 0, 3: 0}
    found = {r.id: (r.fp, r.component) for r in simhash.near_duplicates(df).collect()}
    assert found[1] == found[2] and found[3][1] == 3
    judged = {r.doc_id: r.n_words for r in quality.judge(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()}
    assert judged == sizes
    assert {r.doc_id for r in near_copies.deduplicated(df).collect()} == {1, 3}
