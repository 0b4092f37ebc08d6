"""Near copies by SimHash and BK-trees, verified exactly: five-word shingles, similarity of their sets of 0.8 or more.

Similarity. The one that a SimHash estimates, the cosine of two sets: common shingles by the root of the product of the sets' sizes. For sets of one size it is the share that is common, and
0.8 is a Jaccard similarity of two thirds.

Fingerprint. ``WORDS`` 64-bit words of a SimHash over the distinct shingles: word k counts the bits of the k-th mix of a shingle's XXH64. Equal sets are one node.

Shards. A similarity of 0.8 is an angle at which 20 % of the bits differ: too many for block keys, which agree in whole. But what differs are
the bits whose counts lie near a tie. So of every word the ``TOP`` bits that lie farthest from one, with their signs, are taken, and each choice of ``KEY`` of
these is a shard key. A pair at a similarity of just 0.8 shares one in about 70 % of the cases, at 0.86 in 92 %, from 0.89 (a Jaccard similarity of 0.8) on in 97 % and more
(test_recall_by_similarity); the last step finds the rest. A set of one shingle has no
other set at 0.8, and no keys. A key is one of ten million; beyond some ten million documents raise ``KEY``, and ``TOP`` with it.

Links. BK-trees of the shards (``bk_trees``, over the first ``TREE_WORDS`` words; a pair at 0.8 lies beyond ``RADIUS`` once in a million) give a minimum forest of links, never
all pairs. Each of its edges is verified by the two sets, and what is verified makes the first groups.

The rest, exactly. Keys, radius and forests are estimates and leave pairs out, so the groups are completed by a bound that holds for every pair (``prefix``): in one order of all shingles, the
first a - ceil(0.64 a) + 1 shingles of a set of a share one with those of any set at 0.8. The order is by hash, with shingles that are frequent in a sample last; any order gives the same
pairs. Shingles that one set alone has are dropped, lists of the same sets are one list. Pairs of sets in a list that aren't in one group yet, whose parities
(``parities``) don't refuse 0.8 and whose prefixes share enough for it, are verified: first one for each two groups, then, between groups that are still apart, all. So no pair at 0.8 is left between two groups, and a group costs no pairs within itself.

Defined cases. Words as in SimHash. Fewer words than a shingle has: the whole sequence is the shingle; no words: the empty set, equal to itself only.
Very long texts: one pass. Null texts: as empty. Repeated ids: rows are told apart by id and set. Rows without an id stay. Repeated rows count once. Empty table: empty
result. Other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bk_trees import components, links
from .common import broadcast_if_small, forget, numbered, removed, short_batches, written
from .simhash import SEED, bit_counts, shingle_hashes

WORDS, TREE_WORDS, TOP, KEY, RADIUS, BLOCK, SALTS = 4, 2, 6, 4, 48, 1_024, 32
#: Shingles in a bucket of lists, sets in the sample for frequent shingles, how often these occur in it, and how many are told apart at most.
BUCKET, SAMPLE, FREQUENT, MOST_FREQUENT = 500_000, 4_000, 8, 50_000
#: Cells of the parities, least and most; nodes in a block of a list; pairs made at a time, and bits of parities compared at a time.
CELLS, LIST, PAIRS, HELD = (256, 4_096), 1_024, 300_000, 1 << 25
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) for k in range(WORDS)], np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    return np.unique(shingle_hashes(text, words))


def margins(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint, hashes with the bit set less those without."""
    x = hashes[:, None] * _MIX
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return 2 * bit_counts(x) - len(hashes)


def sketch(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """(words of the fingerprint for the trees, both signed; for each word its surest bits with their signs in ascending order, packed by seven bits) of a set."""
    if not len(hashes):
        return [0] * TREE_WORDS, [0] * WORDS
    m = margins(hashes)
    words = np.packbits(m > 0, bitorder="little").view(np.int64).tolist()
    sure = np.argsort(-np.abs(m.reshape(WORDS, 64)), axis=1, kind="stable")[:, :TOP]
    named = np.sort(sure * 2 + (np.take_along_axis(m.reshape(WORDS, 64), sure, axis=1) > 0), axis=1)
    return words[:TREE_WORDS], (named << 7 * np.arange(TOP)).sum(axis=1).tolist()


def keys_of(sure: list[int]) -> list[int]:
    """Shard keys from the packed bits: each choice of KEY of a word's TOP bits, with the word's number."""
    return [sum((x >> 7 * c & 127) << 7 * i for i, c in enumerate(choice)) | k << 7 * KEY for k, x in enumerate(sure) for choice in combinations(range(TOP), KEY)]


def shard_keys(columns: list[str]) -> Column:
    """The same on the JVM."""
    part = lambda x, c, i: F.shiftleft(F.shiftright(F.col(x), 7 * c).bitwiseAND(F.lit(127).cast("long")), 7 * i)
    key = lambda k, x, choice: reduce(lambda a, b: a.bitwiseOR(b), [part(x, c, i) for i, c in enumerate(choice)], F.lit(k << 7 * KEY).cast("long"))
    return F.array(*[key(k, x, choice) for k, x in enumerate(columns) for choice in combinations(range(TOP), KEY)])


def prefix(hashes: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, so many that two sets at the similarity share one. Both arguments ascend.

    A set of b at cosine c to one of a has b >= c^2 a, so c^2 a shingles in common at least; of these one is among the first a - ceil(c^2 a) + 1 in any order that all sets keep."""
    many = np.isin(hashes, frequent, assume_unique=True) if len(frequent) else np.zeros(len(hashes), bool)
    return np.concatenate((hashes[~many], hashes[many]))[: len(hashes) + percent * percent * len(hashes) // -10_000 + 1]


def lists_of(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, node, weight) for each token that several nodes have; a list is named by its nodes, and those with the same nodes are one, with their number as its weight."""
    order = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[order], nodes[order]
    once = np.ones(len(tokens), bool)
    once[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
    tokens, nodes = tokens[once], nodes[once]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    sizes = np.diff(np.append(starts, len(tokens)))
    x = nodes.view(np.uint64) * _MIX[1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    names = np.add.reduceat(x, starts)
    several = np.flatnonzero(sizes > 1)
    _, first, times = np.unique(names[several], return_index=True, return_counts=True)
    weights = np.zeros(len(sizes), np.int64)
    weights[several[first]] = times
    rows = np.repeat(weights, sizes)
    return np.repeat(names, sizes)[rows > 0].view(np.int64), nodes[rows > 0], rows[rows > 0]


def shared_lists(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(list, node, weight) from (node, size, text), repeated rows allowed: the nodes that share so many (weight) shingles of their prefixes."""
    n, total = texts.agg(F.count("*"), F.sum("size")).first()
    buckets = max(16, (total or 0) * (10_000 - percent * percent) // 10_000 // BUCKET)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), words).view(np.int64))], ["h"])

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(max(1, n // SAMPLE))) == 0).dropDuplicates(["node"]).select("text")
    often = some.mapInArrow(counted, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(MOST_FREQUENT)
    frequent = np.sort(np.array([r.h for r in often.select("h").collect()], np.int64).view(np.uint64))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            for at in range(0, len(nodes), 1_000):
                found = [prefix(shingles(batch.column(1)[i].as_py(), words), frequent, percent) for i in first[at : at + 1_000].tolist()]
                tokens, owners = np.concatenate(found), np.repeat(nodes[at : at + 1_000], [len(x) for x in found])
                bucket = (tokens >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                tokens, owners = tokens[order].astype(np.uint32), owners[order]
                names, cuts = np.unique(bucket[order], return_index=True)
                cuts = [*cuts.tolist(), len(tokens)]
                parts = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array([tokens[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([owners[a:b].tobytes() for a, b in parts], pa.binary())], ["bucket", "tokens", "nodes"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def out() -> Iterator[pa.RecordBatch]:
            columns = lists_of(np.frombuffer(b"".join(x for x, _ in held), np.uint32), np.frombuffer(b"".join(y for _, y in held), np.int64))
            for at in range(0, len(columns[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in columns], ["list", "node", "weight"])

        for batch in batches:
            for bucket, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and bucket != now:
                    yield from out()
                    held = []
                now = bucket
                held.append((x, y))
        if held:
            yield from out()

    slim = texts.select("node", "text").mapInArrow(dealt, "bucket long, tokens binary, nodes binary")
    return slim.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(met, "list long, node long, weight long").groupBy("list", "node").agg(F.sum("weight").alias("weight"))


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each cell that an odd number of the hashes falls in; about as many cells as hashes, a power of two within ``CELLS``. Folding it in two gives that of half the cells."""
    cells = min(max(1 << max(len(hashes) - 1, 0).bit_length(), CELLS[0]), CELLS[1])
    return np.packbits(np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1 > 0, bitorder="little").tobytes()


def may_be_near(pairs: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which pairs (positions) may be at the similarity, by their sizes and parities. Exact in one direction: two sets differ by at least as many shingles as their parities by cells."""
    x, y = sizes[pairs[0]], sizes[pairs[1]]
    c2 = percent * percent
    left = np.minimum(x, y) * 10_000 >= np.maximum(x, y) * c2
    wide = np.array([8 * len(b) for b in bits])
    cells = np.minimum(wide[pairs[0]], wide[pairs[1]])
    level = CELLS[0]
    while level <= CELLS[1]:
        now = np.flatnonzero(left & (cells == level))
        if len(now):
            ends = np.unique(np.concatenate((pairs[0][now], pairs[1][now])))
            rows = np.empty((len(ends), level // 64), np.uint64)
            for i, k in enumerate(ends.tolist()):
                rows[i] = np.bitwise_xor.reduce(np.frombuffer(bits[k], np.uint64).reshape(-1, level // 64), axis=0)
            a, b = np.searchsorted(ends, pairs[0][now]), np.searchsorted(ends, pairs[1][now])
            for at in range(0, len(now), HELD // level):
                part = slice(at, at + HELD // level)
                apart = np.bitwise_count(rows[a[part]] ^ rows[b[part]]).sum(axis=1, dtype=np.int64)
                m, n = x[now[part]], y[now[part]]
                twice = m + n - apart  # of the shingles in common, at most
                left[now[part]] = (twice >= 0) & (twice * twice * 2_500 >= c2 * m * n)
        level *= 2
    return np.flatnonzero(left)


def pairs_of(ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) in bounded parts: each row i with the rows from first[i] up to ends[i]."""
    counts = ends - first
    sums = np.concatenate(([0], np.cumsum(counts)))
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + PAIRS, "right")) - 1)
        c = counts[at:to]
        i = np.repeat(np.arange(at, to), c)
        if len(i):
            yield i, np.arange(len(i)) - np.repeat(sums[at:to] - sums[at], c) + first[i]
        at = to


def open_pairs(lists: DataFrame, sizes: DataFrame, near: DataFrame, percent: int, block: int = LIST) -> DataFrame:
    """(a, b), a > b: pairs between groups of ``near`` (node, component) that may be at the similarity, by their sizes and parities (node, size, bits) and the shingles that their prefixes share.

    Pairs are made and tested by arrays, and only those that pass become rows. A list of over ``block`` nodes is dealt out: its largest group in blocks, the others in blocks, each block of
    others with each of either kind. So a task has about twice ``block`` of a list, every pair meets in one, and the pairs within the largest group aren't made.

    Of two prefixes the one that ends first holds all common shingles up to its end; of those beyond, there are at most as many as its set has left."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            name, part, component, side, node, size, weight = (rows.column(c).to_numpy() for c in ("list", "part", "component", "side", "node", "size", "weight"))
            bits = rows.column("bits").to_pylist()
            new = np.concatenate(([True], (name[1:] != name[:-1]) | (part[1:] != part[:-1])))
            group = np.cumsum(new) - 1
            ends = np.append(np.flatnonzero(new)[1:], len(name))[group]
            other = np.flatnonzero(np.concatenate(([True], new[1:] | (component[1:] != component[:-1]))))
            first = np.append(other[1:], len(name))[np.searchsorted(other, np.arange(len(name)), "right") - 1]  # a group's nodes stand together
            for i, j in pairs_of(ends, first):
                asked = (side[i] == 2) | (side[i] != side[j])
                i, j = i[asked], j[asked]
                some = may_be_near((i, j), size, bits, percent)
                if len(some):
                    i, j = i[some], j[some]
                    a, b = np.maximum(node[i], node[j]), np.minimum(node[i], node[j])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, weight[i], np.minimum(size[i], size[j]), np.maximum(size[i], size[j]))], ["a", "b", "weight", "m", "n"])

        held: list[pa.Table] = []
        for batch in batches:
            now = pa.Table.from_batches([batch])
            name, part = now.column("list").to_numpy(), now.column("part").to_numpy()
            last = int(np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (part[1:] != part[:-1]))))[-1]) if len(name) else 0
            if held and len(name) and (held[-1].column("list")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (name[0], part[0]):
                yield from out(pa.concat_tables(held))
                held = []
            if last:
                yield from out(pa.concat_tables([*held, now.slice(0, last)]))
                held = []
            if len(name):
                held.append(now.slice(last))
        if held:
            yield from out(pa.concat_tables(held))

    placed = lists.join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = placed.groupBy("list", "component").agg(F.count("*").alias("n"))
    mixed = groups.groupBy("list").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    whole, main = F.col("n") <= block, F.col("component") == F.col("main")
    mains, rest = F.ceil(F.col("top") / block), F.ceil((F.col("n") - F.col("top")) / block)
    own = F.pmod(F.xxhash64("node"), F.when(main, mains).otherwise(rest))
    to = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
    at = lambda part, side: F.struct(part.cast("long").alias("part"), side.cast("int").alias("side"))
    among = lambda p: at(mains * rest + F.least(own, p) * rest + F.greatest(own, p), F.when(own == p, 2).otherwise((own > p).cast("int")))
    parts = F.when(whole, F.array(at(F.lit(0), F.lit(2)))).when(main, to(rest, lambda o: at(own * rest + o, F.lit(0)))).otherwise(F.concat(to(mains, lambda m: at(m * rest + own, F.lit(1))), to(rest, among)))
    dealt = placed.join(mixed, "list").join(sizes, "node").withColumn("at", F.explode(parts)).select("list", "at.part", "component", "at.side", "node", "size", "weight", "bits")
    found = dealt.repartition("list", "part").sortWithinPartitions("list", "part", "component").mapInArrow(met, "a long, b long, weight long, m long, n long")
    shared = found.groupBy("a", "b").agg(F.sum("weight").alias("shared"), F.first("m").alias("m"), F.first("n").alias("n"))
    beyond = F.ceil(F.col("n") * (percent * percent) / 10_000) - 1
    most = F.least(F.col("shared") + beyond, F.col("m"))
    return shared.where(most * most * 10_000 >= F.col("m") * F.col("n") * (percent * percent)).select("a", "b")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document, that with the smallest id, of each group of near copies."""
    with short_batches(docs.sparkSession):
        return _deduplicated(docs, id_col, text_col, words, percent, block)


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, block: int) -> DataFrame:
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                sets = [shingles(t.as_py(), words) for t in part.column(at)]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                prints, sure = zip(*map(sketch, sets), strict=True)
                columns = [pa.array(nodes), *[pa.array(w, pa.int64()) for x in (prints, sure) for w in zip(*x, strict=True)], pa.array([len(x) for x in sets], pa.int64()), pa.array(map(parities, sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *new])

    names, docs = docs.columns, numbered(docs)
    id_col, text_col = docs.columns[names.index(id_col)], docs.columns[at]
    words_, sure_ = [f"w{k}" for k in range(TREE_WORDS)], [f"s{k}" for k in range(WORDS)]
    new = [f"__near_{c}" for c in ("node", *words_, *sure_, "size", "bits")]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} {'binary' if c == '__near_bits' else 'long'}" for c in new)])
    marked = written(docs.mapInArrow(run, kinds), "near-sketches")
    slim = marked.where("__near_size >= 2").select(*[F.col(c).alias(c.removeprefix("__near_")) for c in new])
    nodes = written(slim.groupBy("node").agg(*[F.min(c).alias(c) for c in (*words_, *sure_)]), "near-nodes")
    edges = written(links(nodes.select("node", shard_keys(sure_).alias("keys"), *words_), RADIUS, least=True, block=block).distinct(), "near-edges")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                found = [shingles(t.as_py(), words).view(np.int64) for t in part.column(1)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], ["node", "set"])

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs of a written table whose sets are at the similarity."""
        met = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-met")
        # one row for each set: copies of a text go before the texts move
        rows = marked.select(F.col("__near_node").alias("node"), F.col(text_col).alias("text")).join(broadcast_if_small(met), "node", "left_semi")
        sets = written(rows.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(sets_of, "node long, set array<long>"), "near-sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        common, sizes = F.size(F.array_intersect("x", "y")).cast("long"), F.size("x").cast("long") * F.size("y")
        out = written(both.where(common * common * 10_000 >= F.lit(percent * percent) * sizes).select("a", "b"), "near-verified")
        removed(pairs, met, sets)
        return out

    sure_edges = verified(edges)
    near = components(sure_edges)
    removed(nodes)
    # what the estimates left out: every pair at the similarity shares a list
    sized = marked.where("__near_size >= 2").select(F.col("__near_node").alias("node"), F.col("__near_size").alias("size"), F.col(text_col).alias("text"))
    lists = written(shared_lists(sized, words, percent), "near-lists")
    bits = marked.select(F.col("__near_node").alias("node"), F.col("__near_size").alias("size"), F.col("__near_bits").alias("bits"))
    listed = written(lists.select("node").distinct(), "near-listed")
    size_of = written(bits.join(broadcast_if_small(listed), "node", "left_semi").dropDuplicates(["node"]), "near-sizes")
    removed(listed)
    pairs = written(open_pairs(lists, size_of, near, percent), "near-pairs")
    for every in (False, True):
        of = lambda end: near.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))  # noqa: E731, B023
        apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"of_a": F.coalesce("of_a", "a"), "of_b": F.coalesce("of_b", "b")}).where("of_a <> of_b")
        if not every:  # one pair of two groups first
            apart = apart.groupBy(F.greatest("of_a", "of_b"), F.least("of_a", "of_b")).agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.*")
        more = verified(written(apart.select("a", "b"), "near-open"))
        if not more.isEmpty():
            later = written(sure_edges.unionByName(more), "near-verified")
            removed(sure_edges, near)
            sure_edges, near = later, components(later)
        removed(more)
    removed(pairs)
    removed(lists, size_of, sure_edges)

    rows = marked.select(F.col(id_col).alias("__near_id"), "__near_node")
    copies = rows.where("__near_id is not null").groupBy("__near_id", "__near_node").count()
    found = written(copies.join(near.withColumnRenamed("node", "__near_node"), "__near_node", "left").withColumn("group", F.coalesce("component", "__near_node")), "near-found")
    # a group may hold a third of all rows: its join is salted
    kept = found.groupBy("group").agg(F.min(F.struct("__near_id", "__near_node")).alias("kept")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("__near_id"), F.lit(SALTS)).cast("int"))
    gone = salted.join(kept, ["group", "salt"]).where(F.struct("__near_id", "__near_node") != F.col("kept"))
    going = written(gone.select(F.col("__near_id").alias("__near_gone"), F.col("__near_node").alias("__near_gone_node")), "near-gone")
    repeated = not found.where("count > 1").isEmpty()
    removed(found, near)
    out = marked.select(*docs.columns, "__near_node")
    if repeated:
        out = out.where(F.col(id_col).isNull()).unionByName(out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, "__near_node"]))
    return out.join(broadcast_if_small(going), (F.col(id_col) == F.col("__near_gone")) & (F.col("__near_node") == F.col("__near_gone_node")), "left_anti").drop("__near_node").toDF(*names)
