"""Links within a Hamming radius, found by BK-trees in bounded blocks of shards.

A node (a long) has a fingerprint of one or more 64-bit words and a list of shard keys. In a shard stands a BK-tree: a tree node's children are keyed by
their integer Hamming distance to it, and a query that is d away follows only the edges from d - r to d + r. The members of a shard are the
queries of its tree. Fingerprints grow with the documents, so that broadcasting all trees would have no size bound: a tree sits in the task its shard is dealt to.

Blocks. A shard of more than ``block`` members is cut into blocks of about that size, by hash of the node, and each block gets a tree and a task of its own. All blocks of
such a shard also get its ``PIVOTS`` pivots, the least node of each of so many slots, which tie the blocks of a large group of near copies to each other. Then
every member that isn't in the shard's largest component is searched in the trees of all blocks. Two members of the largest component need no search: they are linked already.
So no link is lost, and a group that holds a third of all nodes costs about its size.

Edges. ``spanning``: a forest with the components of all links (a search leaves a subtree that is one component with its queries). ``least``: a minimum forest by distance
of each block. A caller that refuses an edge by an exact check must look for further links between its sides itself (``near_copies``): neither the forest of a block nor
the largest component of a shard knows of the refusal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written

BLOCK, PIVOTS = 2_048, 8
#: Pairs of a block that are held before a minimum forest is made of them.
PAIRS = 300_000
#: So many edges at most (16 bytes each) are one task's: its arrays take less than the jobs of the rounds.
ALONE = 1_000_000
#: Shards of over one block are broadcast up to so many (about 24 bytes each), and met by a shuffle beyond.
BROADCAST_SHARDS = 200_000


class Forest:
    """Union-find over positions 0..n-1, by arrays; a root is the least position of its component."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up, r = self.up, self.up[at]
        while True:
            s = up[r]
            if np.array_equal(s, r):
                break
            r = s
        up[at] = r
        return r

    def join(self, at: np.ndarray) -> None:
        r = np.unique(self.roots(at))
        self.up[r] = r[0]


def distances(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ one).sum(axis=1, dtype=np.int64)


def grow_and_search(points: np.ndarray, tree: np.ndarray, queries: np.ndarray, radius: int, forest: Forest | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Build the BK-tree of ``tree`` (positions in ``points``) node by node, by arrays, and search it with its own members and ``queries``.

    Yields (node, positions within the radius, their distances): every linked pair with a member of the tree once. With a forest, what is found is joined in
    it, and a subtree is left once it is one component with all that reaches it.

    A frame is a subtree and the queries from other branches that reach it. Its first point is the node: the rest of the points hang on edges keyed
    by their distance to it, and each edge gets the queries that may find something there.
    """
    stack = [(tree, queries)]
    while stack:
        members, others = stack.pop()
        if forest is not None:
            r = forest.roots(np.concatenate((members, others)))
            if (r == r[0]).all():
                continue  # nothing to learn here
        node, rest = members[0], members[1:]
        d, o = distances(points[rest], points[node]), distances(points[others], points[node])
        near = np.concatenate((rest[d <= radius], others[o <= radius]))
        if len(near):
            if forest is not None:
                forest.join(np.append(near, node))
            yield int(node), near, np.concatenate((d[d <= radius], o[o <= radius]))
        if not len(rest):
            continue
        order = np.argsort(d, kind="stable")
        keys, cuts = np.unique(d[order], return_index=True)
        for edge, branch in zip(keys.tolist(), np.split(rest[order], cuts[1:]), strict=True):
            # a pair in two branches is met once: the branch with the larger key asks the one with the smaller
            asking = np.concatenate((rest[(d > edge) & (d <= edge + radius)], others[np.abs(o - edge) <= radius]))
            if len(branch) > 1 or len(asking):
                stack.append((branch, asking))


def least_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Positions of the edges (a, b) of a minimum forest by d: each round every component takes its first edge."""
    order = np.lexsort((b, a, d))
    up, taken = np.arange(n), []
    while len(order):
        while not np.array_equal(up[up], up):
            up = up[up]
        ra, rb = up[a[order]], up[b[order]]
        apart = ra != rb
        order, ra, rb = order[apart], ra[apart], rb[apart]
        ends, where = np.concatenate((ra, rb)), np.tile(np.arange(len(order)), 2)
        by_edge = np.argsort(where, kind="stable")
        first = np.unique(ends[by_edge], return_index=True)[1]
        for k in np.unique(where[by_edge[first]]).tolist():
            x, y = int(ra[k]), int(rb[k])
            while up[x] != x:
                x = int(up[x])
            while up[y] != y:
                y = int(up[y])
            if x != y:
                up[max(x, y)] = min(x, y)
                taken.append(int(order[k]))
    return np.array(taken, np.int64)


def block_edges(nodes: np.ndarray, points: np.ndarray, of_tree: np.ndarray, radius: int, least: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b), a > b, of one block: its tree members and the queries that came to it."""
    nodes, first = np.unique(nodes, return_index=True)
    points, of_tree = points[first], of_tree[first]
    tree, queries = np.flatnonzero(of_tree), np.flatnonzero(~of_tree)
    if not len(tree):
        return nodes[:0], nodes[:0]
    if not least:
        forest = Forest(len(nodes))
        for _ in grow_and_search(points, tree, queries, radius, forest):
            pass
        roots = forest.roots(np.arange(len(nodes)))
        linked = roots != np.arange(len(nodes))
        return nodes[linked], nodes[roots[linked]]
    # the minimum forest of what was found so far and of what comes is that of all: never more than some pairs are held
    kept, found, held = [np.zeros(0, np.int64)] * 3, [], 0

    def thinned() -> list[np.ndarray]:
        x = np.concatenate((kept[0], np.repeat([x for x, _, _ in found], [len(y) for _, y, _ in found]).astype(np.int64)))
        y, d = np.concatenate((kept[1], *[y for _, y, _ in found])), np.concatenate((kept[2], *[z for _, _, z in found]))
        chosen = least_forest(x, y, d, len(nodes))
        return [x[chosen], y[chosen], d[chosen]]

    for one in grow_and_search(points, tree, queries, radius, None):
        found.append(one)
        held += len(one[1])
        if held > PAIRS:
            kept, found, held = thinned(), [], 0
    a, b, _ = thinned() if found else kept
    a, b = nodes[a], nodes[b]
    return np.maximum(a, b), np.minimum(a, b)


def searched(dealt: DataFrame, radius: int, least: bool) -> DataFrame:
    """(a, b) from (key, block, query, node, words): one tree for each (key, block), of the rows that aren't queries."""
    n_words = len(dealt.columns) - 4

    def edges(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, block, query, node, *words = held
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        bounds = np.concatenate(([0], cuts, [len(key)])).tolist()
        points = np.stack(words, axis=1).view(np.uint64)
        out = [block_edges(node[a:b], points[a:b], query[a:b] == 0, radius, least) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > 1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the block that may go on in the next piece
        joined = lambda: [np.concatenate(x) for x in zip(*held, strict=True)]
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                now = [c.to_numpy(zero_copy_only=False) for c in batch.slice(start, BLOCK).columns]
                if held and (held[-1][0][-1], held[-1][1][-1]) != (now[0][0], now[1][0]):
                    yield from edges(joined())
                    held = []
                changed = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
                if len(changed):
                    at = int(changed[-1]) + 1
                    held.append([x[:at] for x in now])
                    yield from edges(joined())
                    held = []
                    now = [x[at:] for x in now]
                held.append(now)
                if sum(len(x[0]) for x in held) > 2 * BLOCK and now[2][-1]:  # many queries at one block: its tree stays, they pass through
                    whole = joined()
                    yield from edges(whole)
                    held = [[x[whole[2] == 0] for x in whole]]
        if held:
            yield from edges(joined())

    order = ["key", "block", "query", "node", *[f"w{i}" for i in range(n_words)]]
    return dealt.select(*order).repartition("key", "block").sortWithinPartitions("key", "block", "query", "node").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, radius: int, *, least: bool = False, block: int = BLOCK) -> DataFrame:
    """(a, b), a > b: edges between ``nodes`` (node, keys array<long>, w0, w1, ...: the words), whose components are those of all links in all shards."""
    words = [c for c in nodes.columns if c not in ("node", "keys")]
    keyed = nodes.select("node", *words, F.explode("keys").alias("key"))
    large = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).alias("blocks")), "shards")
    n_large = large.count()
    if not n_large:
        return searched(keyed.withColumns({"block": F.lit(0).cast("long"), "query": F.lit(0)}).select("key", "block", "query", "node", *words), radius, least)
    known = F.broadcast(large) if n_large <= BROADCAST_SHARDS else large
    own = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("node", "key"), F.coalesce("blocks", F.lit(1)))).cast("long")
    first = keyed.join(known, "key", "left").withColumns({"block": own, "query": F.lit(0)})
    within = written(first.where("blocks is not null"), "shard-members")
    slot = F.pmod(F.xxhash64(F.lit(PIVOTS), "node", "key"), F.lit(PIVOTS))
    pivots = within.groupBy("key", "blocks", slot.alias("slot")).agg(F.min(F.struct("node", *words)).alias("x"))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    guests = pivots.select("key", every_block, F.lit(0).alias("query"), "x.*")
    order = ["key", "block", "query", "node", *words]
    found = written(searched(first.select(*order).unionByName(guests.select(*order)), radius, least), "tree-links")
    # what isn't in the largest component of its shard is searched in all of the shard's blocks
    of = components(found)
    placed = written(within.join(of, "node", "left").withColumn("component", F.coalesce("component", "node")).select(*order, "blocks", "component"), "shard-members")
    main = placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    rest = placed.join(F.broadcast(main) if n_large <= BROADCAST_SHARDS else main, "key").where("component <> main")
    asking = rest.withColumnRenamed("block", "own").select("key", "own", "node", *words, every_block).where("block <> own").withColumn("query", F.lit(1))
    more = searched(placed.select(*order).unionByName(asking.select(*order)), radius, least)
    return found.unionByName(more)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of a task: every root takes the least root beside it until none has another."""
    held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
    if not held:
        return
    nodes, ends = np.unique(np.concatenate([x for pair in zip(*held, strict=True) for x in pair]), return_inverse=True)
    a, b = np.split(ends, 2)
    up = np.arange(len(nodes))
    while len(a):
        low = np.minimum(a, b)
        np.minimum.at(up, a, low)
        np.minimum.at(up, b, low)
        while not np.array_equal(up[up], up):
            up = up[up]
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    moved = np.flatnonzero(up != np.arange(len(nodes)))
    for at in range(0, len(moved), 50_000):
        part = moved[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[up[part]])], ["node", "component"])


def components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b) that isn't that one.

    Up to ``alone`` edges are joined in one task. Beyond, each round ties every node to its least neighbour, finds the components of this forest, which has an edge a node however many edges there are, and contracts all edges to
    them, until none is left between two. A round at least halves the nodes that have edges. Rounds end in written tables, so lineage stays short and lost executors cost one round.
    The neighbours of a node are never gathered: only their minimum is.
    """
    now, names = written(edges.select("a", "b").distinct(), "links"), None
    if now.count() <= alone:
        found = written(now.coalesce(1).mapInArrow(joined, "node long, component long"), "components")
        removed(now)
        return found
    while True:
        least = now.groupBy("a").agg(F.min("b").alias("m")).unionByName(now.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "a")).groupBy("a").agg(F.min("m").alias("m"))
        found = stars(least.select(F.greatest("a", "m").alias("a"), F.least("a", "m").alias("b")))
        at = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_to"))
        met = now.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).where("a <> b")
        later = written(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        removed(now)
        now = later
        if names is None:
            names = found
        else:  # what was named before may have a smaller name now
            moved = names.join(found.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            after = written(moved.unionByName(found), "components")
            removed(names, found)
            names = after
        if now.isEmpty():
            removed(now)
            return names


def stars(edges: DataFrame) -> DataFrame:
    """(node, component) of a forest, alternating large-star and small-star until its edges (a, b), a > b, are stars: each pair of steps ties nodes to smaller ones or ends."""

    def star(e: DataFrame, small: bool) -> DataFrame:
        """Large: every neighbour above a node is tied to the least of the node and its neighbours; small: those below."""
        both = e.select(F.col("a").alias("n"), F.col("b").alias("m")) if small else e.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("m")), F.struct(F.col("b").alias("n"), F.col("a").alias("m")))).alias("x")).select("x.n", "x.m")
        least = both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("least"))
        tied = both.join(least, "n")
        if small:
            out = tied.select("m", "least").unionByName(least.select(F.col("n").alias("m"), "least"))
        else:
            out = tied.where("m > n").select("m", "least")
        return out.where("m <> least").select(F.col("m").alias("a"), F.col("least").alias("b")).distinct()

    now = written(edges.where("a <> b").distinct(), "stars")
    while not now.isEmpty():
        after = written(star(star(now, False), True), "stars")
        # stars: every a has one b, and no b is an a
        held = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        removed(now)
        now = after
        if held:
            break
    out = written(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
    removed(now)
    return out
