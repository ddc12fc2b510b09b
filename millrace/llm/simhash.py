"""SimHash fingerprints and their near-duplicate classes, by a binary trie self-join.

Fingerprints within ``BUDGET`` differing bits link; a class is a connected component of links. The join works on
distinct fingerprints only, so exact copies never meet each other:

1. every fingerprint is dealt to forests of tries. By the pigeonhole principle, of ``b`` blocks of bits at most four
   hold a differing bit, so ``b - 4`` blocks are equal; one forest is made for each choice of those blocks, and its
   tries (one for each value of the chosen blocks) hold only fingerprints that agree there. ``b`` follows from the
   number of fingerprints, so that a trie stays small on average at any size;
2. in a trie that is too large for one task, all nodes are first compared with a few of them (hubs). What hubs link is a
   star, and nodes of one star need not meet again. The rest is cut into pieces, and pairs of pieces of different stars
   (or of none) are cells;
3. cells are dealt to tasks and sorted, so that a task holds few of them at once. It walks a cell's tries in pairs of nodes
   from the roots down, adding up differing bits, and drops a pair as soon as it is over the budget. Small node pairs are
   compared leaf by leaf. Links are merged in the task (union-find), so it returns a spanning forest, never all pairs;
4. the forests are merged to components by alternating large-star and small-star steps, each checkpointed.

``similar`` links documents by a Jaccard similarity, with wider fingerprints and another dealing (see there).

Nulls: a null text has no words. No words: fingerprint zero, linked like any other. Empty tables give empty results;
repeated rows are kept, and a null id gets its class from the rows it links with. Texts of any length are hashed whole. Other
columns than id and text aren't read, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, let, out, restarted, spread, steps, tidy

BUDGET = 4
SHINGLE = 4
SEED = 42
#: A trie of more fingerprints is cut into pieces of about this many.
PIECE = 1024
#: Mean fingerprints a trie, beyond which one more block is used.
MEAN = 256
#: Node pairs in work at once, and leaf pairs below which a node pair is compared leaf by leaf.
FRONTIER = 1 << 18
LEAVES = 16
#: Nodes of a large trie that all others are compared with first.
HUBS = 8

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LANES = np.uint64(0x0001000100010001)
_LANE_ROWS = 60_000


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 (uint64) of each shingle of a whole text, repeats included; of the whole sequence if it has fewer words."""
    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle]))
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def votes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint (uint64) of each run of ``sizes[i]`` hashes: a bit is 1 if set in over half of them."""
    result = np.zeros(len(sizes), np.uint64)
    if not len(hashes):
        return result
    starts = np.cumsum(sizes) - sizes
    runs = [range(int(a), int(a + n), _LANE_ROWS) for a, n in zip(starts, sizes, strict=True)]
    owner = np.repeat(np.arange(len(sizes)), [len(r) for r in runs])
    cuts = np.array([at for r in runs for at in r])
    counts = np.zeros((len(sizes), 64), np.int64)
    for shift in range(16):  # four bits at once, in lanes of 16 bits
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, cuts)
        for lane in range(4):
            np.add.at(counts[:, 16 * lane + shift], owner, ((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
    bits = 2 * counts > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_many(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints (uint64) of whole texts."""
    parts = [shingle_hashes(t, shingle, seed) for t in texts]
    return votes(np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array([len(h) for h in parts], np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row; the bits of fp are those of the unsigned fingerprint."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            yield out(schema, {"doc_id": b.column(0), "fp": fingerprint_many(b.column(1).to_pylist()).view(np.int64)})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id bigint, fp bigint")


# ---------------------------------------------------------------- the trie join


def plan_blocks(n: int, budget: int = BUDGET, mean: int = MEAN) -> list[list[int]]:
    """For each forest, the bits (0 is the lowest) that its tries' fingerprints agree in."""
    b = budget + 1
    while True:
        edges = [round(64 * i / b) for i in range(b + 1)]
        blocks = [list(range(edges[i], edges[i + 1])) for i in range(b)]
        least = min(sum(len(blocks[i]) for i in c) for c in combinations(range(b), b - budget))
        if n <= mean << least or b == budget + 4:
            return [[bit for i in c for bit in blocks[i]] for c in combinations(range(b), b - budget)]
        b += 1


class Links:
    """Union-find over positions, for links that come in blocks."""

    def __init__(self, n: int) -> None:
        self.to = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.to[a], self.to[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.to, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.to[self.to], self.to):
                self.to = up


def walk(fp: np.ndarray, tree: np.ndarray, left: np.ndarray, right: np.ndarray, budget: int = BUDGET, wide: np.ndarray | None = None, wide_budget: int = 0) -> np.ndarray:
    """Link all pairs within the budget between trees ``left[i]`` and ``right[i]`` (equal: within one); gives each row its link.

    With ``wide`` (rows of uint64), a pair must be within ``wide_budget`` bits there, too. Rows are sorted by (tree, fp),
    fp unsigned and, without ``wide``, distinct in a tree. Node pairs are ranges of rows; a level's split of
    a range follows from the running count of ones in that level's bit.
    """
    links = Links(len(fp))
    low = np.searchsorted(tree, np.concatenate((left, right)), "left")
    high = np.searchsorted(tree, np.concatenate((left, right)), "right")
    n = len(left)
    ones: dict[int, np.ndarray] = {}

    def leaves(a: np.ndarray, a2: np.ndarray, b: np.ndarray, b2: np.ndarray) -> None:
        """Compare leaf by leaf."""
        across = b2 - b
        count = (a2 - a) * across
        first = np.repeat(np.cumsum(count) - count, count)
        k = np.arange(len(first)) - first
        across = np.repeat(across, count)
        i, j = np.repeat(a, count) + k // across, np.repeat(b, count) + k % across
        near = (i != j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
        i, j = i[near], j[near]
        if wide is not None and len(i):
            apart = links.to[i] != links.to[j]
            i, j = i[apart], j[apart]
            near = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64) <= wide_budget
            i, j = i[near], j[near]
        links.add(i, j)

    stack = [(63, low[:n], high[:n], low[n:], high[n:], np.zeros(n, np.int8))]
    while stack:
        level, a, a2, b, b2, d = stack.pop()
        if not len(a):
            continue
        few = (a2 - a) * (b2 - b) <= LEAVES
        if level < 0 or few.all():
            pairs = np.cumsum((a2 - a) * (b2 - b))
            at = 0
            while at < len(a):  # at least one node pair at once, and about FRONTIER leaf pairs
                end = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + FRONTIER)))
                leaves(a[at:end], a2[at:end], b[at:end], b2[at:end])
                at = end
            continue
        if few.any():
            stack.append((-1, a[few], a2[few], b[few], b2[few], d[few]))
            a, a2, b, b2, d = (x[~few] for x in (a, a2, b, b2, d))
        if len(a) > FRONTIER // 4:
            half = len(a) // 2
            stack += [(level, *(x[:half] for x in (a, a2, b, b2, d))), (level, *(x[half:] for x in (a, a2, b, b2, d)))]
            continue
        if level not in ones:
            ones[level] = np.concatenate(([0], np.cumsum((fp >> np.uint64(level)) & np.uint64(1), dtype=np.int32)))
        c = ones[level]
        am, bm, same = a2 - (c[a2] - c[a]), b2 - (c[b2] - c[b]), a == b
        same &= a2 == b2
        # 0-0, 1-1, 0-1 and, for two distinct nodes, 1-0
        na = np.concatenate((a, am, a, am[~same]))
        na2 = np.concatenate((am, a2, am, a2[~same]))
        nb = np.concatenate((b, bm, bm, b[~same]))
        nb2 = np.concatenate((bm, b2, b2, bm[~same]))
        nd = np.concatenate((d, d, d + 1, (d + 1)[~same])).astype(np.int8)
        keep = (na < na2) & (nb < nb2) & (nd <= budget) & ~((na == nb) & (na2 == nb2) & (na2 - na == 1))
        stack.append((level - 1, na[keep], na2[keep], nb[keep], nb2[keep], nd[keep]))
    return links.to


KEY = ("forest", "trie")
CELL = (*KEY, "i", "j")
#: Rows of whole cells, and bytes of them, that a task works on at once, about (one cell may be larger).
CELL_ROWS = 1 << 14
CELL_BYTES = 16 << 20


def trie_links(distinct: DataFrame, budget: int = BUDGET, piece: int = PIECE, mean: int = MEAN) -> DataFrame:
    """(a, b) bigint: links whose components are those of all pairs of ``distinct.fp`` within the budget."""
    forests = plan_blocks(distinct.count(), budget, mean)
    masks = [sum(1 << bit for bit in bits) for bits in forests]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = distinct.select(F.col("fp").alias("node"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias(*KEY), F.lit(1).alias("weight"))
    near = lambda v, w: F.bit_count(v.bitwiseXOR(w)) <= budget
    cut, links = cells(dealt, distinct.select(F.col("fp").alias("node"), F.col("fp").alias("value")), near, piece)
    found = forest_links(cut.withColumn("fp", F.col("node")), budget)
    return found if links is None else found.union(links)


def cells(dealt: DataFrame, values: DataFrame, near: Callable[[Column, Column], Column], piece: int = PIECE) -> tuple[DataFrame, DataFrame | None]:
    """Deal the nodes of each trie (forest, trie, node, weight) to cells (forest, trie, i, j) that fit a task, and links already found.

    ``own`` is a node's piece. A trie of one node goes; one of up to ``piece`` in weight is one cell. In a larger one, hubs link
    what is ``near`` them by ``values`` (node, value), and ``star_cells`` cuts it to pieces.
    """
    sizes = checkpointed(dealt.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("weight").alias("all")).where("n > 1").drop("n"))
    nodes = dealt.join(spread(sizes, *KEY), [*KEY])
    zero = F.lit(0)
    small = nodes.where(F.col("all") <= piece).select(*KEY, "node", zero.alias("i"), zero.alias("j"), zero.alias("own"))
    if sizes.where(F.col("all") > piece).isEmpty():
        return small, None
    starred, links = stars(nodes.where(F.col("all") > piece).drop("all"), values, near)
    return small.unionByName(star_cells(starred, piece)), links


def stars(nodes: DataFrame, values: DataFrame, near: Callable[[Column, Column], Column], hubs: int = HUBS) -> tuple[DataFrame, DataFrame]:
    """The nodes of large tries with their ``star`` (0: none), and links (a, b) whose components have each star in one piece.

    ``hubs`` nodes of each trie are chosen by hash. A node near one of them is of that hub's star; hubs that share a node are one
    star. A group of near copies that hubs reach thus costs as much as it has rows; nodes of different stars, or of none,
    still meet in all pairs, so a large trie that few hubs reach costs pairs. The number of hubs is no cap.
    """
    slot = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(hubs)).cast("int")
    chosen = nodes.groupBy(*KEY, slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("x")).select(*KEY, F.col("x.node").alias("node"))
    listed = checkpointed(chosen.join(spread(values, "node"), "node").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("node", "value"))).alias("hubs")))  # at most ``hubs``
    met = nodes.join(spread(values, "node"), "node").join(spread(listed, *KEY), [*KEY])
    flags = F.aggregate(F.reverse("hubs"), F.lit(0), lambda m, h: m * 2 + near(F.col("value"), h["value"]).cast("int"))
    met = checkpointed(met.select(*KEY, "node", "weight", flags.alias("mask")))
    masks = met.where("mask > 0").groupBy(*KEY).agg(F.collect_set("mask").alias("masks"))  # at most 2 ** hubs numbers
    schema = pa.schema([("forest", pa.int32()), ("trie", pa.int64()), ("star", pa.list_(pa.int32())), ("hub", pa.list_(pa.int64()))])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for hub, given in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                to = Links(len(hub))
                for m in given:
                    at = [k for k in range(len(hub)) if m >> k & 1]
                    to.add(np.array(at[1:], int), np.array(at[:-1], int))
                rows.append(to.to.tolist())
            yield out(schema, {"forest": b.column(0), "trie": b.column(1), "star": [[k + 1 for k in r] for r in rows], "hub": [[hub[k] for k in r] for hub, r in zip(b.column(2).to_pylist(), rows, strict=True)]})

    joined = listed.select(*KEY, F.transform("hubs", lambda h: h["node"]).alias("hub")).join(masks, [*KEY])
    found = joined.mapInArrow(merged, "forest int, trie bigint, star array<int>, hub array<bigint>")
    met = met.join(found, [*KEY], "left").withColumn("at", F.expr("case when mask > 0 then bit_count((mask & -mask) - 1) + 1 end"))
    met = checkpointed(met.select(*KEY, "node", "weight", F.coalesce(F.element_at("star", F.col("at")), F.lit(0)).alias("star"), F.element_at("hub", F.col("at")).alias("hub")))
    return met.drop("hub"), met.where("hub <> node").select(F.col("node").alias("a"), F.col("hub").alias("b"))


def star_cells(nodes: DataFrame, piece: int = PIECE) -> DataFrame:
    """Cells of the nodes of ``stars``: pieces hold nodes of one star, and pieces of the same star never meet."""
    trie = Window.partitionBy(*KEY)
    sizes = nodes.groupBy(*KEY, "star").agg(F.ceil(F.sum("weight") / piece).cast("int").alias("pieces"))
    sizes = sizes.withColumn("end", F.sum("pieces").over(trie.orderBy("star")).cast("int")).withColumn("all", F.sum("pieces").over(trie).cast("int"))
    cut = nodes.select(*KEY, "star", "node").join(spread(sizes, *KEY, "star"), [*KEY, "star"]).withColumn("first", F.col("end") - F.col("pieces"))
    cut = cut.withColumn("own", F.col("first") + F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    none = F.array().cast("array<int>")
    below = F.when(F.col("first") > 0, F.sequence(F.lit(0), F.col("first") - 1)).otherwise(none)
    above = F.when(F.col("end") < F.col("all"), F.sequence(F.col("end"), F.col("all") - 1)).otherwise(none)
    others = F.when(F.col("star") == 0, F.sequence(F.lit(0), F.col("all") - 1)).otherwise(F.concat(below, above))
    cut = cut.select(*KEY, "node", "own", F.explode(others).alias("other"))
    return cut.select(*KEY, "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")


def in_cells(cut: DataFrame, work: Callable[[pa.Table, list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b) bigint: the links that ``work(table, cell keys, own)`` finds in whole cells, a bounded number of them at once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = work(t, [t.column(c).to_numpy() for c in CELL], t.column("own").to_numpy())
        for at in range(0, len(a), 1 << 16):
            yield out(schema, {"a": a[at : at + (1 << 16)], "b": b[at : at + (1 << 16)]})

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                held.append(whole.slice(at, 1024))
                if sum(b.num_rows for b in held) < CELL_ROWS and sum(b.nbytes for b in held) < CELL_BYTES:
                    continue
                t = pa.Table.from_batches(held)
                last = np.logical_and.reduce([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in CELL])
                cut_at = len(last) - int(last.sum())
                if cut_at:
                    yield from links(t.slice(0, cut_at).combine_chunks())
                    held = t.slice(cut_at).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield from links(pa.Table.from_batches(held).combine_chunks())

    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(n, *CELL).sortWithinPartitions(*CELL).mapInArrow(streamed, "a bigint, b bigint").distinct()


def forest_links(cut: DataFrame, budget: int, wide_budget: int | None = None) -> DataFrame:
    """(a, b) bigint: in each cell, links whose components are those of all its pairs of nodes within the budget.

    ``cut`` has the columns of ``cells``, fp and, with ``wide_budget``, wide (array of words of 64 bits).
    """

    def work(t: pa.Table, keys: list[np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = t.column("fp").to_numpy().view(np.uint64)
        order = np.lexsort((fp, own, *reversed(keys)))
        fp, own, keys = fp[order], own[order], [k[order] for k in keys]
        values = t.column("node").to_numpy()[order]
        wide = None
        if wide_budget is not None:
            wide = t.column("wide").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(fp), -1)[order]
        cell = np.concatenate(([0], np.cumsum(np.any([k[1:] != k[:-1] for k in keys], axis=0)))) if len(fp) > 1 else np.zeros(len(fp), int)
        tree = np.concatenate(([0], np.cumsum((cell[1:] != cell[:-1]) | (own[1:] != own[:-1]))))
        head = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
        single = keys[2][head] == keys[3][head]  # one piece with itself
        trees = tree[head]
        pairs = np.flatnonzero(~single[:-1] & ~single[1:] & (cell[head][:-1] == cell[head][1:])) if len(head) > 1 else np.array([], int)
        to = walk(fp, tree, np.concatenate((trees[single], trees[pairs])), np.concatenate((trees[single], trees[pairs + 1])), budget, wide, wide_budget or 0)
        linked = np.flatnonzero(to != np.arange(len(to)))
        return values[linked], values[to[linked]]

    return in_cells(cut, work)


def confirmed_links(cut: DataFrame, similarity: float, wide_budget: int) -> DataFrame:
    """(a, b) bigint: in each cell, links whose components are those of all its pairs of nodes of this exact Jaccard similarity.

    ``cut`` has the columns of ``cells``, wide, and shingles (array of distinct hashes, sorted as unsigned). Pairs beyond
    ``wide_budget``, or of sizes that rule the similarity out, are not compared; nor are pairs that confirmed links join already.
    """

    def work(t: pa.Table, keys: list[np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = t.column("node").to_numpy()
        wide = t.column("wide").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(own), -1)
        sets = [c[k].values.to_numpy().view(np.uint64) for c in t.column("shingles").chunks for k in range(len(c))]
        sizes = np.array([len(x) for x in sets])
        order = np.lexsort((own, *reversed(keys)))
        ends = np.flatnonzero(np.any([np.diff(k[order]) != 0 for k in keys], axis=0)) + 1
        a, b = [], []
        for rows in np.split(order, ends):
            single, to = keys[2][rows[0]] == keys[3][rows[0]], np.arange(len(rows))
            for k, row in enumerate(rows[:-1]):
                rest = rows[k + 1 :]
                near = np.bitwise_count(wide[rest] ^ wide[row]).sum(axis=1, dtype=np.int64) <= wide_budget
                near &= np.minimum(sizes[rest], sizes[row]) / np.maximum(sizes[rest], sizes[row]) >= similarity
                if not single:
                    near &= own[rest] != own[row]
                for m in (np.flatnonzero(near) + k + 1).tolist():
                    if to[k] == to[m]:
                        continue
                    common = len(np.intersect1d(sets[row], sets[rows[m]], assume_unique=True))
                    if common / (sizes[row] + sizes[rows[m]] - common) >= similarity:
                        to[to == to[m]] = to[k]
                        a.append(values[row])
                        b.append(values[rows[m]])
        return np.array(a, np.int64), np.array(b, np.int64)

    return in_cells(cut, work)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component. Large-star and small-star until all links are to a root."""
    edges = restarted(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above"))
        least = restarted(least)
        if least.where("below > 1 or below = 1 and above > 0").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = restarted(large.where("u <> v").distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(spread(lower, "u"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        edges = restarted(small.distinct())


def classes(of: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """``of`` (doc_id, fp and more) with each row's ``component_id`` and ``root``; ``distinct`` has each fp's ``least`` id, ``links`` pairs of fp."""
    with tidy(of.sparkSession):
        roots = components(links)
    # The members of a component: its root, and what has that root.
    member = roots.union(roots.select("root", "root").distinct())
    named = member.join(distinct.select("fp", "least"), F.col("node") == F.col("fp")).select("node", "root", "least")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.select("node", "root").join(spread(least, "root"), "root").select(F.col("node").alias("fp"), "component", "root")
    final = distinct.join(named, "fp", "left").select(F.col("fp").alias("_key"), F.coalesce("component", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return of.join(spread(final, "_key"), F.col("fp") == F.col("_key")).drop("_key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, piece: int = PIECE, mean: int = MEAN) -> DataFrame:
    """Every row's ``doc_id``, ``fp`` (bigint) and ``component_id``: the smallest id that its links reach."""
    with tidy(docs.sparkSession):
        of = checkpointed(fingerprints(docs, id_col, text_col))
        distinct = checkpointed(of.groupBy("fp").agg(F.min("doc_id").alias("least")))
        links = trie_links(distinct, budget, piece, mean)
    return classes(of, distinct, links).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


# ---------------------------------------------------------------- classes by similarity

#: Words of 64 bits in a wide fingerprint; forests, and the minima that make one key of a trie.
WIDE = 16
BANDS = 16
MINIMA = 4
SIMILARITY = 0.8
SIMILAR_SHINGLE = 5
#: Standard deviations of room that candidates have in all bits, and in the first 64.
LOOSE = 9.0
LOOSE_LANE = 6.5
_STEP_HASHES = 1 << 18
#: Shingles that weigh as one node, where pieces of shingle sets are made.
SHINGLES = 1024


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of many independent hashes, made from one."""
    h = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bit_budget(bits: int, similarity: float = SIMILARITY, deviations: float = 2.0) -> int:
    """Differing bits that sets of this Jaccard similarity stay within, but for chance beyond so many standard deviations.

    Two sets of equal size and similarity s have the cosine 2s / (1 + s), and each bit differs with their angle over pi.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return round(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def words_hash(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(text.encode("utf-8", "replace").translate(_LOWER).split()) if text else b"")


def sketch_many(texts: list[str | None], shingle: int = SIMILAR_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For whole texts: a hash of the words (int64), trie keys (int64, n x BANDS) and wide fingerprints (uint64, n x WIDE)."""
    words = np.array([words_hash(t) for t in texts], np.uint64)
    keys, wide = np.zeros((len(texts), BANDS), np.uint64), np.zeros((len(texts), WIDE), np.uint64)
    sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
    sizes = np.array([len(h) for h in sets], np.int64)
    some = np.flatnonzero(sizes)
    group = np.cumsum(sizes[some]) // _STEP_HASHES
    for g in np.unique(group):
        rows = some[group == g]
        hashes, n = np.concatenate([sets[r] for r in rows]), sizes[rows]
        starts = np.cumsum(n) - n
        for k in range(WIDE):
            wide[rows, k] = votes(_mixed(hashes, k), n)
        for k in range(BANDS * MINIMA):
            keys[rows, k // MINIMA] = _mixed(keys[rows, k // MINIMA] ^ np.minimum.reduceat(_mixed(hashes, WIDE + k), starts), 0)
    return words.view(np.int64), keys.view(np.int64), wide


def differing(v: Column, w: Column) -> Column:
    """Bits that differ in two arrays of words."""
    return F.aggregate(F.zip_with(v, w, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What names a row: its id, and a hash of its text."""
    return F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th")


def confirmed(docs: DataFrame, id_col: str, text_col: str, distinct: DataFrame, roots: DataFrame, similarity: float, budget: int, piece: int = PIECE) -> DataFrame:
    """(a, b) bigint: links of the exact similarity within the components ``roots`` (node, root) of ``distinct`` (fp, least, th, wide)."""
    whole = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("wide", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            texts, node = b.column(3).to_pylist(), b.column(0).to_numpy()
            own = np.array([words_hash(t) for t in texts], np.uint64).view(np.int64) == node  # an id may have other texts, too
            at = np.flatnonzero(own)
            yield out(whole, {"node": node[at], "root": b.column(1).take(pa.array(at)), "wide": b.column(2).take(pa.array(at)), "shingles": [np.unique(shingle_hashes(texts[k], SIMILAR_SHINGLE)).view(np.int64) for k in at]})

    member = roots.union(roots.select("root", "root").distinct())
    member = member.join(distinct.select("fp", F.coalesce("least", "th").alias("at"), "wide"), F.col("node") == F.col("fp")).drop("fp")
    # A node's text is that of its row with the least id, so a text that many rows share is no hot key.
    doc_id, th = row_key(id_col, text_col)
    texts = docs.select(F.coalesce(doc_id, th).alias("_at"), F.col(text_col).alias("text")).join(spread(member, "at"), F.col("_at") == F.col("at")).select("node", "root", "wide", "text")
    sets = checkpointed(texts.mapInArrow(shingled, "node bigint, root bigint, wide array<bigint>, shingles array<bigint>").dropDuplicates(["node"]))
    dealt = sets.select(F.lit(0).alias("forest"), F.col("root").alias("trie"), "node", (1 + F.floor(F.size("shingles") / SHINGLES)).cast("int").alias("weight"))
    alike = lambda v, w: let(F.size(F.array_intersect(v, w)), lambda n: n / (F.size(v) + F.size(w) - n)) >= similarity
    cut, links = cells(dealt, sets.select("node", F.col("shingles").alias("value")), alike, piece)
    cut = cut.join(spread(sets.select(F.col("node").alias("_node"), "wide", "shingles"), "_node"), F.col("node") == F.col("_node")).drop("_node")
    found = confirmed_links(cut, similarity, budget)
    return found if links is None else found.union(links)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, piece: int = PIECE) -> DataFrame:
    """Every row's ``doc_id``, ``th`` (a hash of its text), ``fp`` (of its words) and ``component_id``, linked by a similarity of
    five-word shingles; ``root`` names its class, also where no row of it has an id.

    Fingerprints of 64 bits that differ by four can't tell a Jaccard similarity of 0.8 (about ten bits differ), and a
    radius of ten bits leaves a trie join nothing to prune by. So candidates come from wide fingerprints (1,024 bits, which
    tell the similarity within about 0.03) with a budget that is loose enough for the shortest texts (of four and five
    shingles 192 bits differ, five standard deviations below it). Forests are dealt by minima of hashed shingles, which two documents of a
    similarity of 0.8 share in one of 16 forests but for 2 cases in 10,000. In a trie, node pairs are walked as for
    ``near_duplicates``, over the first 64 bits; leaves are then compared by all bits. A pair is a candidate by the same
    bits whether it meets in a walk or one of it is a hub.

    The components of candidates are then compared anew, each by the exact similarity of its texts' shingle sets
    (``confirmed``), so that every link is one of the similarity or more.

    Rows of equal words (A-Z as a-z, any white space) are one node. No words, or a null text: one class of their own.
    Rows without an id get a class, too, but never name one. Repeated rows and repeated ids are kept; empty tables give no rows.
    """
    lane, budget = bit_budget(64, similarity, LOOSE_LANE), bit_budget(64 * WIDE, similarity, LOOSE)
    keys, words = [f"k{i}" for i in range(BANDS)], [f"w{i}" for i in range(WIDE)]
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "th", "fp", *keys, *words)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            fp, k, w = sketch_many(b.column(2).to_pylist())
            void = ~(k.any(1) | w.any(1))
            made = {"doc_id": b.column(0), "th": b.column(1), "fp": fp}
            made |= {c: pa.array(k[:, i], mask=void) for i, c in enumerate(keys)} | {c: w[:, i].view(np.int64) for i, c in enumerate(words)}
            yield out(schema, made)

    doc_id, th = row_key(id_col, text_col)
    with tidy(docs.sparkSession):
        of = checkpointed(docs.select(doc_id, th, F.col(text_col).alias("text")).mapInArrow(work, ", ".join(f"{f.name} bigint" for f in schema)))
        distinct = of.groupBy("fp").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in ("th", *keys, *words)])
        distinct = checkpointed(distinct.select("fp", "least", "th", F.when(F.col("k0").isNotNull(), F.array(*keys)).alias("keys"), F.col("w0").alias("bits"), F.array(*words).alias("wide")))
        dealt = distinct.select(F.col("fp").alias("node"), F.posexplode("keys").alias(*KEY), F.lit(1).alias("weight"))
        both = distinct.select(F.col("fp").alias("node"), F.struct("bits", "wide").alias("value"))
        near = lambda v, w: (F.bit_count(v["bits"].bitwiseXOR(w["bits"])) <= lane) & (differing(v["wide"], w["wide"]) <= budget)
        cut, links = cells(dealt, both, near, piece)
        with_bits = spread(distinct.select(F.col("fp").alias("_node"), F.col("bits").alias("fp"), "wide"), "_node")
        found = forest_links(cut.join(with_bits, F.col("node") == F.col("_node")).drop("_node"), lane, budget)
        roots = components(found if links is None else found.union(links))
        links = confirmed(docs, id_col, text_col, distinct, roots, similarity, budget, piece)
    return classes(of.select("doc_id", "th", "fp"), distinct, links)


def representatives(found: DataFrame) -> DataFrame:
    """(doc_id, th) of one row for each class of ``similar``: of those with the least id, the one with the least hash; without an id only if none has one."""
    return found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("x")).select("x.doc_id", "x.th")
