"""Mutual information of columns with a target by k nearest neighbours (Kraskov's first estimate), with no column in one task.

Rows of each (column, target) pair are points of a plane. The plane is cut into tiles of bounded rows, level by level, at
quantiles of one axis after the other. A task finds its tile's neighbours; only rows whose k-th neighbour so far is further
than the tile's border go on to the tiles within that distance. How many rows lie within the distance along each axis is
counted by sorting rows and ends of spans together over all partitions.

Points are whole numbers, so that distances are exact and nothing depends on the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cluster import checkpointed
from ..functions.scalar import is_finite

#: Rows of a tile that isn't cut further.
TILE = 16_384
#: Parts that a tile is cut into at once: six bits of a path.
WAYS, BITS = 64, 6
#: Axes to cut by: as given at first, so that rows of equal value stay together; where that is all they have, by their noise.
AXES = ("U", "W", "U", "W", "Y", "X", "Y", "X")
#: Beyond any distance.
FAR = 1 << 62
#: Pairs of rows that a task looks at in one step.
PAIRS = 1 << 20
NOISE = 1e-10


def nearest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """(k, rows): each row's distances (the larger of those in x and y) to its k nearest other rows, ascending; of whole or real numbers.

    Rows meet by their places' distance in the order of x, near ones first. A row is done when its next ones on both sides
    are as far in x alone as its k-th nearest so far. Takes memory of a few numbers a row. Fewer than k others leave ``FAR``.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    best = np.full((k, n), FAR, dtype=x.dtype)
    open_ = {side: np.arange(n) for side in (-1, 1)}
    for step in range(1, n):
        for side in (-1, 1):
            i = open_[side]
            i = i[(i + side * step >= 0) & (i + side * step < n)]
            j = i + side * step
            far = np.abs(x[i] - x[j])
            going = far < best[-1, i]
            open_[side] = i = i[going]
            d = np.maximum(far[going], np.abs(y[i] - y[j[going]]))
            nearer = d < best[-1, i]
            i, d = i[nearer], d[nearer]
            if len(i):
                best[:, i] = np.sort(np.vstack((best[:-1, i], d)), axis=0)
        if not len(open_[-1]) and not len(open_[1]):
            break
    found = np.empty_like(best)
    found[:, order] = best
    return found


def _within(s: np.ndarray, v: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many of the sorted s are within r[i] of v[i], by their difference: the sum v + r, rounded, may reach one more."""
    padded = np.concatenate(([-np.inf], s, [np.inf]))
    low, high = np.searchsorted(s, v - r, "left"), np.searchsorted(s, v + r, "right")
    while (off := padded[high] - v > r).any():
        high[off] -= 1
    while (off := padded[high + 1] - v <= r).any():
        high[off] += 1
    while (off := v - padded[low + 1] > r).any():
        low[off] += 1
    while (off := v - padded[low] <= r).any():
        low[off] -= 1
    return high - low


def neighbours_information(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 42) -> float:
    """The estimate for two arrays in memory, in real numbers."""
    n = len(x)
    if n <= k or np.ptp(x) == 0 or np.ptp(y) == 0:
        return 0.0
    rng = np.random.default_rng(seed)
    ties = len(np.unique(x)) < len(np.unique(y))  # rows meet in the order of the one with fewer
    x, y = x / x.std(), y / y.std()
    x = x + 1e-10 * max(1, np.abs(x).mean()) * rng.standard_normal(n)
    y = y + 1e-10 * max(1, np.abs(y).mean()) * rng.standard_normal(n)
    harmonic = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, n + 1))))
    psi = lambda m: harmonic[m - 1] - np.euler_gamma
    r = np.nextafter(nearest(*((y, x) if ties else (x, y)), k)[-1], 0)
    total = (psi(_within(np.sort(x), x, r)) + psi(_within(np.sort(y), y, r))).sum()
    return max(0.0, float(psi(np.array(n)) + psi(np.array(k)) - total / n))


def nearest_visited(visitors: pd.DataFrame, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(visitor, distance) of the at most k rows of a tile, x ascending, that are nearer to a visitor than its d."""
    vx, vy, d = (visitors[c].to_numpy() for c in ("X", "Y", "d"))
    low, high = np.searchsorted(x, vx - d, "right"), np.searchsorted(x, vx + d, "left")
    ends = np.cumsum(high - low)
    who, far, start = [], [], 0
    while start < len(vx):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        n = (high - low)[start:stop]
        v = np.repeat(np.arange(start, stop), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[v]
        apart = np.maximum(np.abs(x[at] - vx[v]), np.abs(y[at] - vy[v]))
        v, apart = v[apart < d[v]], apart[apart < d[v]]
        order = np.lexsort((apart, v))
        v, apart = v[order], apart[order]
        place = np.arange(len(v)) - np.searchsorted(v, v, "left")
        who.append(v[place < k])
        far.append(apart[place < k])
        start = stop
    return np.concatenate(who or [np.empty(0, int)]), np.concatenate(far or [np.empty(0, np.int64)])


def digamma(n: Column | float, log=math.log) -> Column | float:
    """psi of a positive whole number, to some 1e-12: stepped up by eight, then by its series."""
    m = n + 8.0
    s = 1.0 / (m * m)
    series = log(m) - 0.5 / m - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))
    for j in range(8):
        series = series - 1.0 / (n + float(j))
    return series


def _points(df: DataFrame, columns: Sequence[str], y: str, index: str, told: dict, todo: Sequence[int], seed: int) -> DataFrame:
    """(ordinal, i, U, W, X, Y, mx, my): x and y as whole numbers without (U, W) and with noise (X, Y), which moves them by mx and my at most."""
    noise = lambda r: NOISE * max(1.0, r["size"] / r["std"])
    most = lambda r: max(abs(r["low"]), abs(r["high"])) / r["std"]
    t = told[-1]
    of = [(j, told[j]["std"], noise(told[j]), 2.0 ** (60 - math.ceil(math.log2(max(most(told[j]), most(t)) + 1)))) for j in todo]
    params = df.sparkSession.createDataFrame(of, "ordinal int, std double, noise double, unit double")  # a row a column

    def gauss(part: Column) -> Column:
        u = [(F.shiftrightunsigned(F.xxhash64(F.lit(seed), part, F.col("i"), F.lit(j)), 11) + 1) / F.lit(2.0**53) for j in (0, 1)]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])  # below 8.6

    whole = lambda v: F.floor(v * F.col("unit")).cast("bigint")
    pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("ordinal"), F.col(columns[j]).cast("double").alias("x")) for j in todo])).alias("p")
    long = df.select(pairs, F.col(y).cast("double").alias("y"), F.col(index).alias("i")).select("p.ordinal", "p.x", "y", "i").join(F.broadcast(params), "ordinal")
    u, w = F.col("x") / F.col("std"), F.col("y") / F.lit(t["std"])
    return long.select(
        "ordinal", "i", whole(u).alias("U"), whole(w).alias("W"), whole(u + F.col("noise") * gauss(F.col("ordinal"))).alias("X"), whole(w + noise(t) * gauss(F.lit(-1))).alias("Y"),
        (whole(9 * F.col("noise")) + 2).alias("mx"), (whole(F.lit(9 * noise(t))) + 2).alias("my"))


NODE = ("ordinal", "path")


def _cut(rows: DataFrame, level: int, tile: int, least: int) -> DataFrame:
    """Tiles of more than ``tile`` rows in up to ``WAYS`` parts along this level's axis, of ``least`` rows each; rows know where other parts may begin."""
    axis = AXES[level]
    small = F.broadcast if level == 0 else (lambda d: d)  # at first a row, or WAYS rows, for each column
    wanted = F.ceil(F.col("n") / tile)
    ways = F.least(F.lit(WAYS), F.ceil(F.sqrt(wanted)) if level % 2 == 0 else wanted)
    taken = lambda q, j: F.floor((j + 1) * F.col("ways") / WAYS) > F.floor(j * F.col("ways") / WAYS)
    nodes = rows.groupBy(*NODE).agg(F.count("*").alias("n"), F.percentile_approx(axis, [j / WAYS for j in range(1, WAYS)], 1000).alias("q"))
    nodes = nodes.withColumn("ways", ways).select(*NODE, F.array_distinct(F.filter("q", taken)).alias("cuts"))
    placed = rows.join(small(nodes), [*NODE]).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col(axis)))).drop("cuts")
    # Parts of few rows (beside a value that very many rows share) join their neighbour.
    w = Window.partitionBy(*NODE).orderBy("part")
    big = F.when(F.col("n") >= least, F.col("part"))
    to = F.coalesce(F.last(big, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(big, True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(0))
    parts = placed.groupBy(*NODE, "part").agg(F.count("*").alias("n"), F.min(axis).alias("low"), F.max(axis).alias("high")).withColumn("to", to)
    by = Window.partitionBy(*NODE).orderBy("to")
    joined = parts.groupBy(*NODE, "to").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    joined = joined.select(*NODE, "to", F.lag("high").over(by).alias("before"), F.lead("low").over(by).alias("after"))
    placed = placed.join(small(parts.select(*NODE, "part", "to").join(joined, [*NODE, "to"])), [*NODE, "part"])
    low, high, room = ("x0", "x1", "mx") if axis in "UX" else ("y0", "y1", "my")
    room = F.col(room) if axis in "UW" else F.lit(0)
    placed = placed.withColumns({low: F.greatest(low, F.col("before") + room), high: F.least(high, F.col("after") - room), "path": F.shiftleft("path", BITS) + F.col("to")})
    return placed.select(*rows.columns)


def _distances(rows: DataFrame, k: int, tile: int) -> DataFrame:
    """(ordinal, i, X, Y, d): d is the distance to the k-th nearest other row of the column."""
    rows = checkpointed(rows.withColumns({"path": F.lit(0).cast("bigint"), **{c: F.lit(s * FAR).cast("bigint") for c, s in (("x0", -1), ("x1", 1), ("y0", -1), ("y1", 1))}}))
    levels = 0
    while levels < len(AXES) and rows.groupBy(*NODE).count().agg(F.max("count")).first()[0] > tile:
        rows = checkpointed(_cut(rows, levels, tile, max(k + 1, tile // 256)))
        levels += 1

    def within(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part["X"].to_numpy(), part["Y"].to_numpy()
        best = nearest(*((y, x) if part["U"].nunique() < part["W"].nunique() else (x, y)), k)
        d = best[-1]
        done = (x + d <= part["x1"]) & (x - d >= part["x0"]) & (y + d <= part["y1"]) & (y - d >= part["y0"])
        return part[["ordinal", "path", "i", "X", "Y"]].assign(d=d, best=[None if ok else b for ok, b in zip(done, best.T, strict=True)])

    kind = dict(rows.dtypes)["i"]
    leaf = rows.groupBy(*NODE).applyInPandas(within, f"ordinal int, path bigint, i {kind}, X bigint, Y bigint, d bigint, best array<bigint>")
    if not levels:
        return leaf.select("ordinal", "i", "X", "Y", "d")
    leaf = checkpointed(leaf)
    unsettled = leaf.where("best IS NOT NULL")
    edges = {"x0": F.min, "x1": F.max, "y0": F.min, "y1": F.max}
    boxes = leaf.groupBy(*NODE).agg(*[f(c[0].upper()).alias(c) for c, f in edges.items()])
    visits = unsettled.select("ordinal", "i", "X", "Y", "d", F.col("path").alias("home"), F.lit(0).cast("bigint").alias("path"))
    near = lambda b: F.greatest(b.x0 - F.col("X"), F.col("X") - b.x1, b.y0 - F.col("Y"), F.col("Y") - b.y1) < F.col("d")
    for depth in range(1, levels + 1):  # from the plane down to tiles, WAYS at most at a time
        at = boxes.groupBy("ordinal", F.shiftright("path", BITS * (levels - depth)).alias("at")).agg(*[f(c).alias(c) for c, f in edges.items()])
        kids = at.groupBy("ordinal", F.shiftright("at", BITS).alias("path")).agg(F.collect_list(F.struct("at", *edges)).alias("kids"))
        visits = visits.join(F.broadcast(kids) if depth == 1 else kids, [*NODE]).select("ordinal", "i", "X", "Y", "d", "home", F.explode(F.filter("kids", near)).alias("kid"))
        visits = visits.withColumn("path", F.col("kid.at")).drop("kid")

    def visited(mine: pd.DataFrame, tile_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"ordinal": [], "i": [], "far": []})
        tile_rows = tile_rows.sort_values("tile_X")
        who, far = nearest_visited(mine, tile_rows["tile_X"].to_numpy(), tile_rows["tile_Y"].to_numpy(), k)
        return mine[["ordinal", "i"]].iloc[who].assign(far=far)

    tiles = leaf.select(*[F.col(c).alias(f"tile_{c}") for c in (*NODE, "X", "Y")])
    met = visits.where("path <> home").groupBy(*NODE).cogroup(tiles.groupBy("tile_ordinal", "tile_path")).applyInPandas(visited, f"ordinal int, i {kind}, far bigint")
    met = met.unionByName(unsettled.select("ordinal", "i", F.explode("best").alias("far")))
    met = met.groupBy("ordinal", "i").agg(F.sort_array(F.collect_list("far"))[k - 1].alias("d"))  # k of each tile met
    settled = leaf.where("best IS NULL").select("ordinal", "i", "X", "Y", "d")
    return settled.unionByName(unsettled.drop("d").join(met, ["ordinal", "i"]).select("ordinal", "i", "X", "Y", "d"))


def _counts(spans: DataFrame) -> DataFrame:
    """(ordinal, i, n), twice a row: how many rows are nearer than d in X, and how many in Y; the row is one of them."""
    r = F.greatest(F.col("d") - 1, F.lit(0))
    marks = [F.struct((F.col("ordinal") * 2 + a).alias("line"), key.alias("key"), F.lit(kind).alias("kind")) for a, v in enumerate("XY") for key, kind in ((F.col(v), 0), (F.col(v) - r, -1), (F.col(v) + r, 1))]
    marks = spans.select("i", F.explode(F.array(*marks)).alias("m")).select("m.*", "i")
    order = ["line", "key", "kind", "i"]

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each end of a span with the rows of its line before it in this partition; at last, all rows of each line here (kind 0)."""
        part, totals = TaskContext.get().partitionId(), {}
        for b in batches:
            line, kind = b["line"].to_numpy(), b["kind"].to_numpy()
            seen = np.cumsum(kind == 0)
            starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(line)], strict=True):
                seen[s:e] += totals.get(line[s], 0) - (seen[s] - (kind[s] == 0))
                totals[line[s]] = int(seen[e - 1])
            yield b[["line", "kind", "i"]].assign(part=part, seen=seen)[kind != 0]
        yield pd.DataFrame({"line": list(totals), "kind": 0, "i": None, "part": part, "seen": list(totals.values())})

    ends = marks.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(passed, f"line int, kind int, i {dict(spans.dtypes)['i']}, part int, seen bigint")
    ends = checkpointed(ends)
    before = F.coalesce(F.sum("seen").over(Window.partitionBy("line").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ends.where("kind = 0").select("line", "part", before.alias("before"))  # as many rows as partitions and lines at most
    ends = ends.where("kind <> 0").join(F.broadcast(offsets), ["line", "part"])
    n = F.sum(F.col("kind") * (F.col("seen") + F.col("before")))
    return ends.groupBy("line", "i").agg(n.alias("n")).select(F.shiftright("line", 1).alias("ordinal"), "i", "n")


def scores(df: DataFrame, columns: Sequence[str], y: str, index: str, k: int = 3, seed: int = 42, tile: int = TILE) -> DataFrame:
    """(feature, ordinal, score) for each column; ``index`` tells rows apart. All rows count.

    Constant columns, a constant target and tables of at most k rows score 0; values that are null or not finite are an error.
    A row that is far from all others may have to look at many tiles; it takes k distances from each.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("ordinal"), F.col(c).cast("double").alias("x")) for j, c in ((-1, y), *enumerate(columns))])).alias("p")
    x = F.col("x")
    long = df.select(pairs).select("p.*").withColumn("odd", F.when(is_finite(x), 0).otherwise(1))
    stats = long.groupBy("ordinal").agg(F.count("*").alias("n"), F.sum("odd").alias("odd"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(F.abs(x)).alias("size"))
    told = {r["ordinal"]: r.asDict() for r in stats.collect()}  # a row a column
    if bad := [y if j < 0 else columns[j] for j, r in told.items() if r["odd"]]:
        raise ValueError(f"values of {sorted(bad)[:5]} are not finite")
    varied = lambda j: j in told and told[j]["n"] > k and told[j]["low"] < told[j]["high"] and told[j]["std"] > 0
    todo = [j for j in range(len(columns)) if varied(j)] if varied(-1) else []
    names = df.sparkSession.createDataFrame([(c, j) for j, c in enumerate(columns)], "feature string, ordinal int")
    if not todo:
        return names.withColumn("score", F.lit(0.0))
    n = told[-1]["n"]
    counts = _counts(_distances(_points(df, columns, y, index, told, todo, seed), k, tile))
    sums = counts.groupBy("ordinal").agg(F.sum(digamma(F.col("n").cast("double"), F.log)).alias("total"))
    score = F.greatest(F.lit(0.0), F.lit(digamma(n) + digamma(k)) - F.col("total") / n)
    return names.join(F.broadcast(sums), "ordinal", "left").select("feature", "ordinal", F.coalesce(score, F.lit(0.0)).alias("score"))
