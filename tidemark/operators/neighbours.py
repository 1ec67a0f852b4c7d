"""The k nearest rows of every row among all rows, and outlier factors from them, as joins of tables.

Equal rows are one point with a weight. A point asks for no more places than its own copies leave open, and no more neighbours than fill them:
one with enough copies asks nothing. Points are dealt to cells of a k-d tree, whose cuts come from a sample of
the points and only decide where a point lies. Each cell searches its own points; a point whose k-th distance reaches beyond its cell
then goes to the cells that its ball touches, nearest first and one a round with what it has found, as every cell shrinks the ball;
the few that still touch others after some rounds ask many at a time. The result is exact whatever the sample: a cell is left out only if its box is farther than the k-th distance found.

k-distances and densities are tables of one row a point and meet their neighbours in joins. No task holds more than one cell
and the points that ask it, in blocks; the driver holds the cuts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..staging import fits, staged

#: Points of a cell, about; cells at most; points of the sample for each cell.
CELL_POINTS, MOST_CELLS, SAMPLED = 100_000, 1 << 16, 20
#: Points of a leaf within a cell, distances worked on at a time, cells asked at once after the visits.
LEAF, BLOCK, ASKED = 128, 2_000_000, 8
#: Rounds in which a point visits one cell.
VISITS = 6
#: Added to the mean reach of copies, so that their density is finite.
TINY = 1e-10

#: A neighbour as bytes: squared distance, hash, number, weight. Lists of them travel as binary, which Spark passes on as it is.
NEIGHBOUR = np.dtype([("d", "<f8"), ("h", "<i8"), ("id", "<i8"), ("w", "<i8")])


class Tree(NamedTuple):
    """Cuts as arrays; a leaf has feature -1 and its cell's number in ``left``. Boxes are those of the cells."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray


def cells_of(sample: np.ndarray, cells: int) -> Tree:
    """Halves the sample along its widest dimension until there are about as many cells; points at a cut go left."""
    d = sample.shape[1]
    nodes: list[list[float]] = []
    boxes: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(sample, cells, np.full(d, -np.inf), np.full(d, np.inf), -1, 0)]
    while stack:
        rows, n, low, high, parent, side = stack.pop()
        if parent >= 0:
            nodes[parent][side] = len(nodes)
        f = int(np.argmax(rows.max(axis=0) - rows.min(axis=0))) if len(rows) > 1 else 0
        if n > 1 and len(rows) > 1 and rows[:, f].max() > rows[:, f].min():
            cut = float(np.partition(rows[:, f], len(rows) // 2)[len(rows) // 2])
            if cut == rows[:, f].max():  # many equal values: the largest below them
                cut = float(rows[:, f][rows[:, f] < cut].max())
            here = rows[:, f] <= cut
            inner, outer = high.copy(), low.copy()
            inner[f], outer[f] = cut, cut
            stack += [(rows[~here], n - n // 2, outer, high, len(nodes), 3), (rows[here], n // 2, low, inner, len(nodes), 2)]
            nodes.append([f, cut, 0, 0])
        else:
            nodes.append([-1, 0.0, len(boxes), 0])
            boxes.append((low, high))
    a = np.array(nodes)
    return Tree(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]))


def cell_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    while (inner := tree.feature[at] >= 0).any():
        here = x[np.arange(len(x)), np.maximum(tree.feature[at], 0)] <= tree.cut[at]
        at = np.where(inner, np.where(here, tree.left[at], tree.right[at]), at)
    return tree.left[at]


def gap(low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distance of points to boxes, pair by pair."""
    away = np.maximum(np.maximum(low - x, x - high), 0)
    return (away**2).sum(axis=-1)


def touched(tree: Tree, x: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, cell, squared distance) of all cells that the points' balls reach."""
    radius = np.sqrt(radius2) * (1 + 1e-12)
    points, cells = [], []
    stack = [(0, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        f = tree.feature[node]
        if f < 0:
            points.append(at)
            cells.append(np.full(len(at), tree.left[node]))
            continue
        v, r = x[at, f], radius[at]
        stack += [(int(tree.left[node]), at[v - r <= tree.cut[node]]), (int(tree.right[node]), at[v + r >= tree.cut[node]])]
    p = np.concatenate(points) if points else np.zeros(0, int)
    c = np.concatenate(cells) if cells else np.zeros(0, int)
    g = gap(tree.low[c], tree.high[c], x[p])
    near = g <= radius2[p] * (1 + 1e-12)
    return p[near], c[near], g[near]


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared, by differences, so that a pair has the same distance wherever it is computed."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        t = q[:, j, None] - x[None, :, j]
        t *= t
        out += t
    return out


class Points:
    """Points of one cell in leaves of their own k-d tree."""

    def __init__(self, x: np.ndarray, h: np.ndarray, ids: np.ndarray):
        self.tree = cells_of(x, len(x) // LEAF + 1) if len(x) else None
        leaf = cell_of(self.tree, x) if len(x) else np.zeros(0, int)
        self.order = np.argsort(leaf, kind="stable")
        self.x, self.h, self.ids = x[self.order], h[self.order], ids[self.order]
        inner = np.flatnonzero(np.diff(leaf[self.order])) + 1
        self.starts = np.concatenate([[0], inner, [len(x)]]).astype(int)
        self.low = np.minimum.reduceat(self.x, self.starts[:-1]) if len(x) else x
        self.high = np.maximum.reduceat(self.x, self.starts[:-1]) if len(x) else x

    def nearest(self, q: np.ndarray, radius2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The up to k nearest points within each query's radius: (query, place in this cell's order, squared distance), sorted by
        query, distance, h, id."""
        out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if len(self.x) == 0 or len(q) == 0:
            return out[0]
        leaf = cell_of(self.tree, q)
        by_leaf = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
        for block in np.split(by_leaf, cuts):
            for s in range(0, len(block), LEAF):
                out.append(self._block(q, block[s : s + LEAF], radius2, k))
        who, at, d = (np.concatenate(c) for c in zip(*out, strict=True))
        return who, at, d

    def _block(self, q: np.ndarray, block: np.ndarray, radius2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine, r = q[block], radius2[block].copy()
        low, high = mine.min(axis=0), mine.max(axis=0)
        away = (np.maximum(np.maximum(self.low - high, low - self.high), 0) ** 2).sum(axis=1)
        first = np.argsort(away, kind="stable")[: k // LEAF + 3]
        place = np.concatenate([np.arange(self.starts[f], self.starts[f + 1]) for f in first])
        d = distances(mine, self.x[place])
        if len(place) >= k:
            r = np.minimum(r, np.partition(d, k - 1, axis=1)[:, k - 1])
        far = r.max()
        more = np.setdiff1d(np.flatnonzero(away <= far), first)
        if len(more):
            more = np.concatenate([np.arange(self.starts[f], self.starts[f + 1]) for f in more])
            more = more[gap(low, high, self.x[more]) <= far]
        whos, places, ds = [], [], []
        step = max(1, BLOCK // (len(place) + len(more)))
        both = np.concatenate([place, more.astype(int)])
        for s in range(0, len(block), step):
            e = d[s : s + step]
            if len(more):
                e = np.concatenate([e, distances(mine[s : s + step], self.x[more])], axis=1)
            bound = r[s : s + step]
            if e.shape[1] > k:
                bound = np.minimum(bound, np.partition(e, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero(e <= bound[:, None])
            whos.append(i + s)
            places.append(both[j])
            ds.append(e[i, j])
        who, at, dist = np.concatenate(whos), np.concatenate(places), np.concatenate(ds)
        order = np.lexsort((self.ids[at], self.h[at], dist, who))
        who, at, dist = who[order], at[order], dist[order]
        start = np.searchsorted(who, who)
        kept = np.arange(len(who)) - start < k  # of more points at the k-th distance those of the smallest hash
        return block[who[kept]], at[kept], dist[kept]


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _open(w: np.ndarray, k: int) -> np.ndarray:
    """Of each point's k places, those that its own copies leave open."""
    return k - np.minimum(w - 1, k)


def _listed(places: np.ndarray, who: np.ndarray, d: np.ndarray, h: np.ndarray, ids: np.ndarray, w: np.ndarray, k: int) -> pa.Array:
    """The nearest of each point that fill its open places, as bytes; of equal distances the smaller hash comes first."""
    n = len(places)
    order = np.lexsort((ids, h, d, who))
    first = np.searchsorted(who[order], who[order])
    taken = np.minimum(w[order], k)
    before = np.cumsum(taken) - taken
    order = order[before - before[first] < places[who[order]]]
    values = np.empty(len(order), NEIGHBOUR)
    values["d"], values["h"], values["id"], values["w"] = d[order], h[order], ids[order], w[order]
    offsets = (np.searchsorted(who[order], np.arange(n + 1)) * NEIGHBOUR.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _unlisted(found: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All neighbours in a row, and how many each point has."""
    blobs = found.to_pylist()
    return np.frombuffer(b"".join(blobs), NEIGHBOUR), np.array([len(b) // NEIGHBOUR.itemsize for b in blobs], int)


def _reached(found: np.ndarray, sizes: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Squared distance of the neighbour that fills the last open place; infinite as long as none does."""
    last = np.cumsum(sizes)
    total = np.append(0, np.cumsum(np.minimum(found["w"], k)))
    full = (total[last] - total[last - sizes] >= places) & (sizes > 0)
    return np.where(full, found["d"][np.maximum(last - 1, 0)] if len(found) else 0.0, np.inf)


def nearest_neighbours(points: DataFrame, d: int, k: int, *, cell_points: int = CELL_POINTS) -> DataFrame:
    """id, w, found: for each of ``points`` (id, h, x, w: number, hash, coordinates, weight) its nearest others that with its copies make
    k rows, all if there are fewer, as NEIGHBOUR bytes by rising distance; of equal distances the smaller hash comes first."""
    spark = points.sparkSession
    n = points.count()
    cells = min(MOST_CELLS, max(n // cell_points, min(spark.sparkContext.defaultParallelism, 5 * n // cell_points)) + 1)  # fewer have shorter borders
    share = min(1.0, SAMPLED * cells / max(n, 1) * 4)
    some = points if share == 1 else points.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = some.select("x").toPandas()["x"].tolist()[: 8 * SAMPLED * cells] if cells > 1 else []  # decides where cells are cut, nothing else
    tree = cells_of(np.array(rows, float).reshape(-1, d) if rows else np.zeros((1, d)), cells)
    shared = spark.sparkContext.broadcast(tree)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell_of(shared.value, _matrix(b.column("x"), d)), pa.int32())], names=[*b.schema.names, "cell"])

    at_cells = staged(points.select("id", "h", "x", "w").mapInArrow(dealt, "id long, h long, x array<double>, w long, cell int"), "points")

    def own(table: pa.Table) -> pa.Table:
        x, h, ids, w = _matrix(table.column("x"), d), *(table.column(c).to_numpy() for c in ("h", "id", "w"))
        here = Points(x, h, ids)
        w = w[here.order]
        places = _open(w, k)
        asks = np.flatnonzero(places > 0)
        who, at, dist = here.nearest(here.x[asks], np.full(len(asks), np.inf), k + 1)
        who = asks[who]
        other = here.ids[at] != here.ids[who]  # a point is no neighbour of itself
        who, at, dist = who[other], at[other], dist[other]
        made = {"id": here.ids, "w": w, "x": table.column("x").take(pa.array(here.order)), "cell": table.column("cell").take(pa.array(here.order)), "found": _listed(places, who, dist, here.h[at], here.ids[at], w[at], k)}
        return pa.table({**made, "asked_d": np.full(len(x), -1.0), "asked_cell": np.full(len(x), -1, np.int32)})

    state_schema = f"id long, w long, x array<double>, cell int, found binary, asked_d double, asked_cell int"
    tasks = min(4 * cells, 8192)  # few and small cells would else be put together in one task
    at_cells = at_cells.repartition(tasks, "cell")
    state = at_cells.groupBy("cell").applyInArrow(own, state_schema)

    def touching(b: pa.RecordBatch, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Points of a batch and the next cells that their balls touch, at most so many each, with their distances; all balls."""
        x, cell = _matrix(b.column("x"), d), b.column("cell").to_numpy()
        found, sizes = _unlisted(b.column("found"))
        places = _open(b.column("w").to_numpy(), k)
        radius2 = _reached(found, sizes, places, k)
        asks = np.flatnonzero(places > 0)
        p, c, g = touched(shared.value, x[asks], radius2[asks])
        p = asks[p]
        asked_d, asked_cell = b.column("asked_d").to_numpy()[p], b.column("asked_cell").to_numpy()[p]
        new = (c != cell[p]) & ((g > asked_d) | (g == asked_d) & (c > asked_cell))
        p, c, g = p[new], c[new], g[new]
        order = np.lexsort((c, g, p))
        p, c, g = p[order], c[order], g[order]
        kept = np.arange(len(p)) - np.searchsorted(p, p) < most
        return p[kept], c[kept], g[kept], radius2

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                b = whole.slice(s, 4096)
                p, c, g, radius2 = touching(b, 1)
                to, away = np.full(b.num_rows, -1, np.int32), b.column("asked_d").to_numpy().copy()
                to[p], away[p] = c, g
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("id", "w", "x", "cell", "found")), pa.array(away), pa.array(to), pa.array(radius2)], names=["id", "w", "x", "cell", "found", "asked_d", "visit", "radius2"])

    def visited(cell: pa.Table, guests: pa.Table) -> pa.Table:
        """The guests with what this cell adds to their neighbours."""
        names = ["id", "w", "x", "cell", "found", "asked_d", "asked_cell"]
        if guests.num_rows == 0 or cell.num_rows == 0:
            return guests.rename_columns([*names, "radius2"]).select(names)
        here = Points(_matrix(cell.column("x"), d), cell.column("h").to_numpy(), cell.column("id").to_numpy())
        w = cell.column("w").to_numpy()[here.order]
        who, at, dist = here.nearest(_matrix(guests.column("x"), d), guests.column("radius2").to_numpy(), k)
        found, sizes = _unlisted(guests.column("found"))
        who = np.concatenate([np.repeat(np.arange(guests.num_rows), sizes), who])
        new = [np.concatenate(c) for c in ((found["d"], dist), (found["h"], here.h[at]), (found["id"], here.ids[at]), (found["w"], w[at]))]
        columns = [guests.column(n) for n in ("id", "w", "x", "cell")]
        return pa.table([*columns, _listed(_open(guests.column("w").to_numpy(), k), who, *new, k), guests.column("asked_d"), guests.column("visit")], names=names)

    def questions(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for s in range(0, whole.num_rows, 4096):
                    b = whole.slice(s, 4096)
                    p, c, g, radius2 = touching(b, most)
                    take = pa.array(p)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("w").take(take), b.column("x").take(take), pa.array(radius2[p]), pa.array(c, pa.int32()), pa.array(g)], names=["id", "w", "x", "radius2", "cell", "g"])

        return run

    def answers(cell: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["id", "found", "asked_d", "asked_cell"]
        if asking.num_rows == 0 or cell.num_rows == 0:
            n = asking.num_rows
            return pa.table([asking.column("id") if n else pa.array([], pa.int64()), pa.array([b""] * n, pa.binary()), asking.column("g") if n else pa.array([], pa.float64()), asking.column("cell") if n else pa.array([], pa.int32())], names=names)
        here = Points(_matrix(cell.column("x"), d), cell.column("h").to_numpy(), cell.column("id").to_numpy())
        w = cell.column("w").to_numpy()[here.order]
        who, at, dist = here.nearest(_matrix(asking.column("x"), d), asking.column("radius2").to_numpy(), k)
        return pa.table([asking.column("id"), _listed(_open(asking.column("w").to_numpy(), k), who, dist, here.h[at], here.ids[at], w[at], k), asking.column("g"), asking.column("cell")], names=names)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sizes = _unlisted(pa.array([b"".join(lists) for lists in b.column("lists").to_pylist()], pa.binary()))
            made = _listed(_open(b.column("w").to_numpy(), k), np.repeat(np.arange(b.num_rows), sizes), *(found[c] for c in ("d", "h", "id", "w")), k)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("id", "w", "x", "cell")), made, b.column("asked_d"), b.column("asked_cell")], names=["id", "w", "x", "cell", "found", "asked_d", "asked_cell"])

    done, most, turn, left = [], ASKED, 0, True
    for visit in range(VISITS):
        going = staged(state.mapInArrow(visits, f"id long, w long, x array<double>, cell int, found binary, asked_d double, visit int, radius2 double"), f"visits-{visit}")
        done.append(going.where("visit < 0"))
        guests = going.where("visit >= 0")
        if not (left := not guests.isEmpty()):
            break
        state = at_cells.groupBy("cell").cogroup(guests.repartition(tasks, "visit").groupBy("visit")).applyInArrow(visited, state_schema)
    if left:
        state = staged(state, "visited")
    while left:
        asked = staged(state.mapInArrow(questions(most), "id long, w long, x array<double>, radius2 double, cell int, g double"), f"questions-{turn}")
        if asked.isEmpty():
            done.append(state)
            break
        who = asked.select(F.col("id").alias("q")).distinct()
        done.append(state.join(who, state["id"] == who["q"], "left_anti"))
        got = at_cells.groupBy("cell").cogroup(asked.repartition(tasks, "cell").groupBy("cell")).applyInArrow(answers, f"id long, found binary, asked_d double, asked_cell int")
        both = state.join(who, state["id"] == who["q"], "left_semi").select("*").unionByName(got, allowMissingColumns=True)
        last = F.max(F.struct("asked_d", "asked_cell"))
        merged = both.groupBy("id").agg(F.max("w").alias("w"), F.max("x").alias("x"), F.max("cell").alias("cell"), F.collect_list("found").alias("lists"), last.alias("last"))
        turn, most = turn + 1, min(most * 4, 512)
        merged = merged.select("id", "w", "x", "cell", "lists", F.col("last.asked_d").alias("asked_d"), F.col("last.asked_cell").alias("asked_cell"))
        state = staged(merged.mapInArrow(together, state_schema), f"neighbours-{turn}")
    out = done[0].select("id", "w", "found")
    for more in done[1:]:
        out = out.unionAll(more.select("id", "w", "found"))
    return out


def _edges(k: int):
    """Each point's neighbours with how many of its k places each takes; copies of the point come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, w = b.column("id").to_numpy(), b.column("w").to_numpy()
            found, sizes = _unlisted(b.column("found"))
            dist, other, weight = (found[c] for c in ("d", "id", "w"))
            who = np.repeat(np.arange(len(ids)), sizes)
            copies = np.minimum(w - 1, k)
            total = np.cumsum(np.minimum(weight, k)) if len(weight) else np.zeros(0, np.int64)
            starts = np.cumsum(sizes) - sizes
            before = total - np.minimum(weight, k)
            before = before - np.repeat(np.append(before, 0)[np.minimum(starts, len(before))], sizes) + copies[who]
            take = np.clip(k - before, 0, np.minimum(weight, k))
            used = take > 0
            who, other, dist, take = who[used], other[used], np.sqrt(dist[used]), take[used]
            reach = np.zeros(len(ids))
            np.maximum.at(reach, who, dist)
            places = copies + np.bincount(who, take, len(ids)).astype(np.int64)
            everyone = np.concatenate([np.arange(len(ids)), who])  # a row for the point itself carries its copies
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[everyone]), pa.array(np.concatenate([ids, other])), pa.array(np.concatenate([np.zeros(len(ids)), dist])), pa.array(np.concatenate([copies, take])), pa.array(reach[everyone]), pa.array(places[everyone])],
                names=["id", "other", "d", "take", "reach", "places"],
            )

    return run


def outlier_factors(points: DataFrame, d: int, k: int, *, cell_points: int = CELL_POINTS) -> DataFrame:
    """id, factor: how much denser a point's k nearest rows are than the row itself. Copies of a row are neighbours of it; a
    table of one row has the factor 1."""
    ship(points.sparkSession)
    near = nearest_neighbours(points, d, k, cell_points=cell_points)
    edges = staged(near.mapInArrow(_edges(k), "id long, other long, d double, take long, reach double, places long"), "edges")
    reach = staged(edges.where("id = other").select(F.col("id").alias("q"), F.col("reach").alias("far")), "reach")
    side = F.broadcast(reach) if fits(reach) else reach
    density = edges.join(side, edges["other"] == side["q"]).groupBy("id").agg((F.sum(F.col("take") * F.greatest("d", "far")) / F.nullif(F.max("places"), F.lit(0))).alias("mean"))
    density = staged(density.select(F.col("id").alias("q"), (1 / (F.coalesce("mean", F.lit(0.0)) + TINY)).alias("density")), "density")
    side = F.broadcast(density) if fits(density) else density
    own = F.max(F.when(F.col("id") == F.col("other"), F.col("density")))
    mean = F.sum(F.col("take") * F.col("density")) / F.nullif(F.max("places"), F.lit(0))
    return edges.join(side, edges["other"] == side["q"]).groupBy("id").agg(F.coalesce(mean / own, F.lit(1.0)).alias("factor"))


def weighted_points(rows: DataFrame, vector: str, weight: str | None = None) -> DataFrame:
    """id, h, x, w: the distinct vectors of ``rows``, numbered, with how many rows have each; ``weight`` is how many a row stands for."""
    made = rows.groupBy(F.col(vector).alias("x")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("w"))
    return staged(made.select(F.monotonically_increasing_id().alias("id"), F.xxhash64("x").alias("h"), "x", "w"), "weighted")


def brute_factors(x: np.ndarray, k: int) -> np.ndarray:
    """The same from all pairs; for tests of small tables without ties."""
    n = len(x)
    k = min(k, n - 1)
    dist = np.sqrt(distances(x, x))
    dist[np.arange(n), np.arange(n)] = math.inf
    near = np.argsort(dist, axis=1, kind="stable")[:, :k]
    far = np.take_along_axis(dist, near, 1).max(axis=1)
    density = 1 / (np.maximum(np.take_along_axis(dist, near, 1), far[near]).mean(axis=1) + TINY)
    return density[near].mean(axis=1) / density
