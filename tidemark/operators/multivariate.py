"""Multivariate outliers: rows that both an isolation forest and a local outlier factor find odd.

Trees are grown from samples of the whole table, as isolation forests are defined (``sample`` rows a tree, each tree its own).
The neighbours of a row are sought among all rows (see neighbours.py). Every row is scored, and the cut-offs are quantiles over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, finite, numeric_columns
from ..shipping import ship
from ..staging import fits, staged
from .neighbours import outlier_factors, weighted_points
from .ordered import own_names
from .quantiles import exact_quantiles

TREES, SAMPLE, NEIGHBOURS = 100, 256, 20


def _path(n: float) -> float:
    """Mean depth of an unsuccessful search among n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grown(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, ...]:
    """One isolation tree as arrays: feature (-1 for a leaf), cut, left, right, value (depth plus the mean rest)."""
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, level + _path(len(rows))])
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if level < depth and len(spread):
            f = int(rng.choice(spread))
            cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
            left = rows[:, f] < cut
            nodes[at][:4] = [f, cut, grow(rows[left], level + 1), grow(rows[~left], level + 1)]
        return at

    grow(x, 0)
    a = np.array(nodes)
    return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]


def isolation(x: np.ndarray, trees: list[tuple[np.ndarray, ...]], sample: int) -> np.ndarray:
    total = np.zeros(len(x))
    for feature, cut, left, right, value in trees:
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            go = x[np.arange(len(x)), np.maximum(feature[at], 0)] < cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        total += value[at]
    return 2.0 ** (-total / len(trees) / max(_path(sample), 1e-9))


def drawn(points: DataFrame, rows: int, wanted: int, seed: int) -> np.ndarray:
    """About ``wanted`` of the rows behind weighted points: a point gives its share of them, rounded up or down by a hash of it, so copies come
    as often as they should and reruns draw the same."""
    share = min(1.0, wanted / rows)
    chance = F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    some = points.withColumn("n", F.floor(F.col("w") * share + chance).cast("int")).where("n > 0")
    got = some.orderBy("h", "x").select("x", "n").toPandas()
    return np.repeat(np.array(got["x"].tolist(), float), got["n"].to_numpy(), axis=0)


def multivariate_outliers(df: DataFrame, columns: list[str] | None = None, *, contamination: float = 0.05, min_columns: int = 2, trees: int = TREES, sample: int = SAMPLE, neighbours: int = NEIGHBOURS, seed: int = 42, only: bool = False) -> DataFrame:
    """All rows, or ``only`` the outliers, then tm_isolation, tm_lof and tm_outlier. Columns with less than half their values, and tables with fewer than
    ``min_columns`` others, take no part; missing values take the median; features are scaled to unit (population) deviation.
    Equal rows have equal scores; they are one point of the search and neighbours of each other. All rows meet their scores in a shuffle if there are
    many different ones; the outliers' scores are few, so ``only`` they are looked up as the rows are read."""
    ship(df.sparkSession)
    columns = columns or numeric_columns(df)
    stats = df.agg(F.count(F.lit(1)).alias("n"), *(f(finite(df, c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("a", F.avg), ("s", F.stddev_pop)))).first()
    used = [(i, c) for i, c in enumerate(columns) if stats["n"] and stats[f"n{i}"] >= int(0.5 * stats["n"]) and stats[f"n{i}"]]
    if len(used) < min_columns or stats["n"] < 3:
        none = df.withColumns({"tm_isolation": F.lit(None).cast("double"), "tm_lof": F.lit(None).cast("double"), "tm_outlier": F.lit(False)})
        return none.where("tm_outlier") if only else none
    made = own_names(df)
    vector, d, n = made("x"), len(used), stats["n"]
    median = exact_quantiles(df, gaps := {c: finite(df, c) for i, c in used if stats[f"n{i}"] < n}, dict.fromkeys(gaps, [0.5]))
    filled = {f"v{i}": F.coalesce(finite(df, c), F.lit(median[c][0])) if c in gaps else finite(df, c) for i, c in used}
    scaled = lambda values: F.array(*((v - stats[f"a{i}"]) / (stats[f"s{i}"] or 1.0) for (i, _), v in zip(used, values, strict=True)))
    wide = df.withColumn(vector, scaled(filled.values()))
    told = df.select(*(v.alias(k) for k, v in filled.items())).groupBy(*filled).agg(F.count(F.lit(1)).alias("w"))  # values as given shuffle in fewer bytes
    points = weighted_points(told.select(scaled(map(F.col, filled)).alias("x"), "w"), "x", "w")
    rows = drawn(points, n, trees * sample, seed)
    rng = np.random.default_rng(seed)
    size = min(sample, len(rows))
    order = rng.permutation(len(rows))
    own = [order[t * size : (t + 1) * size] if (t + 1) * size <= len(rows) else rng.choice(len(rows), size, replace=False) for t in range(trees)]
    forest = [grown(rows[at], rng, math.ceil(math.log2(max(size, 2)))) for at in own]
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            made = [isolation(x[s : s + 8192], shared.value, size) for s in range(0, len(x), 8192)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(made) if made else np.zeros(0))], names=["id", "w", "x", "isolation"])

    scored = points.select("id", "w", "x").mapInArrow(score, "id long, w long, x array<double>, isolation double")
    scored = staged(scored.join(outlier_factors(points, d, min(neighbours, n - 1)), "id"), "scored")
    cuts = exact_quantiles(scored, {c: F.col(c) for c in ("isolation", "factor")}, dict.fromkeys(("isolation", "factor"), [1 - contamination]), F.col("w"))
    names = {k: made(k) for k in ("isolation", "factor", "key")}
    odd = lambda isolation, factor: (F.col(isolation) > cuts["isolation"][0]) & (F.col(factor) > cuts["factor"][0])
    side = scored.where(odd("isolation", "factor")) if only else scored
    side = side.select(F.col("x").alias(names["key"]), F.col("isolation").alias(names["isolation"]), F.col("factor").alias(names["factor"]))
    out = wide.join(F.broadcast(side) if fits(side, 40 + 8 * d) else side, F.col(vector) == F.col(names["key"]))
    return out.select(*map(col, df.columns), F.col(names["isolation"]).alias("tm_isolation"), F.col(names["factor"]).alias("tm_lof"), odd(names["isolation"], names["factor"]).alias("tm_outlier"))


def anomaly_multivariate(df: DataFrame, **how) -> DataFrame:
    """The finding: column '*', severity by the share of rows that both detectors flag; none if there are none."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    row = multivariate_outliers(df, only=True, **how).agg(F.count(F.lit(1)).alias("m")).where("m > 0").crossJoin(n)
    rate = F.col("m") / F.col("n")
    level = F.when(rate > 0.1, "critical").when(rate > 0.05, "high").otherwise("medium")
    return row.select(F.lit("*").alias("column"), F.lit("multivariate_outlier").alias("anomaly_type"), level.alias("severity"), F.col("m").alias("affected_rows"), F.round(rate, 4).alias("affected_rate"))
