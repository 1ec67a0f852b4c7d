"""Exact quantiles of columns of any number of distinct values, by counting ranges of values.

A sketch names, for each wanted rank, two values it lies between; the second pass counts exactly what is below and between
them; the third writes the few values between, with their counts. All columns and ranks share the passes, so the table is read three
times however many there are. What lies between is narrowed by splitters as long as it is too much for one row set,
each time counted exactly, so the sketch's accuracy decides only how soon it ends. Nothing holds all distinct values of a column, but for
tables of up to a million rows, which one aggregate does.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged

#: Accuracy of the sketch, and how far from a rank its bounds are taken.
ACCURACY, MARGIN = 10_000, 2e-4
#: Rows of a table whose distinct values may be held by an aggregate.
SMALL_ROWS = 1_000_000
#: Distinct values that may be looked at together, and parts that more are cut into.
TOGETHER, PARTS = 20_000, 64


def derived(df: DataFrame) -> bool:
    """Whether rows come from a shuffle, not from a scan alone."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(word in plan for word in ("Aggregate", "Join", "Window", "Repartition", "Generate", "Sort", "Deduplicate"))


def exact_quantiles(df: DataFrame, values: dict[str, Column], wanted: dict[str, list[float]], weight: Column | None = None) -> dict[str, list[float | None]]:
    """For each name its quantiles, interpolated between the two nearest ranks as ``percentile`` does. Values are doubles; nulls do not
    count, and a name without values has None. ``weight``, whole numbers above 0, says how often a row counts."""
    w = F.lit(1) if weight is None else weight
    names = list(values)
    if not names:
        return {}
    if derived(df):  # read from three times: its values are written rather than made three times
        own = {c: f"v{k}" for k, c in enumerate(names)}
        df = staged(df.select(*(values[c].cast("double").alias(o) for c, o in own.items()), w.cast("long").alias("w")), "quantile-values")
        values, w = {c: F.col(o) for c, o in own.items()}, F.col("w")
    v = {c: values[c].cast("double") for c in names}
    if df.count() <= SMALL_ROWS:
        whole = df.agg(*(F.percentile(v[c], F.array(*map(F.lit, wanted[c])), w).alias(f"q{k}") for k, c in enumerate(names))).first()
        return {c: list(whole[f"q{k}"]) if whole[f"q{k}"] is not None else [None] * len(wanted[c]) for k, c in enumerate(names)}
    bounds = {c: [min(1.0, max(0.0, p + s)) for p in wanted[c] for s in (-MARGIN, MARGIN)] for c in names}
    first = []
    for k, c in enumerate(names):
        first += [F.sum(F.when(v[c].isNotNull(), w)).alias(f"n{k}"), F.min(v[c]).alias(f"l{k}"), F.max(v[c]).alias(f"h{k}"), F.percentile_approx(v[c], F.array(*map(F.lit, bounds[c])), ACCURACY).alias(f"s{k}")]
    row = df.agg(*first).first()
    ranges = []  # (name, number of the quantile, rank, low, high)
    for k, c in enumerate(names):
        for q, p in enumerate(wanted[c]):
            if row[f"n{k}"]:
                ranges.append((c, q, p * (row[f"n{k}"] - 1), row[f"s{k}"][2 * q], row[f"s{k}"][2 * q + 1]))
    out: dict[str, list[float | None]] = {c: [None] * len(wanted[c]) for c in names}
    if not ranges:
        return out
    sums = [F.coalesce(F.sum(F.when(test, w)), F.lit(0)).alias(f"{side}{i}") for i, (c, _, _, lo, hi) in enumerate(ranges) for side, test in (("b", v[c] < lo), ("u", v[c] <= hi))]
    got = df.agg(*sums).first()
    inside = []  # (low, high, below, whole ranks)
    for i, (c, q, at, lo, hi) in enumerate(ranges):
        below, upto = got[f"b{i}"], got[f"u{i}"]
        if not below <= math.floor(at) <= math.ceil(at) < upto:  # beyond the sketch: all values
            k = names.index(c)
            lo, hi, below = row[f"l{k}"], row[f"h{k}"], 0
        inside.append((lo, hi, below, at))
    single = {i for i, (lo, hi, _, _) in enumerate(inside) if lo == hi}
    for i in single:
        out[ranges[i][0]][ranges[i][1]] = inside[i][0]
    rest = [i for i in range(len(ranges)) if i not in single]
    if not rest:
        return out
    within = {i: v[ranges[i][0]].between(inside[i][0], inside[i][1]) for i in rest}
    hits = F.array(*(F.when(test, F.struct(F.lit(i).alias("i"), v[ranges[i][0]].alias("v"), w.cast("long").alias("w"))) for i, test in within.items()))
    few = df.where(reduce(or_, within.values()))  # most rows end here
    few = few.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.v").agg(F.sum("x.w").alias("w"))
    few = staged(few, "between-ranks")
    below = {i: inside[i][2] for i in rest}
    kept: dict[int, tuple[float, float]] = {i: (inside[i][0], inside[i][1]) for i in rest}
    while True:
        size = {r["i"]: r["n"] for r in few.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
        many = [i for i in kept if size.get(i, 0) > TOGETHER]
        if not many:
            break
        few, below, kept = _narrowed(few, {i: inside[i][3] for i in kept}, below, kept, set(many))
    found: dict[int, list[tuple[float, int]]] = {i: [] for i in rest}
    for r in few.orderBy("i", "v").toLocalIterator():
        if r["i"] in found:
            found[r["i"]].append((r["v"], r["w"]))
    for i in rest:
        at, seen = inside[i][3], below[i]
        ends = []
        for rank in (math.floor(at), math.ceil(at)):
            n = seen
            for value, times in found[i]:
                n += times
                if rank < n:
                    ends.append(value)
                    break
        share = at - math.floor(at)
        out[ranges[i][0]][ranges[i][1]] = ends[0] + (ends[1] - ends[0]) * share
    return out


def _narrowed(few: DataFrame, ranks: dict[int, float], below: dict[int, int], kept: dict[int, tuple[float, float]], many: set[int]) -> tuple[DataFrame, dict[int, int], dict[int, tuple[float, float]]]:
    """Keeps, of the ranges with many values, the parts that hold their rank; parts are counted exactly."""
    steps = [k / PARTS for k in range(1, PARTS)]
    cuts = {r["i"]: sorted(set(r["s"])) for r in few.where(F.col("i").isin(list(many))).groupBy("i").agg(F.percentile_approx("v", F.array(*map(F.lit, steps)), 2000).alias("s")).collect()}
    side = few.sparkSession.createDataFrame([(i, s) for i, s in cuts.items()], "i int, s array<double>")
    parted = few.join(F.broadcast(side), "i").withColumn("part", F.size(F.filter("s", lambda x: x < F.col("v"))))
    counts: dict[int, list] = {}
    for r in parted.groupBy("i", "part").agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "part").collect():
        counts.setdefault(r["i"], []).append(r)
    keep, below, kept = F.lit(False), dict(below), dict(kept)
    for i in kept:
        if i in many:
            n, lo = below[i], None
            for r in counts[i]:
                if lo is None and math.floor(ranks[i]) < n + r["w"]:
                    lo, below[i] = r["lo"], n
                n += r["w"]
                if math.ceil(ranks[i]) < n:
                    kept[i] = (lo, r["hi"])
                    break
        keep = keep | ((F.col("i") == i) & F.col("v").between(*kept[i]))
    return staged(few.where(keep), "between-ranks"), below, kept
