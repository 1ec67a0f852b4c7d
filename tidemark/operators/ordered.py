"""Order-dependent repairs: fills, interpolation and keep-first deduplication, by an explicit order column.

A window over the whole table would put it into one task. Fills are therefore done in two phases: rows are dealt to
ranges of the key, each range fills itself, and what a range carries over (its last and first present value) goes on through
one row per range. A range whose start is missing takes the carry of the ranges before. With ``partition_by`` the ranges are those of its
values and the key, so a value of very many rows has ranges of its own; only values that lie in several ranges carry anything, at most two a range.
The number of ranges follows the number of rows, and any type that Spark can sort serves as key.

Spark keeps a running value only for frames that start at the first row; one that ends at the last row it computes anew for
each row. The next value is therefore the last one of the mirrored window, and a fill is linear in the rows of a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, present
from ..staging import staged

#: Rows of a range, about.
RANGE_ROWS = 1_000_000


def own_names(*frames: DataFrame) -> Callable[[str], str]:
    """Makes names that no column of the tables has, nor starts with."""
    prefix = "tm_"
    while any(c.lower().startswith(prefix) for df in frames for c in df.columns):
        prefix += "_"
    return lambda name: prefix + name


def ranged(df: DataFrame, by: list[str], ranges: int | None = None, name: str = "tm_range") -> DataFrame:
    """Adds the column ``name``, which numbers ranges of ``by`` in order. Rows equal in ``by`` share one, nulls come first. The rows are
    written, as another sample of the keys would deal them otherwise."""
    n = ranges or df.count() // RANGE_ROWS + 1
    dealt = df.repartitionByRange(n, *map(col, by)).withColumn(name, F.spark_partition_id())
    return staged(dealt, "ranges").repartition(name)  # one exchange for the windows and the joins that follow


def _forward(v: Column, prev: Column, after: Column, here: Column) -> Column:
    return prev["v"]


def _backward(v: Column, prev: Column, after: Column, here: Column) -> Column:
    return after["v"]


def _between(v: Column, prev: Column, after: Column, here: Column) -> Column:
    line = prev["v"] + (after["v"] - prev["v"]) * (here - prev["at"]) / F.nullif(after["at"] - prev["at"], F.lit(0))
    return F.coalesce(v.cast("double"), line.cast("double"), prev["v"].cast("double"))


#: How a gap is filled, from the present values around it.
FILLS = {"forward": _forward, "backward": _backward, "interpolate": _between}


def fill(df: DataFrame, how: dict[str, str], key: str, partition_by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Fills each column of ``how`` by its way in FILLS; rows are dealt once for all of them. Rows of one key keep any one order, the same
    for all columns. Extra columns of any name stay; an empty table stays empty."""
    groups, made = partition_by or [], own_names(df)
    at_range, i, base, low = made("range"), made("i"), made("base"), made("low")
    df_columns = df.columns
    out = ranged(df.withColumns({made(f"v{k}"): present(df, c) for k, c in enumerate(how)}), [*groups, key], ranges, at_range)
    w = Window.partitionBy(at_range, *map(col, groups))
    out = out.withColumn(i, F.row_number().over(w.orderBy(col(key))).cast("long"))
    point = lambda k, place: F.when(F.col(made(f"v{k}")).isNotNull(), F.struct(place.alias("at"), F.col(made(f"v{k}")).alias("v")))
    running = lambda order: w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    past = [k for k, kind in enumerate(how.values()) if kind != "backward"]
    future = [k for k, kind in enumerate(how.values()) if kind != "forward"]
    out = out.withColumns({made(f"p{k}"): F.last(point(k, F.col(i)), True).over(running(F.col(i))) for k in past})
    out = out.withColumns({made(f"f{k}"): F.last(point(k, F.col(i)), True).over(running(F.col(i).desc())) for k in future})

    # what lies in other ranges: one row for each range, or for each of its groups
    names = [made(f"g{k}") for k in range(len(groups))]
    edges = out.groupBy(F.col(at_range).alias(low), *(col(c).alias(g) for c, g in zip(groups, names, strict=True)))
    valid = lambda k: F.when(F.col(made(f"v{k}")).isNotNull(), F.col(i))
    ends = {made(f"{side}{k}"): pick(point(k, F.col(i)), valid(k)) for k in range(len(how)) for side, pick in (("first", F.min_by), ("last", F.max_by))}
    edges = edges.agg(F.count(F.lit(1)).alias(made("n")), *(c.alias(n) for n, c in ends.items()))
    of = Window.partitionBy(*names)
    over = lambda order: of.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn(base, F.coalesce(F.sum(made("n")).over(over(F.col(low))), F.lit(0).cast("long")))
    lifted = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(base) + F.col(c)["at"]).alias("at"), F.col(c)["v"].alias("v")))
    edges = edges.withColumns({made(f"prev{k}"): F.last(lifted(made(f"last{k}")), True).over(over(F.col(low))) for k in range(len(how))})
    edges = edges.withColumns({made(f"next{k}"): F.last(lifted(made(f"first{k}")), True).over(over(F.col(low).desc())) for k in range(len(how))})
    edges = edges.withColumn(made("many"), F.count(F.lit(1)).over(of)).where(F.col(made("many")) > 1)
    edges = edges.select(low, *names, base, *(made(f"{side}{k}") for k in range(len(how)) for side in ("prev", "next")))
    same = F.col(at_range) == F.col(low)
    for c, g in zip(groups, names, strict=True):
        same = same & col(c).eqNullSafe(F.col(g))
    out = out.join(edges, same, "left")

    here = F.coalesce(F.col(base), F.lit(0).cast("long"))
    own = lambda c: F.when(F.col(c).isNotNull(), F.struct((here + F.col(c)["at"]).alias("at"), F.col(c)["v"].alias("v")))
    none = F.lit(None)
    filled = {}
    for k, (c, kind) in enumerate(how.items()):
        prev = F.coalesce(own(made(f"p{k}")), F.col(made(f"prev{k}"))) if k in past else none
        after = F.coalesce(own(made(f"f{k}")), F.col(made(f"next{k}"))) if k in future else none
        filled[c] = FILLS[kind](F.col(made(f"v{k}")), prev, after, here + F.col(i))
    return out.select(*((filled[c] if c in filled else col(c)).alias(c) for c in df_columns))


def forward_fill(df: DataFrame, column: str, key: str, partition_by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """The last present value; leading gaps stay."""
    return fill(df, {column: "forward"}, key, partition_by, ranges)


def backward_fill(df: DataFrame, column: str, key: str, partition_by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """The next present value; trailing gaps stay."""
    return fill(df, {column: "backward"}, key, partition_by, ranges)


def interpolate(df: DataFrame, column: str, key: str, partition_by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Linear by row position between present values; leading gaps stay, trailing ones take the last value."""
    return fill(df, {column: "interpolate"}, key, partition_by, ranges)


def deduplicate(df: DataFrame, key: str | None, subset: list[str] | None = None, keep: str | bool = "first", ignore_columns: list[str] | None = None) -> DataFrame:
    """Of rows equal in ``subset`` (all columns but the ignored ones and the key, if none is given) the first or last by
    ``key`` stays, or with keep=False none that repeats. First and last are sums by key, so equal rows meet only as one a task."""
    subset = subset or [c for c in df.columns if c not in {*(ignore_columns or []), key}]
    by = [col(c) for c in subset]
    if key is None and keep is not False:  # rows without an order: any of the equal ones
        return df.dropDuplicates(subset)
    if keep is False:
        alone = df.groupBy(*(b.alias(f"tm_g{i}") for i, b in enumerate(by))).agg(F.count(F.lit(1)).alias("tm_n"), F.any_value(F.struct(*(col(c) for c in df.columns))).alias("tm_row"))
        return alone.where("tm_n = 1").select("tm_row.*")
    row = F.struct(*(col(c) for c in df.columns))
    best = (F.min_by if keep == "first" else F.max_by)(row, col(key))
    grouped = df.groupBy(*(b.alias(f"tm_g{i}") for i, b in enumerate(by))).agg(best.alias("tm_row"))
    return grouped.select("tm_row.*")
