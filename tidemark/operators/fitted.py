"""Repairs as values: what a repair must know of the table is told apart from what it then does to each row.

``fit`` takes the statistics of many repairs in as few passes as their columns allow: repairs of different columns are independent and
share one aggregate, a repair of a column that an earlier one has changed waits for the next. What comes out holds constants only, so it
can be saved, and applied to other tables and to streams, where statistics of the rows so far would be others for every row.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, finite, is_string, missing, present
from ..functions.formats import FIXERS, normalise_category
from .quantiles import exact_quantiles


class Need(NamedTuple):
    """Aggregates by name, quantiles by name, and the new columns made from their values."""

    stats: dict[str, Column]
    quantiles: dict[str, tuple[Column, list[float]]]
    made: Callable[[dict[str, Column]], dict[str, Column]]


@dataclass(frozen=True)
class Repair:
    """``kind`` names one of NEEDS; ``columns`` are those that it reads and replaces."""

    kind: str
    columns: tuple[str, ...]
    params: dict = field(default_factory=dict)

    def need(self, df: DataFrame) -> Need:
        return NEEDS[self.kind](df, list(self.columns), **self.params)


def clip(c: Column, lo: Column, hi: Column) -> Column:
    """Bounds that are NULL bind nothing, and NULL stays NULL; least() and greatest() would fill it."""
    return F.when(c < lo, lo).when(c > hi, hi).otherwise(c)


def impute(df: DataFrame, columns: list[str], strategy: str = "mean", value: object = 0) -> Need:
    if strategy == "constant":
        return Need({}, {}, lambda v: {c: F.coalesce(present(df, c), F.lit(value).cast(df.schema[c].dataType)) for c in columns})
    kind = lambda c: df.schema[c].dataType if strategy == "mode" else "double"
    made = lambda v: {c: F.coalesce(present(df, c).cast(kind(c)), v[f"s{i}"].cast(kind(c))) for i, c in enumerate(columns)}
    if strategy == "median":
        return Need({}, {f"s{i}": (finite(df, c), [0.5]) for i, c in enumerate(columns)}, made)
    take = {"mean": lambda c: F.avg(finite(df, c)), "mode": lambda c: F.mode(present(df, c), True)}[strategy]
    return Need({f"s{i}": take(c) for i, c in enumerate(columns)}, {}, made)


def auto_impute(df: DataFrame, columns: list[str], numbers: tuple[str, ...] = ()) -> Need:
    rest = [c for c in columns if c not in numbers]

    def made(v: dict[str, Column]) -> dict[str, Column]:
        new = {c: F.coalesce(present(df, c).cast("double"), v[f"n{i}"]) for i, c in enumerate(numbers)}
        return new | {c: F.coalesce(present(df, c), v[f"o{i}"], *([F.lit("")] if is_string(df.schema[c].dataType) else [])) for i, c in enumerate(rest)}

    return Need({f"o{i}": F.mode(present(df, c), True) for i, c in enumerate(rest)}, {f"n{i}": (finite(df, c), [0.5]) for i, c in enumerate(numbers)}, made)


def clamp(df: DataFrame, columns: list[str], method: str = "iqr", factor: float = 1.5, threshold: float = 3.0, lower_pct: float = 1.0, upper_pct: float = 99.0) -> Need:
    stats: dict[str, Column] = {f"n{i}": F.count(finite(df, c)) for i, c in enumerate(columns)}
    quantiles: dict[str, tuple[Column, list[float]]] = {}
    for i, c in enumerate(columns):
        if method == "zscore":
            stats |= {f"a{i}": F.avg(finite(df, c)), f"b{i}": F.stddev_samp(finite(df, c))}
        else:
            quantiles[f"q{i}"] = (finite(df, c), [0.25, 0.75] if method == "iqr" else [lower_pct / 100, upper_pct / 100])

    def made(v: dict[str, Column]) -> dict[str, Column]:
        new = {}
        for i, c in enumerate(columns):
            if method == "zscore":
                mid, wide = v[f"a{i}"], threshold * v[f"b{i}"]
                lo, hi, ok = mid - wide, mid + wide, v[f"b{i}"] > 0
            else:
                a, b = v[f"q{i}"], v[f"q{i}:1"]
                wide = factor * (b - a) if method == "iqr" else F.lit(0.0)
                lo, hi, ok = a - wide, b + wide, (b > a) if method == "iqr" else F.lit(True)
            ok = ok & (v[f"n{i}"] >= 4)
            new[c] = clip(present(df, c).cast("double"), F.when(ok, lo), F.when(ok, hi))
        return new

    return Need(stats, quantiles, made)


def scale(df: DataFrame, columns: list[str], method: str = "minmax") -> Need:
    stats: dict[str, Column] = {}
    for i, c in enumerate(columns):
        v = finite(df, c)
        stats |= {f"a{i}": F.min(v), f"b{i}": F.max(v) - F.min(v)} if method == "minmax" else {f"a{i}": F.avg(v), f"b{i}": F.stddev_samp(v)}
    one = lambda v, i, c: F.when(v[f"b{i}"] > 0, (present(df, c).cast("double") - v[f"a{i}"]) / v[f"b{i}"]).when(~missing(df, c), 0.0)
    return Need(stats, {}, lambda v: {c: one(v, i, c) for i, c in enumerate(columns)})


def normalise(df: DataFrame, columns: list[str], **how) -> Need:
    return Need({}, {}, lambda v: {c: normalise_category(col(c), **how) for c in columns})


def auto_normalise(df: DataFrame, columns: list[str], most: int = 50) -> Need:
    made = lambda v: {c: F.when(v[f"k{i}"] <= most, normalise_category(col(c))).otherwise(col(c)) for i, c in enumerate(columns)}
    return Need({f"k{i}": F.count_distinct(col(c)) for i, c in enumerate(columns)}, {}, made)


def standardise(df: DataFrame, columns: list[str], kinds: dict[str, str] | None = None) -> Need:
    texts = [c for c in columns if (kinds or {}).get(c) in FIXERS and is_string(df.schema[c].dataType)]
    return Need({}, {}, lambda v: {c: FIXERS[kinds[c]](col(c)) for c in texts})


#: Kinds of repairs that keep rows; users may add their own.
NEEDS: dict[str, Callable[..., Need]] = {"impute": impute, "auto_impute": auto_impute, "clamp": clamp, "scale": scale, "normalise": normalise, "auto_normalise": auto_normalise, "standardise": standardise}


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """The columns of ``df``, the named ones replaced, in their order."""
    return df.select(*((new[c] if c in new else col(c)).alias(c) for c in df.columns)) if new else df


@dataclass
class Fitted:
    """Repairs in the order they are to be done, each with its statistics as (text, type): nothing of the table is left in them."""

    steps: list[tuple[Repair, dict[str, tuple[str | None, str]]]]
    passes: int = 0

    def apply(self, df: DataFrame) -> DataFrame:
        """On any table or stream with these columns; expressions of the row alone."""
        out = df
        for repair, values in self.steps:
            out = replaced(out, repair.need(out).made({k: F.lit(text).cast(kind) for k, (text, kind) in values.items()}))
        return out

    def to_json(self) -> str:
        return json.dumps([{"kind": r.kind, "columns": r.columns, "params": r.params, "values": v} for r, v in self.steps])

    @classmethod
    def from_json(cls, text: str) -> Fitted:
        return cls([(Repair(s["kind"], tuple(s["columns"]), s["params"]), {k: tuple(v) for k, v in s["values"].items()}) for s in json.loads(text)])


def shaped(df: DataFrame, repair: Repair) -> DataFrame:
    """What a repair makes of the types of ``df``, without its statistics: to be analysed, not to be read."""
    need = repair.need(df)
    empty = {f"{q}:{i}" if i else q: F.lit(None).cast("double") for q, (_, ps) in need.quantiles.items() for i in range(len(ps))}
    if need.stats:
        kinds = df.agg(*(c.alias(n) for n, c in need.stats.items())).schema
        empty |= {n: F.lit(None).cast(f.dataType) for n, f in zip(need.stats, kinds, strict=True)}
    return replaced(df, need.made(empty))


def levels(df: DataFrame, repairs: list[Repair]) -> list[list[int]]:
    """The numbers of the repairs by the pass that their statistics are taken in. A repair waits for those before it that replace
    one of its columns; those that need no statistics cost no pass."""
    ready: dict[str, int] = {}
    out: list[list[int]] = []
    shape = df
    for k, r in enumerate(repairs):
        need = r.need(shape)
        at = max((ready.get(c, 0) for c in r.columns), default=0)
        while len(out) <= at:
            out.append([])
        out[at].append(k)
        ready |= dict.fromkeys(r.columns, at + bool(need.stats or need.quantiles))
        shape = shaped(shape, r)
    return out


def fit(df: DataFrame, repairs: list[Repair]) -> Fitted:
    """Takes the statistics of all repairs: one aggregate for each level that has any, and the exact quantiles of a level together."""
    steps: list[tuple[Repair, dict[str, tuple[str | None, str]]]] = []
    passes, out = 0, df
    for level in levels(df, repairs):
        waiting = []  # repairs of a level read other columns than its members with statistics replace, or come before them
        for k in level:
            need = repairs[k].need(out)
            if not need.stats and not need.quantiles:
                steps.append((repairs[k], {}))
                out = replaced(out, need.made({}))
            else:
                waiting.append(repairs[k])
        if not waiting:
            continue
        needs = [r.need(out) for r in waiting]
        stats = {f"r{j}_{n}": c for j, need in enumerate(needs) for n, c in need.stats.items()}
        quantiles = {f"r{j}_{n}": q for j, need in enumerate(needs) for n, q in need.quantiles.items()}
        got: dict[str, tuple[str | None, str]] = {}
        if stats:
            row = out.agg(*(c.alias(n) for n, c in stats.items()))
            texts = row.select(*(F.col(n).cast("string").alias(n) for n in stats)).first()
            got |= {n: (texts[n], row.schema[n].dataType.simpleString()) for n in stats}
            passes += 1
        if quantiles:
            found = exact_quantiles(out, {n: c for n, (c, _) in quantiles.items()}, {n: ps for n, (_, ps) in quantiles.items()})
            for n, values in found.items():
                got |= {n if i == 0 else f"{n}:{i}": (None if x is None else repr(x), "double") for i, x in enumerate(values)}
            passes += 1
        new: dict[str, Column] = {}
        for j, (r, need) in enumerate(zip(waiting, needs, strict=True)):
            own = {n.removeprefix(f"r{j}_"): v for n, v in got.items() if n.startswith(f"r{j}_")}
            steps.append((r, own))
            new |= need.made({n: F.lit(text).cast(kind) for n, (text, kind) in own.items()})
        out = replaced(out, new)
    return Fitted(steps, passes)


def repaired(df: DataFrame, repairs: list[Repair]) -> DataFrame:
    return fit(df, repairs).apply(df)
