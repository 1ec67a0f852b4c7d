"""Carries out a plan: a fold of repairs over a DataFrame, in the order of families or as a model asks for.

Spark reports errors when rows are read, so each repair is checked against the schema before it is added (a repair that cannot be
analysed is logged as an error and left out) and uses expressions that give NULL for bad values, so none can stop a job later.
Repairs that keep all rows are gathered, and their statistics are taken together when a repair that does not keep them, or the end,
comes: one aggregate for each level of columns that depend on each other. Corrections are counted once for the whole plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import changed, col, is_numeric, is_string, missing
from ..operators import heal as H
from ..operators import ordered as W
from ..operators import profile as P
from .expressions import cast_target
from .model import FAMILY_OF, Action, AgentResponse, Log, LogEntry, Plan, Status, Strategy

ORDER = ["duplicates", "types", "missing", "outliers", "categories", "formats", "expressions"]
FILLS = {Strategy.FORWARD_FILL: W.forward_fill, Strategy.BACKWARD_FILL: W.backward_fill, Strategy.INTERPOLATION: W.interpolate}
IMPUTES = {Strategy.MEAN_IMPUTATION: "mean", Strategy.MEDIAN_IMPUTATION: "median", Strategy.MODE_IMPUTATION: "mode", Strategy.CONSTANT_IMPUTATION: "constant"}
CLAMPS = {Strategy.IQR_CLAMP: "iqr", Strategy.ZSCORE_CLAMP: "zscore", Strategy.PERCENTILE_CLAMP: "percentile"}
STRATEGY_FAMILY = {s: f for f, names in {
    "duplicates": ["deduplication"], "types": ["type_cast"], "missing": [*[s.value for s in IMPUTES], *[s.value for s in FILLS], "drop_rows", "drop_column"],
    "outliers": [*[s.value for s in CLAMPS], "normalize"], "categories": ["category_normalize"], "formats": ["format_standardize"], "expressions": ["custom"],
}.items() for s in map(Strategy, names)}
#: Ways that a fix of a column may ask for, by its kind.
WAYS = {"impute": {"mean", "median", "mode", "constant", "forward_fill", "backward_fill", "interpolation"}, "cap": {"iqr", "zscore", "percentile"}}


@dataclass(frozen=True)
class Config:
    auto_impute: bool = True
    auto_deduplicate: bool = True
    auto_type_cast: bool = True
    auto_cap_outliers: bool = False
    auto_normalize_categories: bool = True
    auto_format_correct: bool = True


@dataclass
class Result:
    frame: DataFrame
    log: Log
    applied: int = 0
    fitted: list[H.Fitted] = field(default_factory=list)
    """Repairs with their statistics, in the order they were made; they can be saved and applied to streams."""


@dataclass
class Engine:
    """``key`` orders rows for fills and keep-first; ``healers`` adds families or replaces them: name to (DataFrame, actions) -> DataFrame."""

    types: dict[str, str] = field(default_factory=dict)
    key: str | None = None
    config: Config = Config()
    healers: dict[str, Callable[[DataFrame, list[Action]], DataFrame]] = field(default_factory=dict)

    def needed(self, df: DataFrame, a: Action) -> str | None:
        """Why an action cannot be carried out on these columns; None if it can."""
        if a.strategy is Strategy.CUSTOM and "expression" not in a.params:
            return "unknown strategy"
        if a.strategy in (Strategy.DROP_ROWS, Strategy.DEDUPLICATION):
            lost = [c for c in a.params.get("subset") or [] if c not in df.columns]
            return f"no column {lost[0]}" if lost else None
        if a.column == "*":
            return "needs a column"
        if a.column not in df.columns:
            return f"no column {a.column}"
        kind = df.schema[a.column].dataType
        if (a.strategy in CLAMPS or a.strategy in (Strategy.MEAN_IMPUTATION, Strategy.MEDIAN_IMPUTATION, Strategy.NORMALIZE, Strategy.INTERPOLATION)) and not is_numeric(kind):
            return f"{a.column} is not numeric"
        if a.strategy in (Strategy.FORMAT_STANDARDIZE, Strategy.CATEGORY_NORMALIZE) and not is_string(kind):
            return f"{a.column} is not text"
        if a.strategy in FILLS and self.key is None:
            return "fills need an order column"
        return None

    def repair(self, a: Action) -> H.Repair | None:
        """An action that keeps all rows and columns, as a repair to be fitted; None if it is none."""
        p, c = a.params, (a.column,)
        if a.strategy in IMPUTES:
            return H.Repair("impute", c, {"strategy": IMPUTES[a.strategy], "value": p.get("value", 0)})
        if a.strategy in CLAMPS:
            return H.Repair("clamp", c, {"method": CLAMPS[a.strategy]} | {k: p[k] for k in ("factor", "threshold", "lower_pct", "upper_pct") if k in p})
        if a.strategy is Strategy.NORMALIZE:
            return H.Repair("scale", c, {"method": p.get("method", "minmax")})
        if a.strategy is Strategy.CATEGORY_NORMALIZE:
            names = {"strip": "trim", "case": "case", "alias_map": "aliases", "allowed_values": "allowed", "unknown_token": "unknown"}
            return H.Repair("normalise", c, {names[k]: v for k, v in p.items() if k in names})
        if a.strategy is Strategy.CUSTOM:
            return H.Repair("expression", c, {"text": str(p["expression"])})
        if a.strategy is Strategy.FORMAT_STANDARDIZE:
            return H.Repair("standardise", c, {"kinds": {a.column: p.get("semantic_type") or self.types.get(a.column, "")}})
        return None

    def one(self, df: DataFrame, a: Action) -> DataFrame:
        """An action that drops rows or columns, orders them, or changes types by what the rows hold."""
        p = a.params
        if a.strategy is Strategy.DEDUPLICATION:
            return W.deduplicate(df, self.key, p.get("subset"), p.get("keep", "first"), p.get("ignore_columns"))
        if a.strategy is Strategy.DROP_ROWS:
            return H.drop_rows(df, p.get("subset"))
        if a.strategy is Strategy.DROP_COLUMN:
            return H.drop_columns(df, [a.column])
        if a.strategy in FILLS:
            return FILLS[a.strategy](df, a.column, self.key, p.get("partition_by"))
        return H.type_cast(df, {a.column: p.get("target_type", "str")}, p.get("date_format"))

    def automatic(self, df: DataFrame, family: str, done: set[str]) -> DataFrame | H.Repair | None:
        """What a family does to columns that no action names: a new table, a repair, or nothing."""
        c = self.config
        if family == "duplicates" and c.auto_deduplicate and not done:
            return W.deduplicate(df, self.key, [x for x in df.columns if x != self.key])
        if family == "types" and c.auto_type_cast:
            return H.auto_cast(df, {k: t for k, t in self.types.items() if k not in done})
        if family == "missing" and c.auto_impute:
            rest = tuple(x for x in df.columns if x not in done | {self.key})
            return H.Repair("auto_impute", rest, {"numbers": [x for x in P.numeric_columns(df) if x in rest]})
        if family == "outliers" and c.auto_cap_outliers:
            rest = tuple(x for x in P.numeric_columns(df) if x not in done and x != self.key)
            return H.Repair("clamp", rest, {"method": "iqr"})
        if family == "categories" and c.auto_normalize_categories and not done:
            return H.Repair("auto_normalise", tuple(P.string_columns(df)))
        if family == "formats" and c.auto_format_correct:
            return H.Repair("standardise", tuple(k for k in self.types if k not in done and k in df.columns), {"kinds": self.types})
        return None

    def run(self, df: DataFrame, plan: Plan, order: list[str] | None = None, *, source: str = "rule", automatic: bool = True) -> Result:
        log, out = Log(), df  # the table so far
        shape, pending, fitted = df, [], []  # its types with the repairs that wait

        def settled() -> DataFrame:
            if pending:
                fitted.append(H.fit(out, pending))
                pending.clear()
                return fitted[-1].apply(out)
            return out

        for family in order or ORDER:
            actions = [a for a in plan.ordered() if STRATEGY_FAMILY.get(a.strategy) == family]
            done: set[str] = set()
            if family in self.healers:
                out = settled()
                try:
                    out = self.healers[family](out, actions)
                    log.add(LogEntry(family, "*", Status.APPLIED, source=source))
                except Exception as e:  # a healer of the user's own must not stop the others
                    log.add(LogEntry(family, "*", Status.ERROR, source=source, message=str(e)[:200]))
                shape = out
                continue
            for a in actions:
                why = self.needed(shape, a)
                if why:
                    log.add(LogEntry(a.strategy.value, a.column, Status.SKIPPED, source=a.source, message=why, params=a.params))
                    continue
                try:
                    if repair := self.repair(a):
                        shape = H.shaped(shape, repair)  # analysed now, so a bad parameter shows here
                        pending.append(repair)
                    else:
                        out = settled()
                        shape = out
                        made = self.one(out, a)
                        made.schema  # noqa: B018  analysed now as well
                        out = shape = made
                except Exception as e:
                    log.add(LogEntry(a.strategy.value, a.column, Status.ERROR, source=a.source, message=str(e)[:200], params=a.params))
                    continue
                done |= {a.column} if a.column != "*" else set(a.params.get("subset") or ["*"])
                log.add(LogEntry(a.strategy.value, a.column, Status.APPLIED, source=a.source, params=a.params))
            if automatic:
                if family in ("duplicates", "types"):
                    out = settled()
                    shape = out
                made = self.automatic(shape, family, done)
                if isinstance(made, H.Repair):
                    if made.columns:
                        shape = H.shaped(shape, made)
                        pending.append(made)
                elif made is not None:
                    out = shape = made
        out = settled()
        for a in plan.ordered():
            if a.strategy not in STRATEGY_FAMILY:
                log.add(LogEntry(a.strategy.value, a.column, Status.SKIPPED, source=a.source, message="unknown strategy"))
        return Result(out, log, sum(e.status is Status.APPLIED for e in log.entries), fitted)

    def run_ai(self, df: DataFrame, response: AgentResponse, *, automatic: bool = False) -> Result:
        """The families in the order the model asks for; unknown names are skipped, and without any known one the usual order holds."""
        order = list(dict.fromkeys(FAMILY_OF[n] for n in response.transformation_order if n in FAMILY_OF))
        out = self.run(df, response.plan(), order or ORDER, source="ai", automatic=automatic)
        for n in response.transformation_order:
            if n not in FAMILY_OF:
                out.log.add(LogEntry(n, "*", Status.SKIPPED, source="ai", message="unknown strategy"))
        if response.column_fixes:
            more = self.run(out.frame, self.fixes(out.frame, response.column_fixes), ORDER, source="ai", automatic=False)
            out = Result(more.frame, Log(out.log.entries + more.log.entries), out.applied + more.applied, out.fitted + more.fitted)
        if response.value_corrections:
            out.frame = value_corrections(out.frame, list(response.value_corrections))
            for c in dict.fromkeys(str(v.get("column")) for v in response.value_corrections):
                out.log.add(LogEntry("value_corrections", c, Status.APPLIED if c in out.frame.columns else Status.SKIPPED, source="ai", message="" if c in out.frame.columns else f"no column {c}"))
        warnings = [f"{r['warning']}: {r['column']}" for r in H.validate_transformation(df, out.frame).collect()]  # a few rows
        out.log.add(LogEntry("validation", "*", Status.VALIDATION, source="ai", message="; ".join(warnings)))
        return out

    def fixes(self, df: DataFrame, fixes: tuple[dict, ...]) -> Plan:
        """Fixes of columns as actions: impute, cast, normalize, deduplicate, cap, format_fix, drop, or an expression (see expressions.py).
        What no kind names becomes CUSTOM, and is skipped with a log entry; so are ways and types that are not known."""
        actions = []
        for k, fix in enumerate(fixes):
            name, kind, p = str(fix.get("column", "*")), str(fix.get("fix_type", "")).lower(), dict(fix.get("parameters") or {})
            numeric = name in df.columns and is_numeric(df.schema[name].dataType)
            way = str(p.get("strategy") or p.get("method") or "").lower().removesuffix("_imputation").removesuffix("_clamp")
            strategy = Strategy.CUSTOM
            if kind == "impute" and (not way or way in WAYS["impute"]):
                way = way or ("constant" if "value" in p else "median" if numeric else "mode")
                strategy = Strategy(way if way in ("forward_fill", "backward_fill", "interpolation") else f"{way}_imputation")
            elif kind == "cap" and (not way or way in WAYS["cap"]):
                strategy = Strategy(f"{way or 'iqr'}_clamp")
            elif kind == "cast" and (target := cast_target(fix.get("target_dtype") or p.get("target_type"))):
                strategy, p = Strategy.TYPE_CAST, p | {"target_type": target}
            elif kind == "normalize":
                strategy = Strategy.NORMALIZE if numeric else Strategy.CATEGORY_NORMALIZE
            elif kind == "deduplicate":
                strategy, p = Strategy.DEDUPLICATION, p | {"subset": p.get("subset") or ([name] if name in df.columns else None)}
            elif kind == "format_fix":
                strategy = Strategy.FORMAT_STANDARDIZE
            elif kind == "drop":
                strategy = Strategy.DROP_COLUMN
            if strategy is not Strategy.CUSTOM or kind != "expression":
                p.pop("expression", None)
            actions.append(Action(strategy, name, p, k + 1, "ai", f"fix:{k}"))
        return Plan(tuple(actions))


def count_corrections(before: DataFrame, after: DataFrame, key: str, log: Log | None = None) -> dict[str, int]:
    """Changed cells by column, of rows that both tables hold: one join by key and one aggregate for a whole plan."""
    columns = [c for c in before.columns if c in after.columns and c != key]
    both = before.select(col(key), *(col(c).cast("string").alias(f"b_{c}") for c in columns)).join(after.select(col(key), *(col(c).cast("string").alias(f"a_{c}") for c in columns)), key)
    row = both.agg(*(F.count_if(changed(col(f"b_{c}"), col(f"a_{c}"))).alias(f"k{i}") for i, c in enumerate(columns))).first()
    out = {c: row[f"k{i}"] for i, c in enumerate(columns)}
    if log:
        for c in columns:
            if entries := [e for e in log.entries if e.column == c and e.status is Status.APPLIED]:
                entries[-1].corrections = out[c]
    return out


def value_corrections(df: DataFrame, corrections: list[dict]) -> DataFrame:
    """Applies a model's corrections of single values: one lookup per column."""
    by: dict[str, list[tuple]] = {}
    for c in corrections:
        if c.get("column") in df.columns:
            by.setdefault(c["column"], []).append((c.get("original_value"), c.get("corrected_value")))
    out = df
    for name, pairs in by.items():
        kind, v, made = df.schema[name].dataType, col(name), None
        for old, new in pairs:
            hit = missing(df, name) if old is None else v == F.lit(old).cast(kind)
            new_value = F.lit(new).cast(kind)
            made = F.when(hit, new_value) if made is None else made.when(hit, new_value)
        out = out.withColumn(name, made.otherwise(v))
    return out
