"""The whole flow behind one object: read, profile, detect, plan, heal, score, compare."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import anomaly, multivariate, profile, report, score, semantic
from .plans.engine import Config, Engine, Result, count_corrections
from .plans.model import Plan
from .plans.planner import Planner, RulePlanner
from .sources.readers import Limits, read
from .sources.sinks import DatasetStore


@dataclass
class DataQuality:
    spark: SparkSession
    planner: Planner = field(default_factory=RulePlanner)
    config: Config = field(default_factory=Config)

    def read(self, path: str, limits: Limits = Limits()) -> DataFrame:
        return read(self.spark, path, limits=limits).frame

    def profile(self, df: DataFrame) -> dict[str, DataFrame]:
        """Tables with a row per column, and one for the dataset."""
        numbers, texts = profile.numeric_columns(df), profile.string_columns(df)
        out = {"dataset": profile.profile_dataset(df), "nulls": profile.profile_nulls(df), "distinct": profile.profile_distinct(df), "constraints": profile.profile_constraints(df)}
        if numbers:
            out |= {"numeric": profile.profile_numeric(df), "quartiles": profile.profile_quartiles(df), "shape": profile.profile_shape(df)}
        if texts:
            out |= {"strings": profile.profile_strings(df), "top_values": profile.profile_top_values(df)}
        return out

    def types(self, df: DataFrame) -> dict[str, str]:
        return semantic.detected(df)

    def detect(self, df: DataFrame, *, multivariate_too: bool = False) -> DataFrame:
        found = anomaly.anomaly_report(df)
        return found.drop("severity_rank").unionByName(multivariate.anomaly_multivariate(df)) if multivariate_too else found

    def plan(self, df: DataFrame, types: dict[str, str] | None = None) -> Plan:
        findings = [r.asDict() for r in anomaly.anomaly_report(df).collect()]  # a few rows for each column
        return self.planner.plan(df, findings, types if types is not None else self.types(df))

    def heal(self, df: DataFrame, plan: Plan, key: str | None = None, types: dict[str, str] | None = None) -> Result:
        out = Engine(types or {}, key, self.config).run(df, plan)
        if key:
            count_corrections(df, out.frame, key, out.log)
        return out

    def score(self, df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
        return score.quality_breakdown(df, types)

    def compare(self, before: DataFrame, after: DataFrame, key: str | None = None) -> dict[str, DataFrame]:
        b, a = self.score(before), self.score(after)
        out = {"delta": score.quality_delta(b, a), "pillars": report.pillar_comparison(score.quality_pillars(b), score.quality_pillars(a)), "null_rates": report.null_rate_comparison(before, after)}
        if key:
            diff = report.diff_keyed(before, after, key)
            out |= {"cells": report.diff_cells(diff, most=200), "summary": report.diff_summary(before, after, diff)}
        return out

    def run(self, path: str, dataset: str, root: str, key: str | None = None) -> dict:
        """The whole flow; tables are written under ``root`` and only report rows reach the driver."""
        store = DatasetStore(self.spark, root)
        raw = store.save("raw", dataset, self.read(path))
        types = self.types(raw)
        plan = self.plan(raw, types)
        result = self.heal(raw, plan, key if key in raw.columns else None, types)
        healed = store.save("healed", dataset, result.frame)
        store.save_reports(dataset, {**self.profile(raw), "anomalies": self.detect(raw), **self.compare(raw, healed, key if key in raw.columns else None)})
        return {"dataset": dataset, "types": types, "plan": plan, "log": result.log, "path": store.path("healed", dataset)}
