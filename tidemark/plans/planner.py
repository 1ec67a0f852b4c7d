"""Planners: from a profile and findings to a plan. Both are tables with a row per column or finding, so bounded by the schema."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from ..operators import profile as P
from .model import Action, AgentResponse, Plan, PlanError, Strategy, salvage_json

# How much of a profile and of the findings a prompt shows.
PROMPT_COLUMNS, PROMPT_FINDINGS, PROMPT_VALUES = 40, 25, 5


class Planner(Protocol):
    def plan(self, df: DataFrame, findings: list[dict], types: dict[str, str]) -> Plan: ...


class RulePlanner:
    """The same data always get the same plan, without a network."""

    def plan(self, df: DataFrame, findings: list[dict], types: dict[str, str]) -> Plan:
        numbers = {f.name for f in df.schema if P.is_numeric(f.dataType)}
        actions = []
        for f in findings:
            kind, column = f["anomaly_type"], f["column"]
            if kind == "duplicate_rows":
                actions.append(Action(Strategy.DEDUPLICATION, "*", {}, 1))
            elif kind == "missing_values":
                lost = f["severity"] == "critical" and f["affected_rate"] >= 0.95
                actions.append(Action(Strategy.DROP_COLUMN if lost else Strategy.MEDIAN_IMPUTATION if column in numbers else Strategy.MODE_IMPUTATION, column, {}, 3))
            elif kind == "outlier":
                actions.append(Action(Strategy.IQR_CLAMP, column, {}, 4))
        for column, t in types.items():
            if t in ("email", "phone", "url", "zipcode", "currency", "percentage") and column not in numbers:
                actions.append(Action(Strategy.FORMAT_STANDARDIZE, column, {"semantic_type": t}, 6))
            elif t == "categorical" and column not in numbers:
                actions.append(Action(Strategy.CATEGORY_NORMALIZE, column, {"case": None}, 5))
        return Plan(tuple(actions), "rules over findings and semantic types")


def prompt(df: DataFrame, findings: list[dict], types: dict[str, str]) -> list[dict]:
    """Messages for a model: the schema, the findings, and the answer's form."""
    shown = {"columns": [{"name": f.name, "type": f.dataType.simpleString(), "semantic_type": types.get(f.name)} for f in df.schema][:PROMPT_COLUMNS], "findings": findings[:PROMPT_FINDINGS]}
    form = {"healing_plan": [{"step_id": "step_01", "title": "", "strategy": " | ".join(s.value for s in Strategy if s is not Strategy.CUSTOM), "target_columns": [], "rationale": "", "priority": 1, "estimated_impact": 0.1, "parameters": {}}], "column_fixes": [], "value_corrections": [], "transformation_order": [], "confidence_score": 0.8}
    return [
        {"role": "system", "content": "You repair tabular data. Answer with one JSON object of this form and nothing else: " + json.dumps(form)},
        {"role": "user", "content": json.dumps(shown, default=str)},
    ]


class LLMPlanner:
    """Asks a model through ``complete``, a function from messages to text, so that any client will do."""

    def __init__(self, complete: Callable[[list[dict]], str]):
        self.complete = complete

    def respond(self, df: DataFrame, findings: list[dict], types: dict[str, str]) -> AgentResponse:
        return AgentResponse.parse(salvage_json(self.complete(prompt(df, findings, types))))

    def plan(self, df: DataFrame, findings: list[dict], types: dict[str, str]) -> Plan:
        return self.respond(df, findings, types).plan()


class Refused(Exception):
    """A client's error: status, and the seconds the server asks to wait."""

    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


@dataclass(frozen=True)
class Retry:
    """Tries again after overload, server and network errors, waiting longer each time; never after a refusal of the key."""

    times: int = 3
    least: float = 1.0
    most: float = 30.0

    def __call__(self, call: Callable[[], str], sleep: Callable[[float], None] = time.sleep) -> str:
        for attempt in range(self.times + 1):
            try:
                return call()
            except (Refused, ConnectionError, TimeoutError) as e:
                status = getattr(e, "status", 503)
                if attempt == self.times or status in (401, 403) or (status < 500 and status != 429):
                    raise
                sleep(getattr(e, "retry_after", None) or min(self.most, self.least * 2**attempt + random.uniform(0, 0.5)))
        raise PlanError("no answer")
