"""Plans, log entries and the contract with a language model. These are metadata, so plain Python on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from enum import Enum


class Strategy(str, Enum):
    # Names of the strategies.
    MEAN_IMPUTATION = "mean_imputation"
    MEDIAN_IMPUTATION = "median_imputation"
    MODE_IMPUTATION = "mode_imputation"
    CONSTANT_IMPUTATION = "constant_imputation"
    INTERPOLATION = "interpolation"
    FORWARD_FILL = "forward_fill"
    BACKWARD_FILL = "backward_fill"
    DROP_ROWS = "drop_rows"
    DROP_COLUMN = "drop_column"
    ZSCORE_CLAMP = "zscore_clamp"
    IQR_CLAMP = "iqr_clamp"
    PERCENTILE_CLAMP = "percentile_clamp"
    DEDUPLICATION = "deduplication"
    TYPE_CAST = "type_cast"
    FORMAT_STANDARDIZE = "format_standardize"
    CATEGORY_NORMALIZE = "category_normalize"
    NORMALIZE = "normalize"
    CUSTOM = "custom"


class Status(str, Enum):
    APPLIED = "APPLIED"
    SKIPPED = "SKIPPED"
    ERROR = "ERROR"
    VALIDATION = "VALIDATION"


# Other names of strategies that plans may use, by the family that carries them out.
FAMILIES = {
    "duplicates": ["deduplication", "deduplicate", "remove_duplicates"],
    "types": ["type_cast", "type_coercion", "type_mismatch"],
    "missing": ["median_imputation", "mean_imputation", "mode_imputation", "constant_imputation", "interpolation", "forward_fill", "backward_fill", "drop_rows", "drop_missing", "imputation", "impute"],
    "outliers": ["iqr_clamp", "zscore_clamp", "percentile_clamp", "outlier_capping", "cap_outliers", "outlier_removal"],
    "categories": ["category_normalize", "normalize", "category_normalisation", "string_normalise", "value_mapping"],
    "formats": ["format_standardize", "format_correction", "format_fix"],
}
FAMILY_OF = {name: family for family, names in FAMILIES.items() for name in names}


@dataclass(frozen=True)
class Action:
    strategy: Strategy
    column: str = "*"
    params: dict = field(default_factory=dict)
    priority: int = 1
    source: str = "rule"
    action_id: str = ""


@dataclass(frozen=True)
class Plan:
    actions: tuple[Action, ...]
    rationale: str = ""

    def ordered(self) -> list[Action]:
        return sorted(self.actions, key=lambda a: a.priority)

    def of(self, *strategies: Strategy) -> list[Action]:
        return [a for a in self.ordered() if a.strategy in strategies]


@dataclass
class LogEntry:
    strategy: str
    column: str
    status: Status
    corrections: int = 0
    source: str = "rule"
    message: str = ""
    params: dict = field(default_factory=dict)


@dataclass
class Log:
    entries: list[LogEntry] = field(default_factory=list)

    def add(self, entry: LogEntry) -> None:
        self.entries.append(entry)

    def summary(self) -> dict:
        by = lambda test: [e for e in self.entries if test(e)]
        return {
            "entries": len(self.entries), "applied": len(by(lambda e: e.status is Status.APPLIED)), "skipped": len(by(lambda e: e.status is Status.SKIPPED)),
            "errors": len(by(lambda e: e.status is Status.ERROR)), "corrections": sum(e.corrections for e in self.entries), "by_ai": sum(e.corrections for e in self.entries if e.source == "ai"),
        }

    def rows(self) -> list[dict]:
        return [asdict(e) | {"status": e.status.value, "params": json.dumps(e.params, sort_keys=True, default=str)} for e in self.entries]


class PlanError(ValueError):
    """A response that is no plan."""


def _share(v: object) -> float:
    return max(0.0, min(1.0, float(v)))


@dataclass(frozen=True)
class Step:
    step_id: str
    title: str
    strategy: str
    target_columns: tuple[str, ...] = ()
    rationale: str = ""
    priority: int = 1
    estimated_impact: float = 0.0
    parameters: dict = field(default_factory=dict)


@dataclass(frozen=True)
class AgentResponse:
    """What a language model must return: a plan, fixes by column, corrections of values, an order, a confidence."""

    healing_plan: tuple[Step, ...]
    transformation_order: tuple[str, ...]
    confidence_score: float
    column_fixes: tuple[dict, ...] = ()
    value_corrections: tuple[dict, ...] = ()

    @classmethod
    def parse(cls, data: dict) -> AgentResponse:
        try:
            steps = tuple(Step(str(s["step_id"]), str(s["title"]), str(s["strategy"]), tuple(map(str, s.get("target_columns") or ())), str(s.get("rationale", "")), int(s.get("priority", 1)), _share(s.get("estimated_impact", 0)), dict(s.get("parameters") or {})) for s in data["healing_plan"])
            order = tuple(map(str, data["transformation_order"]))
            out = cls(steps, order, _share(data["confidence_score"]), tuple(map(dict, data.get("column_fixes") or ())), tuple(map(dict, data.get("value_corrections") or ())))
        except (KeyError, TypeError, ValueError) as e:
            raise PlanError(f"not a plan: {e}") from e
        if not steps or not order:
            raise PlanError("not a plan: it is empty")
        if any(s.priority < 1 for s in steps):
            raise PlanError("not a plan: priorities start at 1")
        return out

    def plan(self) -> Plan:
        """A step and target column make an action; a step without targets has the target '*'. Unknown strategies are CUSTOM."""
        known = {s.value for s in Strategy}
        actions = []
        for s in self.healing_plan:
            strategy = Strategy(s.strategy) if s.strategy in known else Strategy.CUSTOM
            for c in s.target_columns or ("*",):
                actions.append(Action(strategy, c, s.parameters, s.priority, "ai", f"{s.step_id}:{c}"))
        return Plan(tuple(actions))


def salvage_json(text: str) -> dict:
    """A JSON object from a model's answer: the text itself, else a fenced block, else the outermost braces."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    inner = text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""
    for candidate in (text, fenced[1] if fenced else "", inner):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise PlanError("no JSON object in the answer")
