"""Expressions that a model may propose for a column, as Column expressions: arithmetic, comparisons, conditions and a few functions
over the table's own columns. Python's own parser reads them; anything else it could say is refused, so nothing of it is ever run.

    trim(email)            round(price * 1.2, 2)            upper(code) if length(code) == 2 else null
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..functions.formats import to_boolean, to_integer, to_number, to_timestamp
from ..operators.fitted import NEEDS, Need

MOST_CHARACTERS, MOST_NODES = 1000, 200


class Refused(ValueError):
    """The expression says something that is not allowed."""


#: Functions by name: how many arguments they may have, and what they are.
FUNCTIONS: dict[str, tuple[range, Callable[..., Column]]] = {
    "trim": (range(1, 2), F.trim), "lower": (range(1, 2), F.lower), "upper": (range(1, 2), F.upper), "length": (range(1, 2), F.length), "reverse": (range(1, 2), F.reverse),
    "abs": (range(1, 2), F.abs), "floor": (range(1, 2), F.floor), "ceil": (range(1, 2), F.ceil), "sqrt": (range(1, 2), F.sqrt),
    "coalesce": (range(1, 9), F.coalesce), "concat": (range(1, 9), F.concat), "least": (range(2, 9), F.least), "greatest": (range(2, 9), F.greatest),
    "nullif": (range(2, 3), F.nullif), "replace": (range(3, 4), F.replace), "to_number": (range(1, 2), to_number), "to_integer": (range(1, 2), to_integer),
    "to_boolean": (range(1, 2), to_boolean), "to_timestamp": (range(1, 2), to_timestamp), "text": (range(1, 2), lambda c: c.cast("string")),
}
_TWO = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Mod: F.try_mod}
_COMPARED = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_NAMED = {"null": None, "true": True, "false": False}


def column_of(text: str, df: DataFrame) -> Column:
    """The expression over the columns of ``df``; Refused if it is no such expression. Bad values give NULL, division by 0 too."""
    if len(text) > MOST_CHARACTERS:
        raise Refused("the expression is too long")
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise Refused("no expression") from e
    if sum(1 for _ in ast.walk(tree)) > MOST_NODES:
        raise Refused("the expression has too many parts")
    return _made(tree, set(df.columns))


def _made(node: ast.expr, columns: set[str]) -> Column:
    again = lambda n: _made(n, columns)
    if isinstance(node, ast.Constant) and isinstance(node.value, str | int | float | bool | None):
        return F.lit(node.value)
    if isinstance(node, ast.Name):
        if node.id in columns:
            return col(node.id)
        if node.id.lower() in _NAMED:
            return F.lit(_NAMED[node.id.lower()])
        raise Refused(f"no column {node.id}")
    if isinstance(node, ast.BinOp) and type(node.op) in _TWO:
        return _TWO[type(node.op)](again(node.left), again(node.right))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.Not):
        return -again(node.operand) if isinstance(node.op, ast.USub) else ~again(node.operand)
    if isinstance(node, ast.BoolOp):
        first, *rest = map(again, node.values)
        for other in rest:
            first = first & other if isinstance(node.op, ast.And) else first | other
        return first
    if isinstance(node, ast.Compare) and len(node.ops) == 1:
        op, right = node.ops[0], node.comparators[0]
        if isinstance(op, ast.In | ast.NotIn) and isinstance(right, ast.Tuple | ast.List):
            found = again(node.left).isin(*map(again, right.elts))
            return found if isinstance(op, ast.In) else ~found
        if isinstance(op, ast.Is | ast.IsNot) and isinstance(right, ast.Name | ast.Constant) and (getattr(right, "id", "").lower() == "null" or getattr(right, "value", 0) is None):
            return again(node.left).isNull() if isinstance(op, ast.Is) else again(node.left).isNotNull()
        if type(op) in _COMPARED:
            return _COMPARED[type(op)](again(node.left), again(right))
    if isinstance(node, ast.IfExp):
        return F.when(again(node.test), again(node.body)).otherwise(again(node.orelse))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        if node.func.id == "round" and 1 <= len(node.args) <= 2:
            digits = node.args[1].value if len(node.args) == 2 and isinstance(node.args[1], ast.Constant) else 0 if len(node.args) == 1 else None
            if isinstance(digits, int):
                return F.round(again(node.args[0]), digits)
        allowed, made = FUNCTIONS.get(node.func.id, (range(0), None))
        if len(node.args) in allowed:
            return made(*map(again, node.args))
        raise Refused(f"no function {node.func.id} of {len(node.args)} arguments")
    raise Refused(f"{type(node).__name__} is not allowed")


def _need(df: DataFrame, columns: list[str], text: str = "") -> Need:
    column_of(text, df)  # refused now, not when rows are read
    return Need({}, {}, lambda v: {c: column_of(text, df) for c in columns})


NEEDS["expression"] = _need

#: What a column is cast to, by how its type is called.
DTYPES = {"float": "float", "double": "float", "int": "int", "long": "int", "date": "datetime", "time": "datetime", "bool": "bool", "str": "str", "object": "str", "text": "str"}


def cast_target(dtype: str | None) -> str | None:
    return next((t for name, t in DTYPES.items() if name in (dtype or "").lower()), None)
