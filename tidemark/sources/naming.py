"""Unique snake_case column names."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame

# Names that count as no name.
NO_NAMES = {"", "nan", "none", "null"}


def normalised(name: object, position: int) -> str:
    text = str(name).strip()
    if text.lower() in NO_NAMES:
        return f"unnamed_{position}"
    ascii_ = unicodedata.normalize("NFD", text).encode("ascii", "ignore").decode().lower()
    out = re.sub(r"[^a-z0-9]+", "_", ascii_).strip("_")
    if not out:
        return f"unnamed_{position}"
    return f"col_{out}" if out[0].isdigit() else out


def normalise_columns(names: list) -> list[str]:
    """Repeated names get _2, _3 and so on, never one that is taken already."""
    taken: set[str] = set()
    out = []
    for i, name in enumerate(names):
        base = made = normalised(name, i)
        k = 2
        while made in taken:
            made, k = f"{base}_{k}", k + 1
        taken.add(made)
        out.append(made)
    return out


def with_normal_names(df: DataFrame) -> DataFrame:
    return df.toDF(*normalise_columns(df.columns))
