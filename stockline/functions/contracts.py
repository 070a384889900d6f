"""Input contracts: required columns and types, checked on the schema only.

Both checks read ``DataFrame.schema`` (no job runs), so they are free to call
before a large plan is built.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    """Raise ``ValueError("Missing columns: a, b")`` when columns are absent."""
    missing = set(required).difference(df.columns)
    if missing:
        raise ValueError(f"Missing columns: {', '.join(sorted(missing))}")


def check_contract(df: DataFrame, schema: T.StructType, integral_ids: bool = False) -> list[str]:
    """Problems of ``df`` against an expected schema: missing columns and columns
    whose type differs.  Empty list = OK.  ``integral_ids`` also takes integral
    types for id columns that the schema declares as strings."""
    problems = []
    actual = {f.name: f.dataType for f in df.schema.fields}
    for field in schema.fields:
        if field.name not in actual:
            problems.append(f"missing column {field.name}")
        elif integral_ids and field.name.endswith("_id") and isinstance(actual[field.name], (T.IntegerType, T.LongType)):
            continue
        elif actual[field.name] != field.dataType:
            problems.append(
                f"column {field.name}: expected {field.dataType.simpleString()}, got {actual[field.name].simpleString()}"
            )
    return problems


def require_views(available: Iterable[str], required: Iterable[str]) -> None:
    """Raise when named tables or views are not registered."""
    missing = set(required).difference(available)
    if missing:
        raise ValueError(f"Missing required objects: {', '.join(sorted(missing))}")
