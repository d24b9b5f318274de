"""Cell fixes, the log of changed cells and the list of broken checks. All three are narrow."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.functions.checks import Check
from meibo.functions import names as N

Fix = Callable[[Column], Column]

LOG_COLUMNS = ["column_name", "before_value", "after_value"]
FINDING_COLUMNS = ["column_name", "check_name", "value"]


def remember(rows: DataFrame, cols: list[str], before_col: str = "before") -> DataFrame:
    """Keep the present values of ``cols`` beside the row, for :func:`fix_log`."""
    return rows.withColumn(before_col, F.struct(*N.cols(cols)))


def auto_fix(rows: DataFrame, fixes: dict[str, list[Fix]]) -> DataFrame:
    """Apply the fixes of each column in order, the first ones of all columns in one projection, then the second.

    A fix may name its cell several times; the cell it gets is a column, so the work of a chain of
    fixes adds up and does not multiply.
    """
    unknown = [c for c in fixes if c not in rows.columns]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    for i in range(max(map(len, fixes.values()), default=0)):
        now = {c: steps[i] for c, steps in fixes.items() if i < len(steps)}
        rows = rows.select(*[now[c](N.col(c)).alias(c) if c in now else N.col(c) for c in rows.columns])
    return rows


def fix_log(
    rows: DataFrame, key: list[str], cols: list[str], before_col: str = "before"
) -> DataFrame:
    """One row per changed cell: ``key``, ``column_name``, ``before_value``, ``after_value``."""
    if not cols:
        return rows.select(*N.cols(key), *[F.lit("").alias(c) for c in LOG_COLUMNS]).limit(0)
    changed = [~F.col(before_col)[c].eqNullSafe(N.col(c)) for c in cols]
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(before_col)[c].cast("string").alias("before_value"),
            N.col(c).cast("string").alias("after_value"),
        )
        for c in cols
    ]
    # Most rows have no change, so they are dropped before they become one row per column.
    log = rows.where(reduce(or_, changed)).select(*N.cols(key), F.inline(F.array(*cells)))
    return log.where("not before_value <=> after_value")


def check(rows: DataFrame, key: list[str], checks: list[Check]) -> DataFrame:
    """One row per broken check: ``key``, ``column_name``, ``check_name``, ``value``."""
    if not checks:
        return rows.select(*N.cols(key), *[F.lit("").alias(c) for c in FINDING_COLUMNS]).limit(0)
    found = [
        F.struct(
            F.lit(test.column).alias("column_name"),
            F.lit(test.name).alias("check_name"),
            N.col(test.column).cast("string").alias("value"),
            F.coalesce(test.broken(N.col(test.column)), F.lit(False)).alias("_broken"),
        )
        for test in checks
    ]
    return rows.select(*N.cols(key), F.inline(F.array(*found))).where("_broken").drop("_broken")
