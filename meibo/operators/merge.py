"""Put tables with the same columns together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(tables: dict[str, DataFrame], source_col: str | None = None) -> DataFrame:
    """Union of named tables, columns matched by name, duplicates kept.

    A table whose set of columns differs from the first one's is an error that names it.
    ``source_col`` adds the name of the table a row came from.
    """
    if not tables:
        raise ValueError("nothing to merge")
    first = next(iter(tables.values()))
    for name, table in tables.items():
        if sorted(table.columns) != sorted(first.columns):
            odd = sorted(set(table.columns) ^ set(first.columns))
            raise ValueError(f"{name} has other columns than the first table: {', '.join(odd)}")
    if source_col:
        tables = {name: t.withColumn(source_col, F.lit(name)) for name, t in tables.items()}
    return reduce(lambda a, b: a.unionByName(b), tables.values())
