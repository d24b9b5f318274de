"""Run an operator over all CSV files of a folder, and keep the rows of each file together."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.sources.csv import read_csv, write_csv

SOURCE = "source_file"


def process_folder(
    spark: SparkSession,
    in_dir: str,
    op: Callable[[DataFrame], DataFrame],
    encoding: str = "UTF-8",
    multi_line: bool = False,
    bad_rows: str | None = None,
) -> DataFrame:
    """Apply ``op`` once to the rows of all files, which carry their file in ``source_file``.

    A file is named by its path below ``in_dir``; below the part without wildcards, if there are
    any.
    """
    rows = read_csv(spark, in_dir, encoding, multi_line, source_col="_path", bad_rows=bad_rows)
    if SOURCE in (c.lower() for c in rows.columns):
        raise ValueError(f"rename the input column {SOURCE}; the job adds one of that name")
    fixed = re.split(r"[][{}*?]", in_dir)[0]
    root = (fixed if fixed == in_dir else fixed.rpartition("/")[0]).rstrip("/")
    below = F.regexp_replace("_path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root)
    name = F.when(below.startswith(f"{bare}/"), F.substring(below, len(bare) + 2, 1 << 30)).otherwise(below)
    return op(rows.withColumn(SOURCE, name).drop("_path"))


def write_by_file(rows: DataFrame, out_dir: str, encoding: str = "UTF-8") -> None:
    """Write the rows of each input file to a folder of their own.

    The rows of a file are brought together first; Spark splits those of a large one again.
    """
    write_csv(rows.hint("rebalance", SOURCE), out_dir, encoding, by=[SOURCE])
