"""CSV in and out. Every cell is a string, so leading zeros survive."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meibo.functions.names import col, cols
from meibo.operators.lookup import OWN, lookup_join

# A file of any size becomes one split, so that one task sees its first line.
ONE_SPLIT = str(1 << 50)

# The bits of monotonically_increasing_id that number the rows of a task.
ROW_BITS = (1 << 33) - 1

def _file_path() -> Column:
    """The path a row was read from. The metadata column holds it as a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def headers(spark: SparkSession, paths: list[str], encoding: str = "UTF-8") -> dict[str, list[str]]:
    """The column names of every CSV file at ``paths`` (files or folders), by file.

    One task per file keeps its first line; the other lines are passed over where they are read.
    The settings for that belong to a session of their own.
    """
    own = spark.newSession()
    # What was set on the caller's session, such as a store's credentials, holds here as well.
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", ONE_SPLIT)
    own.conf.set("spark.sql.files.openCostInBytes", ONE_SPLIT)
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    lines = own.read.text(paths).select(
        _file_path().alias("path"), F.col("value").cast("binary").alias("line"), F.monotonically_increasing_id().alias("at")
    )
    # Within a task the numbers begin with 0 in their low bits.
    found = lines.where(F.col("at").bitwiseAND(F.lit(ROW_BITS)) == 0).collect()
    if not found:
        raise ValueError(f"no CSV lines at {', '.join(paths)}")
    return {row["path"]: _names(row["path"], bytes(row["line"]), encoding) for row in found}


def _names(path: str, line: bytes, encoding: str) -> list[str]:
    text = line.decode(encoding).removeprefix("\ufeff")
    if text.count('"') % 2:
        raise ValueError(f"{path}: a column name with a line break is not supported")
    names = next(csv.reader([text]))
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"{path}: column name used twice: {', '.join(twice)}")
    return names


# Beside the columns of a file: the raw text of a row that does not fit them.
_CORRUPT = "_corrupt_row"


def reader_options(encoding: str = "UTF-8", multi_line: bool = False) -> dict:
    """Options of every CSV scan. A file whose header is not the schema's stops the job.

    Whole rows are parsed, whatever columns are asked for: only then are missing and surplus cells
    seen.
    """
    return {
        "columnPruning": False,
        "columnNameOfCorruptRecord": _CORRUPT,
        "header": True,
        "escape": '"',
        "encoding": encoding,
        "multiLine": multi_line,
        "enforceSchema": False,
    }


# Most rows of a packed file, as one task reads it whole.
PACKED_ROWS = 1_000_000


def writer_options(encoding: str = "UTF-8", packed: bool = False) -> dict:
    """Options of every CSV sink: cells as they are, edge spaces kept, quotes doubled.

    ``packed`` files are compressed by gzip, at its fastest, and hold a bounded number of rows.
    """
    dense = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": PACKED_ROWS}
    return (dense if packed else {}) | {
        "header": True,
        "escape": '"',
        "encoding": encoding,
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
        "emptyValue": "",
    }


# Where a row was read: its file, the place of its block, and a number that grows within a task.
_FILE, _BLOCK, _NUMBER = (OWN + c for c in ("file", "block", "number"))


def _scan(spark, paths, names, encoding, multi_line, bad_rows, source_col, placed):
    """One scan. A row with missing or surplus cells stops the job, or is kept whole in ``bad_rows``."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]])
    raw = spark.read.schema(schema).options(**reader_options(encoding, multi_line)).csv(paths)
    origin = [_file_path().alias(source_col)] if source_col else []
    if placed:
        place = (_file_path(), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        origin += [c.alias(name) for c, name in zip(place, (_FILE, _BLOCK, _NUMBER), strict=True)]
    if bad_rows:
        return raw.select(*cols(names), _corrupt_text(names).alias(bad_rows), *origin)
    return raw.where(_fits(names, "the header")).select(*cols(names), *origin)


def _with_row_key(rows: DataFrame, name: str) -> DataFrame:
    """The key of a row, from the numbers that rows of a block have one after another.

    The first number of every block is one row of a small table, measured and joined like any other
    lookup table.
    """
    first = rows.groupBy(_FILE, _BLOCK).agg(F.min(_NUMBER).alias(OWN + "first"))
    found = lookup_join(rows, [_FILE, _BLOCK], first, "inner", staged=True)
    key = F.concat_ws(":", col(_FILE), col(_BLOCK), col(_NUMBER) - col(OWN + "first"))
    return found.select(*cols(c for c in rows.columns if c not in (_FILE, _BLOCK, _NUMBER)), key.alias(name))


def scan_without_header(spark: SparkSession, paths: str | list[str], names: list[str], encoding: str = "UTF-8") -> DataFrame:
    """CSV files that have no header row, their cells named ``names`` in order.

    A row with missing or surplus cells stops the job and names its file.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]])
    options = reader_options(encoding) | {"header": False, "enforceSchema": True}
    raw = spark.read.schema(schema).options(**options).csv([paths] if isinstance(paths, str) else list(paths))
    return raw.where(_fits(names, f"{len(names)} cells")).select(*cols(names))


def _corrupt_text(names: list[str]) -> Column:
    # Spark refuses a query of the raw text alone, so a part of the first cell, without a character, goes along.
    return F.concat(_CORRUPT, F.coalesce(F.substring(col(names[0]), 1, 0), F.lit("")))


def _fits(names: list[str], what: str) -> Column:
    """True for a row that has all its cells; any other one stops the job."""
    corrupt = _corrupt_text(names)
    message = F.concat(_file_path(), F.lit(f": a row does not fit {what}: "), corrupt)
    return F.when(corrupt.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True)


def _scan_groups(spark, paths, found, encoding, multi_line, bad_rows, source_col, keep, placed=False):
    """One scan per different header, columns matched by name."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, names in found.items():
        groups.setdefault(tuple(names), []).append(re.sub(r"([][{}*?\\])", r"\\\1", path))
    scans = []
    for names, files in groups.items():
        where = paths if len(groups) == 1 else files
        scan = _scan(spark, where, names, encoding, multi_line, bad_rows, source_col, placed)
        extra = [*filter(None, (bad_rows, source_col)), *((_FILE, _BLOCK, _NUMBER) if placed else ())]
        scans.append(scan.select(*cols([*(keep or names), *extra])))
    return reduce(lambda a, b: a.unionByName(b), scans)


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    encoding: str = "UTF-8",
    multi_line: bool = False,
    source_col: str | None = None,
    bad_rows: str | None = None,
    row_key: str | None = None,
) -> DataFrame:
    """Read CSV files that have the same columns, in any order, as one table of strings.

    A file with other columns is an error that names it. ``multi_line`` allows line breaks in
    quoted cells, at the price of one task per file. A row with missing or surplus cells stops the
    job and names its file; with ``bad_rows`` it is kept, its raw text in a column of that name,
    which is null for other rows. ``row_key`` names a column that tells the rows apart, the same in every
    run over the same files: file, place of the block in it, and place of the row in the block.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = headers(spark, paths, encoding)
    first = sorted(found)[0]
    for path, names in sorted(found.items()):
        if set(names) != set(found[first]):
            odd = sorted(set(names) ^ set(found[first]))
            raise ValueError(f"{path} has other columns than {first}: {', '.join(odd)}")
    if not row_key:
        return _scan_groups(spark, paths, found, encoding, multi_line, bad_rows, source_col, found[first])
    placed = _scan_groups(spark, paths, found, encoding, multi_line, bad_rows, source_col, found[first], placed=True)
    return _with_row_key(placed, row_key)


def read_csv_set(
    spark: SparkSession,
    paths: str | list[str],
    required: list[str],
    encoding: str = "UTF-8",
    multi_line: bool = False,
    source_col: str | None = None,
    bad_rows: str | None = None,
) -> DataFrame:
    """Read only the ``required`` columns of all listed files and folders; the files may have
    further columns. A file that lacks one is an error that names file and column. Rows that do
    not fit their header are treated as in :func:`read_csv`."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = headers(spark, paths, encoding)
    for path, names in sorted(found.items()):
        missing = [c for c in required if c not in names]
        if missing:
            raise ValueError(f"{path} lacks the column {', '.join(missing)}")
    return _scan_groups(spark, paths, found, encoding, multi_line, bad_rows, source_col, required)


def write_csv(
    df: DataFrame, path: str, encoding: str = "UTF-8", by: list[str] | None = None, packed: bool = False
) -> None:
    """Write a folder of CSV files; an existing one is an error. ``by`` gives each value of these
    columns a folder of its own. ``packed`` files (``.csv.gz``) take a third or less of the disk; every
    scan here reads them like plain ones."""
    writer = df.write.mode("errorifexists").options(**writer_options(encoding, packed))
    writer.partitionBy(*(by or [])).csv(path)


def write_delivery(delivered: DataFrame, root: str, day: str, encoding: str = "UTF-8", packed: bool = False) -> str:
    """The delivered rows, below ``<root>/<day>/result``."""
    path = f"{root}/{day}/result"
    write_csv(delivered, path, encoding, None, packed)
    return path


def write_logs(
    log: DataFrame, excluded: DataFrame, root: str, day: str, encoding: str = "UTF-8", packed: bool = False
) -> tuple[str, str]:
    """The fix log and the excluded rows, below ``<root>/<day>/log``."""
    paths = f"{root}/{day}/log/fixes", f"{root}/{day}/log/excluded"
    write_csv(log, paths[0], encoding, None, packed)
    write_csv(excluded, paths[1], encoding, None, packed)
    return paths
