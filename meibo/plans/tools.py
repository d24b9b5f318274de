"""The smaller jobs, from CSV folder to CSV folder. Output rows stay grouped by input file.

What a job stages on its way is deleted when its output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meibo.operators.exclude import exclude_names, exclude_suffix, first_reason, split
from meibo.operators.fill import AS_NAME, AS_PHONE, build_index, fill_by_key, fill_by_prefix
from meibo.operators.lookup import OWN
from meibo.operators.staging import discarding, stage
from meibo.plans.folder import process_folder, write_by_file
from meibo.sources.csv import read_csv, read_csv_set, write_csv

# The columns that job data must have (name, phone, contact).
JOB_NAME, JOB_TEL, JOB_CONTACT = "名称", "TEL", "担当者"


def fill_postal_codes(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    ref: DataFrame,
    postal: str,
    address: str,
    encoding: str = "UTF-8",
    multi_line: bool = False,
    bad_rows: str | None = None,
) -> None:
    """Fill blank postal codes in all files of a folder. The last three are as in ``read_csv``."""

    def op(rows: DataFrame) -> DataFrame:
        return fill_by_prefix(rows, postal, address, ref).drop("fill_status")

    with discarding(spark):
        write_by_file(process_folder(spark, in_dir, op, encoding, multi_line, bad_rows), out_dir, encoding)


def fill_recruiters(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    job_paths: list[str],
    name: str,
    tel: str,
    contact: str,
    encoding: str = "UTF-8",
    multi_line: bool = False,
    bad_rows: str | None = None,
) -> None:
    """Fill blank contact names in all files of a folder, from all job files.

    Name and phone together are tried first, then the phone, then the name.
    """
    jobs = read_csv_set(spark, job_paths, [JOB_NAME, JOB_TEL, JOB_CONTACT], encoding, multi_line)
    job_tiers = [{JOB_NAME: AS_NAME, JOB_TEL: AS_PHONE}, {JOB_TEL: AS_PHONE}, {JOB_NAME: AS_NAME}]
    tiers = [{name: AS_NAME, tel: AS_PHONE}, {tel: AS_PHONE}, {name: AS_NAME}]
    index = build_index(jobs, job_tiers, JOB_CONTACT)

    def op(rows: DataFrame) -> DataFrame:
        return fill_by_key(rows, contact, tiers, index).drop("fill_status")

    with discarding(spark):
        write_by_file(process_folder(spark, in_dir, op, encoding, multi_line, bad_rows), out_dir, encoding)


def exclude_chains(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    chains: DataFrame,
    name: str,
    match: str = "contains",
    suffix: str = "店",
    encoding: str = "UTF-8",
    multi_line: bool = False,
    bad_rows: str | None = None,
) -> None:
    """Write the rows of all files to ``kept`` and ``excluded`` below ``out_dir``."""

    def op(rows: DataFrame) -> DataFrame:
        rows = exclude_names(rows, name, chains, match, reason_col=OWN + "chain")
        return first_reason(exclude_suffix(rows, name, suffix, OWN + "branch"), [OWN + "chain", OWN + "branch"])

    with discarding(spark):
        rows = process_folder(spark, in_dir, op, encoding, multi_line, bad_rows)
        kept, excluded = split(stage(rows, "chains"))
        write_by_file(kept, f"{out_dir}/kept", encoding)
        write_by_file(excluded, f"{out_dir}/excluded", encoding)


def merge_files(
    spark: SparkSession,
    paths: list[str],
    out_dir: str,
    encoding: str = "UTF-8",
    multi_line: bool = False,
    bad_rows: str | None = None,
) -> None:
    """Write CSV files that have the same columns as one table."""
    write_csv(read_csv(spark, paths, encoding, multi_line, bad_rows=bad_rows), out_dir, encoding)
