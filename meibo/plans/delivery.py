"""The whole delivery job: fix, rules, exclusion, postal fill, checks, and the outputs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from meibo.functions.address import address_text
from meibo.functions.checks import Check
from meibo.functions.names import col, cols
from meibo.functions.text import digits, is_blank, match_text
from meibo.operators.area import check_area_code, check_area_of_address, code_table, corroborate, phone_table
from meibo.operators.audit import Fix, auto_fix, check, fix_log, remember
from meibo.operators.exclude import exclude_names, exclude_suffix, first_reason, name_table
from meibo.operators.fill import fill_by_prefix, prefix_table
from meibo.operators.lookup import BROADCAST_MAX_BYTES, OWN, Base, lookup_join
from meibo.operators.rules import TEXT_OPS, apply_rules, rule_table
from meibo.operators.staging import exists, move, sizes, stage
from meibo.sources.csv import read_csv, write_csv, write_delivery, write_logs

@dataclass
class DeliveryConfig:
    """What to do with ``rows``. A step whose reference data is missing is left out."""

    rows: DataFrame
    fixes: dict[str, list[Fix]] = field(default_factory=dict)
    customer: str = "customer"
    rules: DataFrame | None = None
    name: str = "name"
    chains: DataFrame | None = None
    chain_match: str = "contains"
    branch_suffix: str | None = "店"
    postal: str = "postal"
    address: str = "address"
    postal_ref: DataFrame | None = None
    tel: str = "tel"
    area: str = "area"
    # (code, area) to compare with the area column, or (code, place) to compare with the address.
    area_ref: DataFrame | None = None
    jobs: DataFrame | None = None
    jobs_tel: str = "TEL"
    checks: list[Check] = field(default_factory=list)
    # Columns of ``rows`` that tell its rows apart; without them the job numbers the rows.
    key: list[str] = field(default_factory=list)
    # No two rows share the key, and ``rows`` gives the same rows whenever it is read.
    key_is_unique: bool = False
    max_bytes: int = BROADCAST_MAX_BYTES


class Delivery(NamedTuple):
    """``delivered``: the kept rows. ``log``: their changed cells. ``excluded``: the other rows as
    they came in, with ``reason``. ``findings``: broken checks of the kept rows. All four carry the
    key columns, or ``row_id`` when the job has numbered the rows itself."""

    delivered: DataFrame
    log: DataFrame
    excluded: DataFrame
    findings: DataFrame


# The code that a text leads to, and where a phone number should be.
CODE, AT = OWN + "told_code", OWN + "told_at"

# Names of the columns that the job adds beside those of the input.
ADDED = {"row_id", "before", "reason", "verdict", "seen_in_jobs"}


def key_of(cfg: DeliveryConfig) -> list[str]:
    """The columns by which the outputs are joined."""
    return cfg.key or ["row_id"]


def touched(cfg: DeliveryConfig) -> list[str]:
    """The columns that the job may change."""
    changed = set(cfg.fixes) | ({cfg.postal} if cfg.postal_ref is not None else set())
    return [c for c in cfg.rows.columns if c in changed]


def prepared(cfg: DeliveryConfig) -> dict:
    """The reference tables of the steps that the job takes, each measured once."""
    limit = cfg.max_bytes
    given = {
        "rules": (cfg.rules, lambda x: rule_table(x, cfg.rows.columns, limit)),
        "chains": (cfg.chains, lambda x: name_table(x, cfg.chain_match, max_bytes=limit)),
        "postal": (cfg.postal_ref, lambda x: prefix_table(x, limit)),
        "areas": (cfg.area_ref, lambda x: code_table(x, limit)),
        "jobs": (cfg.jobs, lambda x: phone_table(x, cfg.jobs_tel, limit)),
    }
    return {name: make(ref) for name, (ref, make) in given.items() if ref is not None}


def _small(tables: dict) -> bool:
    return all(t.small for t in tables.values())


def _with_texts(rows: DataFrame, cfg: DeliveryConfig, tables: dict) -> tuple[DataFrame, dict[str, str], str | None, str | None]:
    """The rows with the spellings that the steps compare, each made once and all in one projection: the
    columns of the spelled texts, of the phone's digits and of the address where it is looked up."""
    wanted = {column for op, column in tables["rules"].kinds if op in TEXT_OPS} if "rules" in tables else set()
    if "chains" in tables:
        wanted.add(cfg.name)
    if "areas" in tables and "area" in cfg.area_ref.columns:
        wanted.add(cfg.area)
    texts = {c: f"{OWN}spelled{i}" for i, c in enumerate(sorted(wanted))}
    made = {name: match_text(col(c).cast("string")) for c, name in texts.items()}
    number = OWN + "number" if "areas" in tables or "jobs" in tables else None
    if number:
        made[number] = digits(col(cfg.tel))
    address = OWN + "spelled" if "postal" in tables else None
    if address:
        made[address] = address_text(F.when(is_blank(col(cfg.postal)), col(cfg.address)))
    return rows.withColumns(made), texts, number, address


def _told(base: Base, subject: list[str], label: str) -> DataFrame:
    """The different values that the rows have in ``subject``, staged. A step answers these once, however many rows share them."""
    present = reduce(and_, [c.isNotNull() for c in cols(subject)])
    return stage(base.rows.select(*cols(subject)).where(present).distinct(), label)


def _excluded_names(rows: DataFrame, cfg: DeliveryConfig, tables: dict, texts: dict[str, str], base: Base) -> DataFrame:
    """:func:`exclude_names` with a list too large to mark rows where they lie."""
    text, reason = texts[cfg.name], OWN + "chain"
    told = exclude_names(_told(base, [text], "told-names"), text, tables["chains"], reason_col=reason, max_bytes=cfg.max_bytes, texts={text: text})
    return lookup_join(rows, [text], told.where(col(reason).isNotNull()), max_bytes=cfg.max_bytes, base=base)


def _filled_postal(rows: DataFrame, cfg: DeliveryConfig, tables: dict, address: str, base: Base) -> DataFrame:
    """:func:`fill_by_prefix` of the rows without a reason, with a table too large to broadcast."""
    told = _told(base, [address], "told-addresses").withColumn(CODE, F.lit(None).cast("string"))
    told = fill_by_prefix(told, CODE, address, tables["postal"], max_bytes=cfg.max_bytes, spelled=address, staged=True)
    told = told.where("fill_status = 'filled'").drop("fill_status")
    # A row whose cell is not blank has no text in ``address``.
    asked = rows.withColumn(address, F.when(F.col("reason").isNull(), col(address)))
    found = lookup_join(asked, [address], told, max_bytes=cfg.max_bytes, base=base)
    filled = F.when(col(CODE).isNotNull(), col(CODE)).otherwise(col(cfg.postal))
    return found.withColumn(cfg.postal, filled).drop(CODE)


def _checked_phones(rows: DataFrame, cfg: DeliveryConfig, tables: dict, texts: dict[str, str], number: str, base: Base) -> DataFrame:
    """The verdict and the evidence by one join, with a table too large to broadcast."""
    limit, subject, told_of, by_area = cfg.max_bytes, [number], rows, False
    if "areas" in tables:
        by_area = "area" in cfg.area_ref.columns
        # A blank is a value here: it is no listed area, and no address begins in a listed place with it.
        at = F.coalesce(col(texts[cfg.area] if by_area else cfg.address).cast("string"), F.lit(""))
        subject, told_of, base = [number, AT], rows.withColumn(AT, at), base._replace(rows=base.rows.withColumn(AT, at))
    told = _told(base, subject, "told-phones")
    if "areas" in tables and by_area:
        told = check_area_code(told, number, AT, tables["areas"], max_bytes=limit, number=number, texts={AT: AT}, staged=True)
    elif "areas" in tables:
        told = check_area_of_address(told, number, AT, tables["areas"], max_bytes=limit, number=number, staged=True)
    if "jobs" in tables:
        told = corroborate(told, number, tables["jobs"], max_bytes=limit, number=number)
    found = lookup_join(told_of, subject, told, max_bytes=limit, base=base)
    if "jobs" in tables:
        found = found.withColumn("seen_in_jobs", F.coalesce("seen_in_jobs", F.lit(False)))
    return found


def answers(rows: DataFrame, cfg: DeliveryConfig, tables: dict, spelled: tuple, base: Base | None = None) -> DataFrame:
    """``rows`` with what the steps find: the reason, the filled postal code, verdict and evidence.

    ``rows`` have the columns ``spelled`` of :func:`_with_texts`. Steps with a table too large to broadcast
    answer the different values of the ``base``; so the rows go through all steps at once, and are not staged between them.
    """
    limit, reasons = cfg.max_bytes, []
    texts, number, address = spelled
    if "rules" in tables:
        rows = apply_rules(rows, cfg.customer, tables["rules"], reason_col=OWN + "rule", max_bytes=limit, texts=texts, base=base)
        reasons.append(OWN + "rule")
    if "chains" in tables:
        if tables["chains"].small:
            rows = exclude_names(rows, cfg.name, tables["chains"], reason_col=OWN + "chain", max_bytes=limit, texts=texts)
        else:
            rows = _excluded_names(rows, cfg, tables, texts, base)
        reasons.append(OWN + "chain")
    if cfg.branch_suffix:
        rows = exclude_suffix(rows, cfg.name, cfg.branch_suffix, OWN + "branch")
        reasons.append(OWN + "branch")
    if reasons:
        rows = first_reason(rows, reasons)
    else:
        rows = rows.withColumn("reason", F.lit(None).cast("string"))
    if "postal" in tables and tables["postal"].small:
        kept = F.col("reason").isNull()
        rows = fill_by_prefix(rows, cfg.postal, cfg.address, tables["postal"], only=kept, max_bytes=limit, spelled=address)
        rows = rows.drop("fill_status")
    elif "postal" in tables:
        rows = _filled_postal(rows, cfg, tables, address, base)
    phones = {name: tables[name] for name in ("areas", "jobs") if name in tables}
    if not _small(phones):
        return _checked_phones(rows, cfg, phones, texts, number, base)
    if "areas" in tables:
        if "area" in cfg.area_ref.columns:
            rows = check_area_code(rows, cfg.tel, cfg.area, tables["areas"], max_bytes=limit, number=number, texts=texts)
        else:
            rows = check_area_of_address(rows, cfg.tel, cfg.address, tables["areas"], max_bytes=limit, number=number)
    if "jobs" in tables:
        rows = corroborate(rows, cfg.tel, tables["jobs"], max_bytes=limit, number=number)
    return rows


def _looked_up(cfg: DeliveryConfig, tables: dict) -> list[str]:
    """The columns that the steps read beside the spelled ones."""
    wanted = set()
    if "rules" in tables:
        wanted |= {cfg.customer} | {column for _, column in tables["rules"].kinds}
    if cfg.branch_suffix:
        wanted.add(cfg.name)
    if "postal" in tables:
        wanted.add(cfg.postal)
    if "areas" in tables and "area" not in cfg.area_ref.columns:
        wanted.add(cfg.address)
    # Tables that are broadcast meet the rows by the columns themselves.
    if "postal" in tables and tables["postal"].small:
        wanted.add(cfg.address)
    if "areas" in tables and tables["areas"].small:
        wanted.add(cfg.tel)
        wanted |= {cfg.area} if "area" in cfg.area_ref.columns else set()
    if "jobs" in tables and tables["jobs"].small:
        wanted.add(cfg.tel)
    if "chains" in tables:
        wanted.add(cfg.name)
    return [c for c in cfg.rows.columns if c in wanted]


def judge(cfg: DeliveryConfig) -> DataFrame:
    """Every input row with its cells before and after, its reason and its findings.

    With reference tables small enough to broadcast, the steps add columns to the rows where they lie
    and nothing is shuffled. With a larger one the steps answer the different values of the cells they read. Rows
    of which they read at least half the columns take these answers as they are; of wider rows, and of those with a
    unique key, the key and the cells read do, and are joined to the whole rows once, at the end.
    """
    columns = cfg.rows.columns
    taken = [c for c in columns if c.lower() in ADDED]
    if taken:
        raise ValueError(f"rename the input column {', '.join(taken)}; the job adds one of that name")
    moved = [c for c in cfg.key if c in touched(cfg) or c not in columns]
    if moved:
        raise ValueError(f"no stable key column: {', '.join(moved)}")
    rows = remember(cfg.rows, touched(cfg)) if touched(cfg) else cfg.rows
    rows = auto_fix(rows.withColumn("row_id", F.monotonically_increasing_id()), cfg.fixes)
    tables = prepared(cfg)
    before = ["before"] if touched(cfg) else []
    found = [*(["verdict"] if "areas" in tables else []), *(["seen_in_jobs"] if "jobs" in tables else [])]
    rows, *spelled = _with_texts(rows, cfg, tables)
    if _small(tables):
        return answers(rows, cfg, tables, spelled).select("row_id", *before, *cols(columns), "reason", *found)
    by = cfg.key if cfg.key and cfg.key_is_unique else ["row_id"]
    made = [c for c in rows.columns if c not in ["row_id", *before, *columns]]
    read = [*_looked_up(cfg, tables), *made]
    narrow = rows.select(*cols(dict.fromkeys([*by, *read])))
    if by == ["row_id"]:  # the number must be the same in every reading
        rows = stage(rows, "delivery-rows")
        narrow = rows.select(*cols(narrow.columns))
        many = "rules" in tables and tables["rules"].many
        if 2 * len(read) >= len(columns) and not many:
            told = answers(rows, cfg, tables, spelled, Base(narrow, by))
            return told.select("row_id", *before, *cols(columns), "reason", *found)
    else:
        narrow = stage(narrow, "delivery-cells")
    filled = [cfg.postal] if "postal" in tables else []
    # A key may hold nulls.
    of = {c: OWN + c for c in by}
    told = answers(narrow, cfg, tables, spelled, Base(narrow, by))
    told = told.select(*[col(c).alias(o) for c, o in of.items()], *cols(filled), "reason", *found)
    whole = rows.select("row_id", *before, *cols(c for c in columns if c not in filled))
    same = reduce(and_, [col(c).eqNullSafe(col(o)) for c, o in of.items()])
    return whole.join(told, same).select("row_id", *before, *cols(columns), "reason", *found)


def run_delivery(cfg: DeliveryConfig) -> Delivery:
    """Judge all rows once, into a staged table; the outputs read from it."""
    columns, changed = cfg.rows.columns, touched(cfg)
    judged = stage(judge(cfg), "delivery")
    kept = judged.where(F.col("reason").isNull())
    excluded = judged.where(F.col("reason").isNotNull())
    came_in = [F.col("before")[c].alias(c) if c in changed else col(c) for c in columns]
    checks = list(cfg.checks)
    if cfg.area_ref is not None:
        for verdict in ("mismatch", "unknown_code"):
            wrong = F.col("verdict") == verdict
            checks.append(Check(f"area_code_{verdict}", cfg.tel, lambda c, wrong=wrong: wrong))
    evidence = ["seen_in_jobs"] if cfg.jobs is not None else []
    key, number = key_of(cfg), [] if cfg.key else ["row_id"]
    return Delivery(
        delivered=kept.select(*number, *cols(columns)),
        log=fix_log(kept, key, changed),
        excluded=excluded.select(*number, *came_in, "reason"),
        findings=check(kept, [*key, *evidence], checks),
    )


OUTPUTS = ["result", "log/fixes", "log/excluded", "log/findings"]
MANIFEST = "manifest"
MANIFEST_SCHEMA = "output string, rows long, files map<string, long>"


def export(delivery: Delivery, root: str, day: str, encoding: str = "UTF-8", packed: bool = False) -> None:
    """Write the result and the logs below ``<root>/<day>``, all of them or none.

    The outputs are written to a folder of this run, and last its manifest, which has the number of rows
    of every output, and its files with their bytes. Then the folder becomes ``<root>/<day>`` by one rename. An export that breaks
    off leaves nothing there and is simply repeated; a finished one is never written over. Where a
    store renames file by file, ``<root>/<day>`` is whole once :func:`exported` finds all it lists.
    ``packed`` is as in :func:`write_csv`.
    """
    spark = delivery.delivered.sparkSession
    target = f"{root.rstrip('/')}/{day}"
    if exists(spark, target):
        raise ValueError(f"{target} is there already")
    runs, run = f"{root.rstrip('/')}/_runs", f"{day}-{uuid.uuid4().hex}"
    seen = [Observation() for _ in OUTPUTS]
    parts = [delivery.delivered, delivery.log, delivery.excluded, delivery.findings]
    result, log, excluded, findings = (
        part.observe(count, F.count(F.lit(1)).alias("rows")) for part, count in zip(parts, seen, strict=True)
    )
    write_delivery(result, runs, run, encoding, packed)
    write_logs(log, excluded, runs, run, encoding, packed)
    write_csv(findings, f"{runs}/{run}/log/findings", encoding, None, packed)
    counts = [(name, count.get["rows"], sizes(spark, f"{runs}/{run}/{name}")) for name, count in zip(OUTPUTS, seen, strict=True)]
    spark.createDataFrame(counts, MANIFEST_SCHEMA).coalesce(1).write.json(f"{runs}/{run}/{MANIFEST}")
    move(spark, f"{runs}/{run}", target)


def exported(spark: SparkSession, root: str, day: str, encoding: str = "UTF-8") -> dict[str, DataFrame]:
    """The outputs of a finished export, by name. One whose rows are not all there is an error.

    The files that the export wrote must be there in their full length, and no others; so no row is read for it.
    The rows are counted where a manifest names no files.
    """
    target = f"{root.rstrip('/')}/{day}"
    found = {}
    for row in spark.read.schema(MANIFEST_SCHEMA).json(f"{target}/{MANIFEST}").collect():
        path = f"{target}/{row['output']}"
        whole = row["files"] is None or sizes(spark, path) == row["files"]
        if whole:
            found[row["output"]] = read_csv(spark, path, encoding, multi_line=True)
            whole = row["files"] is not None or found[row["output"]].count() == row["rows"]
        if not whole:
            raise ValueError(f"{path} has not the {row['rows']} rows of its manifest")
    return found
