"""The operators as queries over the given tables; ``oracle.py`` has the same in SQL.

Each query takes (spark, folder of the Parquet tables) and returns a DataFrame. All run over whole
tables. The tables hold no blanks, phones or addresses, so these are derived from other columns.
Names that end in ``_shuffled`` force the form for reference data too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.functions import checks as C
from meibo.functions import text as X
from meibo.operators.area import check_area_code, check_area_of_address, corroborate
from meibo.operators.audit import auto_fix, check, fix_log, remember
from meibo.operators.exclude import exclude_names, exclude_suffix, first_reason, split
from meibo.operators.fill import (
    AS_COMPANY,
    AS_NAME,
    AS_PHONE,
    build_index,
    fill_by_key,
    fill_by_near_name,
    fill_by_prefix,
    near_index,
)
from meibo.operators.kept_index import KeptIndex
from meibo.operators.lookup import BROADCAST_MAX_BYTES
from meibo.operators.merge import merge
from meibo.operators.rules import apply_rules
from meibo.operators.staging import discarding, ending_shuffles, new_path
from meibo.plans.delivery import Delivery, DeliveryConfig, export, exported, run_delivery
from meibo.plans.folder import process_folder, write_by_file
from meibo.plans.tools import exclude_chains, fill_postal_codes, fill_recruiters, merge_files
from meibo.sources.csv import read_csv, read_csv_set, write_csv
from meibo.sources.reference import read_name_list, read_postal_ref, read_prefix_ref, read_rules
from meibo.streaming.intake import process_new_files

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(column: str, width: int) -> Column:
    return F.lpad(F.col(column).cast("string"), width, "0")


# ---- postal codes (longest prefix) ---------------------------------------------------------


def part_address() -> Column:
    """Most parts have an address that is listed in full; of some only the beginning is listed, of some nothing."""
    kind = F.col("p_type")
    word = F.substring_index("p_name", " ", 1)
    return (
        F.when(kind == "ECONOMY", F.concat(F.lit("x "), "p_name"))
        .when(kind.isin("LARGE", "SMALL"), F.concat_ws(" ", word, kind))
        .otherwise(F.concat_ws(" ", "p_name", kind))
    )


def part_addresses(spark, sf_dir) -> DataFrame:
    blank = F.when(F.col("p_size") <= 15, None).when(F.col("p_size") <= 30, "　")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        part_address().alias("address"),
        blank.when(F.col("p_size") > 30, F.col("p_brand")).alias("postal"),
    )


def part_postal_ref(spark, sf_dir) -> DataFrame:
    """Two prefixes of every part: the first word of its name, and name and type, which may have two codes."""
    part = table(spark, sf_dir, "part")
    word = F.substring_index("p_name", " ", 1)
    wide = part.select(word.alias("prefix"), F.concat(F.lit("W"), word).alias("code"))
    large = (F.col("p_size") == 50).cast("int")
    narrow = part.select(F.concat_ws(" ", "p_name", "p_type").alias("prefix"), F.concat(F.lit("N"), large).alias("code"))
    return wide.union(narrow)


def _postal_fill(spark, sf_dir, max_bytes):
    rows = part_addresses(spark, sf_dir)
    ref = part_postal_ref(spark, sf_dir)
    return fill_by_prefix(rows, "postal", "address", ref, max_bytes=max_bytes)


@query
def postal_fill(spark, sf_dir):
    return _postal_fill(spark, sf_dir, BROADCAST_MAX_BYTES)


@query
def postal_fill_shuffled(spark, sf_dir):
    return _postal_fill(spark, sf_dir, 0)


# Numbers from 1 to 50 as they are written in addresses.
TENS, ONES = ["", "十", "二十", "三十", "四十", "五十"], ["", "一", "二", "三", "四", "五", "六", "七", "八", "九"]


def _kanji(number: Column) -> Column:
    tens, ones = (F.element_at(F.array(*[F.lit(x) for x in side]), at + 1) for side, at in ((TENS, F.floor(number / 10).cast("int")), (ONES, number % 10)))
    return F.concat(tens, ones)


def town_file(spark, sf_dir) -> str:
    """Towns of all parts in the layout of the public postal-code file.

    A town is a brand. Towns of an even number have a code for their lower blocks, one for the next and one
    for the rest, those of an odd number one for the lower lots and one for the higher ones; the
    bounds come from the sizes of the parts.
    """
    part = table(spark, sf_dir, "part").withColumn("no", F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int"))
    towns = part.groupBy("p_brand", "no").agg(F.floor(F.avg("p_size")).cast("int").alias("mid"), F.max("p_size").alias("top"))
    mid = F.col("mid")
    wide = F.translate(mid.cast("string"), "0123456789", X.WIDE_DIGITS)

    def remarks(*texts: list) -> Column:
        parts = [F.concat(F.lit("（"), *[t if isinstance(t, Column) else F.lit(t) for t in text], F.lit("）")) for text in texts]
        return F.array(*[F.struct(part.alias("remark"), F.lit(i + 1).alias("part")) for i, part in enumerate(parts)])

    after, then, end, last = ((x).cast("string") for x in (mid + 1, mid + 2, F.col("top") - 1, F.col("top")))
    blocks = remarks(["１～", wide, "丁目"], [after, "、", then, "～", end, "丁目"], ["その他"])
    lots = remarks([wide, "番地以下"], [after, "～", last, "番地"])
    rows = F.explode(F.when(F.col("no") % 2 == 0, blocks).otherwise(lots)).alias("row")
    empty = [F.lit("").alias(f"c{i}") for i in range(12)]
    code = F.concat(F.lit("9"), F.lpad(F.col("no").cast("string"), 5, "0"), F.col("row.part").cast("string"))
    raw = towns.select("no", "p_brand", rows).select(
        *empty[:2], code.alias("code"), *empty[2:5], F.lit("東京都").alias("prefecture"), F.lit("港区").alias("city"),
        F.concat("p_brand", F.lit("町"), "row.remark").alias("town"), *empty[5:11],
    )
    path = new_path(spark, "towns")
    raw.write.csv(path)
    return path


def _postal_fill_ranges(spark, sf_dir, max_bytes):
    ref = read_postal_ref(spark, town_file(spark, sf_dir), ranges=True)
    number = F.col("p_size")
    digits = number.cast("string")
    kind = F.col("p_type")
    even = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int") % 2 == 0
    written = (
        F.when(kind == "ECONOMY", F.concat(_kanji(number), F.when(even, "丁目二番").otherwise("番地の二")))
        .when(kind == "SMALL", F.concat(F.translate(digits, "0123456789", X.WIDE_DIGITS), F.lit("－１"), F.lit("－７")))
        .when(kind == "PROMO", "")
        .otherwise(F.concat(digits, F.when(even, "丁目").otherwise("番")))
    )
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.when(kind == "LARGE", "").otherwise("東京都"), F.lit("港区大字"), "p_brand", F.lit("町"), written).alias("address"), F.lit("").alias("postal")
    )
    return fill_by_prefix(rows, "postal", "address", ref, max_bytes=max_bytes)


@query
def postal_fill_ranges(spark, sf_dir):
    """Towns with several codes, decided by the block or lot number of the address in any spelling."""
    return _postal_fill_ranges(spark, sf_dir, BROADCAST_MAX_BYTES)


@query
def postal_fill_ranges_shuffled(spark, sf_dir):
    return _postal_fill_ranges(spark, sf_dir, 0)


# ---- area codes ----------------------------------------------------------------------------


def customer_phones(spark, sf_dir) -> DataFrame:
    segment = F.col("c_mktsegment")
    shift = F.when(segment == "BUILDING", 1).when(segment == "FURNITURE", 2).when(segment == "MACHINERY", 50)
    code = F.lpad((F.col("c_nationkey") + shift.otherwise(0)).cast("string"), 2, "0")
    tel = F.concat(F.lit("0"), code, F.lit("-"), _number("c_custkey", 7))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= -500, tel).alias("tel"),
        F.concat(F.lit("A"), "c_nationkey").alias("area"),
    )


def nation_area_codes(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey")
    )
    code = F.concat(F.lit("0"), _number("n_nationkey", 2))
    area = F.concat(F.lit("A"), "n_nationkey")
    neighbour = F.concat(F.lit("A"), (F.col("n_nationkey") - 1).cast("string"))
    region = F.col("r_name")
    return (
        nation.select(code.alias("code"), area.alias("area"))
        .union(nation.where(region == "ASIA").select(code, neighbour))
        .union(nation.where(region == "AFRICA").select(F.concat(code, F.lit("000")), neighbour))
    )


def _area_code_check(spark, sf_dir, max_bytes):
    rows = customer_phones(spark, sf_dir)
    ref = nation_area_codes(spark, sf_dir)
    return check_area_code(rows, "tel", "area", ref, max_bytes=max_bytes)


@query
def area_code_check(spark, sf_dir):
    return _area_code_check(spark, sf_dir, BROADCAST_MAX_BYTES)


@query
def area_code_check_shuffled(spark, sf_dir):
    return _area_code_check(spark, sf_dir, 0)


def _area_code_address(spark, sf_dir, max_bytes):
    """Customers with an address and no area column, against a list of codes and places."""
    customer = customer_phones(spark, sf_dir).drop("area").join(table(spark, sf_dir, "customer"), "c_custkey")
    nation = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.lit(" "))
    segment = F.col("c_mktsegment")
    address = F.when(segment == "AUTOMOBILE", F.concat(F.lit("c/o "), nation)).when(segment != "HOUSEHOLD", nation).otherwise("NATION_1 ")
    rows = customer.select("c_custkey", "tel", F.concat(address, F.lit("1-2-3")).alias("address"))
    codes = nation_area_codes(spark, sf_dir)
    place = F.concat(F.lit("NATION_"), F.substring("area", 2, 9), F.lit(" "))
    ref = codes.select("code", place.alias("place")).union(codes.select("code", F.lit("NATION_").alias("place")).where("code = '003'"))
    return check_area_of_address(rows, "tel", "address", ref, max_bytes=max_bytes)


@query
def area_code_address(spark, sf_dir):
    return _area_code_address(spark, sf_dir, BROADCAST_MAX_BYTES)


@query
def area_code_address_shuffled(spark, sf_dir):
    return _area_code_address(spark, sf_dir, 0)


# ---- job data ------------------------------------------------------------------------------


def order_jobs(spark, sf_dir, only: str = "true") -> DataFrame:
    """Orders as job postings: name, phone or both are known, and some carry a contact."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").where(only).select(
        F.when(status != "F", F.concat(F.lit("Customer#"), _number("o_custkey", 9))).alias("名称"),
        F.when(status != "O", F.concat(F.lit("0"), _number("o_custkey", 9))).alias("TEL"),
        F.when(F.col("o_totalprice") > 400000, F.col("o_orderpriority")).otherwise("").alias("担当者"),
    )


JOB_TIERS = [{"名称": AS_NAME, "TEL": AS_PHONE}, {"TEL": AS_PHONE}, {"名称": AS_NAME}]
ROW_TIERS = [{"c_name": AS_NAME, "tel": AS_PHONE}, {"tel": AS_PHONE}, {"c_name": AS_NAME}]


def customer_contacts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_name",
        F.concat_ws("-", F.lit("０"), _number("c_custkey", 9)).alias("tel"),
        F.when(F.col("c_mktsegment") == "BUILDING", "known").alias("contact"),
    )


def _recruiter_index_fill(spark, sf_dir, max_bytes):
    rows = customer_contacts(spark, sf_dir)
    index = build_index(order_jobs(spark, sf_dir), JOB_TIERS, "担当者")
    return fill_by_key(rows, "contact", ROW_TIERS, index, max_bytes=max_bytes)


@query
def recruiter_index(spark, sf_dir):
    return build_index(order_jobs(spark, sf_dir), JOB_TIERS, "担当者")


@query
def recruiter_index_fill(spark, sf_dir):
    return _recruiter_index_fill(spark, sf_dir, BROADCAST_MAX_BYTES)


@query
def recruiter_index_fill_shuffled(spark, sf_dir):
    return _recruiter_index_fill(spark, sf_dir, 0)


@query
def recruiter_index_kept(spark, sf_dir):
    """The index from three batches of job data: two compacted, one more, and one taken back."""
    index = KeptIndex(spark, new_path(spark, "kept-index"), JOB_TIERS, "担当者", buckets=4)
    index.add("final", order_jobs(spark, sf_dir, "o_orderstatus <=> 'F'"))
    index.add("mistake", order_jobs(spark, sf_dir).withColumn("担当者", F.lit("nobody")))
    index.add("open", order_jobs(spark, sf_dir, "o_orderstatus <=> 'O'"))
    index.compact()
    index.add("other", order_jobs(spark, sf_dir, "o_orderstatus is null or o_orderstatus not in ('F', 'O')"))
    index.take_back("mistake")
    index.add("final", order_jobs(spark, sf_dir))
    index.compact()
    return index.table()


def _recruiter_near_fill(spark, sf_dir, max_bytes):
    """Contacts by part names that have another legal form, a character changed, or one left out."""
    part = table(spark, sf_dir, "part")
    jobs = part.select(
        F.concat(F.lit("株式会社"), "p_name").alias("名称"),
        F.when(F.length("p_name") % 3 > 0, F.concat(F.lit("C"), "p_name")).otherwise(F.col("p_type")).alias("担当者"),
    )
    size, name = F.col("p_size"), F.col("p_name")
    at = size % 5 + 1
    head, tail = F.substring(name, F.lit(1), at - 1), F.substr(name, at + 1)
    written = (
        F.when(size % 4 == 0, F.concat(name, F.lit("（有）")))
        .when(size % 4 == 1, F.concat(head, F.lit("ｚ"), tail))
        .when(size % 4 == 2, F.concat(head, tail))
        .otherwise(F.concat(F.lit("qq"), name))
    )
    rows = part.select("p_partkey", written.alias("name"), F.when(F.col("p_type") == "PROMO", "known").alias("contact"))
    tiers = [{"name": AS_NAME}]
    exact = fill_by_key(rows, "contact", tiers, build_index(jobs, [{"名称": AS_NAME}], "担当者"), max_bytes=max_bytes)
    index = near_index(jobs, "名称", "担当者", AS_COMPANY)
    return fill_by_near_name(exact, "contact", "name", index, AS_COMPANY, max_bytes=max_bytes)


@query
def recruiter_near_fill(spark, sf_dir):
    return _recruiter_near_fill(spark, sf_dir, BROADCAST_MAX_BYTES)


@query
def recruiter_near_fill_shuffled(spark, sf_dir):
    return _recruiter_near_fill(spark, sf_dir, 0)


def _job_evidence(spark, sf_dir, max_bytes):
    rows = table(spark, sf_dir, "customer")
    # Numbers that begin with 1 stand in no posting.
    first = F.when(F.col("c_mktsegment") == "BUILDING", "1").otherwise("0")
    rows = rows.select("c_custkey", F.concat(first, _number("c_custkey", 9)).alias("tel"))
    return corroborate(rows, "tel", order_jobs(spark, sf_dir), max_bytes=max_bytes)


@query
def job_evidence(spark, sf_dir):
    return _job_evidence(spark, sf_dir, BROADCAST_MAX_BYTES)


@query
def job_evidence_shuffled(spark, sf_dir):
    return _job_evidence(spark, sf_dir, 0)


# ---- exclusion -----------------------------------------------------------------------------


def part_shops(spark, sf_dir) -> DataFrame:
    name = F.concat_ws(" ", "p_brand", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


def part_chains(spark, sf_dir) -> DataFrame:
    hot = table(spark, sf_dir, "part").where(F.col("p_name").startswith("hot"))
    listed = F.explode(F.array("p_name", F.lit(""), F.lit("　"), F.lit(" bolt ")))
    return hot.select(listed.alias("name"))


def _chain_exclude_contains(spark, sf_dir, **limits):
    shops, chains = part_shops(spark, sf_dir), part_chains(spark, sf_dir)
    return exclude_names(shops, "name", chains, "contains", **limits)


@query
def chain_exclude_contains(spark, sf_dir):
    return _chain_exclude_contains(spark, sf_dir)


@query
def chain_exclude_contains_joined(spark, sf_dir):
    return _chain_exclude_contains(spark, sf_dir, max_in_pattern=0)


@query
def chain_exclude_contains_shuffled(spark, sf_dir):
    return _chain_exclude_contains(spark, sf_dir, max_in_pattern=0, max_bytes=0)


def _chain_exclude_exact(spark, sf_dir, max_bytes):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    marked = exclude_names(
        rows, "p_name", part_chains(spark, sf_dir), "exact", max_bytes=max_bytes
    )
    return split(marked)[0]


@query
def chain_exclude_exact(spark, sf_dir):
    return _chain_exclude_exact(spark, sf_dir, BROADCAST_MAX_BYTES)


@query
def chain_exclude_exact_shuffled(spark, sf_dir):
    return _chain_exclude_exact(spark, sf_dir, 0)


@query
def branch_exclude(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return split(exclude_suffix(rows, "p_name", "ring"))[1]


@query
def kept_and_excluded(spark, sf_dir):
    """Both sides of the split, the chain list coming before the branch names."""
    shops = part_shops(spark, sf_dir)
    marked = exclude_names(shops, "name", part_chains(spark, sf_dir), reason_col="chain")
    marked = exclude_suffix(marked, "name", "SMALL", "branch")
    kept, excluded = split(first_reason(marked, ["chain", "branch"]))
    return kept.withColumn("reason", F.lit("kept")).unionByName(excluded)


# ---- rules, fixes and checks ---------------------------------------------------------------

SEGMENT_RULES = [
    ("BUILDING", "c_acctbal", "min", "0"),
    ("BUILDING", "c_name", "exclude_suffix", "7"),
    ("BUILDING", "c_name", "exclude_contains", "99"),
    ("MACHINERY", "c_name", "exclude_prefix", "Customer#00000000"),
    ("MACHINERY", "c_acctbal", "max", "9000"),
    ("FURNITURE", "c_nationkey", "exclude_value", "3"),
    ("FURNITURE", "c_name", "max_length", "18"),
    ("HOUSEHOLD", "c_name", "required", ""),
]


def _customer_rules(spark, sf_dir, max_bytes):
    rows = table(spark, sf_dir, "customer")
    rules = spark.createDataFrame(SEGMENT_RULES, "customer string, column string, op string, arg string")
    marked = apply_rules(rows, "c_mktsegment", rules, max_bytes=max_bytes)
    return marked.select("c_custkey", F.coalesce("reason", F.lit("pass")).alias("outcome"))


@query
def customer_rules_many(spark, sf_dir):
    """Thousands of rules on one customer: every name that an order of low priority was made by."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'")
    rules = orders.select(
        F.lit("BUILDING").alias("customer"),
        F.lit("c_name").alias("column"),
        F.lit("exclude_value").alias("op"),
        F.concat(F.lit("ＣＵＳＴＯＭＥＲ＃"), _number("o_custkey", 9)).alias("arg"),
    )
    least = orders.select(
        F.lit("BUILDING"), F.lit("c_acctbal"), F.lit("min"), F.translate(F.pmod("o_orderkey", F.lit(500)).cast("string"), "0123456789", "０１２３４５６７８９")
    )
    marked = apply_rules(table(spark, sf_dir, "customer"), "c_mktsegment", rules.union(least))
    return marked.select("c_custkey", F.coalesce("reason", F.lit("pass")).alias("outcome"))


@query
def customer_rules_many_texts(spark, sf_dir):
    """Thousands of texts that a name may begin with, end in or contain, each kind for one customer."""
    orders = table(spark, sf_dir, "orders")
    priority, key = F.col("o_orderpriority"), _number("o_custkey", 9)
    op = F.when(priority == "1-URGENT", "exclude_contains").when(priority == "2-HIGH", "exclude_prefix").when(priority == "3-MEDIUM", "exclude_suffix")
    arg = F.when(priority == "1-URGENT", key).when(priority == "2-HIGH", F.concat(F.lit("customer#"), key)).otherwise(F.right(key, F.lit(5)))
    customer = F.when(priority == "1-URGENT", "HOUSEHOLD").when(priority == "2-HIGH", "MACHINERY").otherwise("FURNITURE")
    rules = orders.where((priority <= "3-MEDIUM") & (F.col("o_totalprice") > 300000)).select(
        customer.alias("customer"), F.lit("c_name").alias("column"), op.alias("op"), arg.alias("arg")
    )
    marked = apply_rules(table(spark, sf_dir, "customer"), "c_mktsegment", rules)
    return marked.select("c_custkey", F.coalesce("reason", F.lit("pass")).alias("outcome"))


@query
def matching_spelling(spark, sf_dir):
    """Names are found in whatever width, case and spacing they are written."""
    part = table(spark, sf_dir, "part")
    wide = F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ　")
    names = part.where("p_size <= 10").select(F.concat(F.lit("マクドナルド"), wide).alias("name"))
    half = F.concat(F.lit("ﾏｸﾄﾞﾅﾙﾄﾞ"), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit("\u0001"))
    return exclude_names(part.select("p_partkey", half.alias("name")), "name", names, "exact").select("p_partkey", "reason")


@query
def customer_rules(spark, sf_dir):
    return _customer_rules(spark, sf_dir, BROADCAST_MAX_BYTES)


@query
def customer_rules_shuffled(spark, sf_dir):
    return _customer_rules(spark, sf_dir, 0)


CUSTOMER_FIXES = {
    "c_name": [X.trim_spaces, X.replace("#", "-")],
    "c_mktsegment": [X.null_if("MACHINERY")],
}


@query
def cell_fixes(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.translate("o_orderpriority", "12345-", "１２３４５−").alias("wide"),
        F.concat(F.lit(" 　"), "o_orderstatus", F.lit("　　"), "o_orderstatus", F.lit(" ")).alias("spaced"),
        F.concat_ws(
            "－", F.substring("o_orderdate", 1, 4), F.lit("〒００"), F.substring("o_orderdate", 9, 2)
        ).alias("dashed"),
        F.lpad(F.col("o_custkey").cast("string"), 7, "0").alias("postal"),
    )
    return auto_fix(
        wide,
        {
            "wide": [X.narrow_digits, X.unify_hyphens],
            "spaced": [X.squeeze_spaces],
            "dashed": [X.narrow_ascii, X.digits],
            "postal": [X.hyphenate_postal],
        },
    )


@query
def fix_log_of_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    cols = ["c_name", "c_mktsegment"]
    return fix_log(auto_fix(remember(rows, cols), CUSTOMER_FIXES), ["c_custkey"], cols)


@query
def row_check(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn(
        "c_name", F.when(F.col("c_acctbal") <= 9800, F.col("c_name"))
    )
    tests = [
        C.required("c_name"),
        C.matches("c_name", "Customer#0{6}[0-9]{3}"),
        C.in_range("c_acctbal", low=0),
        C.max_length("c_mktsegment", 8),
        C.one_of("c_mktsegment", ["BUILDING", "HOUSEHOLD", "MACHINERY", "FURNITURE"]),
    ]
    found = check(rows, ["c_custkey"], tests)
    return found.select("c_custkey", "column_name", "check_name")


# ---- merge, files and folders --------------------------------------------------------------


def _two_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The customers in two tables, the second with its columns in reverse."""
    rows = table(spark, sf_dir, "customer")
    debt = F.coalesce(F.col("c_acctbal") < 0, F.lit(False))
    return rows.where(debt), rows.where(~debt).select(*reversed(rows.columns))


@query
def merge_same_columns(spark, sf_dir):
    a, b = _two_sides(spark, sf_dir)
    return merge({"in debt": a, "in credit": b}, source_col="side")


def _typed_customer(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("c_custkey").cast("bigint"),
        "c_name",
        F.col("c_nationkey").cast("int"),
        F.col("c_acctbal").cast("double"),
        "c_mktsegment",
    )


@query
def csv_round_trip(spark, sf_dir):
    path = new_path(spark, "round-trip")
    write_csv(table(spark, sf_dir, "customer"), path)
    return _typed_customer(read_csv(spark, path))


@query
def csv_merge_files(spark, sf_dir):
    """Files with the same columns in another order."""
    paths = []
    for side in _two_sides(spark, sf_dir):
        paths.append(new_path(spark, "merge"))
        write_csv(side, paths[-1])
    out = new_path(spark, "merged")
    merge_files(spark, paths, out)
    return _typed_customer(read_csv(spark, out))


@query
def job_csv_set(spark, sf_dir):
    """Job data from two folders with different columns, only the needed ones kept."""
    jobs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("Customer#"), _number("o_custkey", 9)).alias("名称"),
        F.concat(F.lit("0"), _number("o_custkey", 9)).alias("TEL"),
        F.col("o_orderpriority").alias("担当者"),
        F.col("o_orderstatus").alias("状態"),
    )
    paths = [new_path(spark, "jobs"), new_path(spark, "jobs")]
    write_csv(jobs.where("`状態` <=> 'P'").select("担当者", "状態", "TEL", "名称"), paths[0])
    write_csv(jobs.where("not `状態` <=> 'P'").drop("状態"), paths[1])
    rows = read_csv_set(spark, paths, ["名称", "TEL", "担当者"])
    return rows.select(
        F.col("名称").alias("name"), F.col("TEL").alias("tel"), F.col("担当者").alias("contact")
    )


@query
def name_list(spark, sf_dir):
    path = new_path(spark, "names")
    lines = table(spark, sf_dir, "part").select(
        F.explode(F.array(F.concat(F.lit(" "), "p_name", F.lit("　")), F.lit("　"))).alias("value")
    )
    lines.write.text(path)
    return read_name_list(spark, path)


@query
def rules_json(spark, sf_dir):
    path = new_path(spark, "rules")
    rules = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("customer"),
        F.lit("name").alias("column"),
        F.when(F.col("p_size") > 25, "min").otherwise("exclude_suffix").alias("op"),
        F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(F.col("p_name")).alias("arg"),
    )
    rules.write.json(path)
    return read_rules(spark, path, multi_line=False)


@query
def prefix_ref(spark, sf_dir):
    path = new_path(spark, "prefix")
    write_csv(table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name"), path)
    return read_prefix_ref(spark, path, ["p_type", "p_brand"], "p_name")


@query
def postal_ref(spark, sf_dir):
    """A file in the layout of the public postal-code data, written from the parts."""
    path = new_path(spark, "postal")
    part = table(spark, sf_dir, "part")
    size = F.col("p_size")
    town = (
        F.when(size <= 10, "以下に掲載がない場合")
        .when(size <= 20, F.concat("p_name", F.lit("（１～９丁目）")))
        .when(size <= 25, F.concat("p_brand", F.lit("の次に番地がくる場合")))
        .when(size <= 30, F.concat("p_brand", F.lit("一円")))
        .when(size <= 35, F.concat("p_name", F.lit("一円")))
    )
    empty = [F.lit("").alias(f"c{i}") for i in range(12)]
    raw = part.select(
        *empty[:2],
        F.lpad(F.col("p_size").cast("string"), 7, "0").alias("code"),
        *empty[2:5],
        F.col("p_type").alias("prefecture"),
        F.col("p_brand").alias("city"),
        town.otherwise(F.col("p_name")).alias("town"),
        *empty[5:11],
    )
    raw.write.csv(path)
    return read_postal_ref(spark, path)


def _orders_by_status(spark, sf_dir) -> str:
    """The orders as CSV files in a folder for each status."""
    path = new_path(spark, "orders-in")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    write_csv(rows.withColumn("status", F.col("o_orderstatus")), path, by=["status"])
    return path


def _mark_low(rows: DataFrame) -> DataFrame:
    return exclude_suffix(rows, "o_orderpriority", "LOW", reason="low")


def _per_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("o_orderstatus").agg(
        F.count("*").alias("n_rows"), F.count("reason").alias("n_excluded")
    )


@query
def folder_batch(spark, sf_dir):
    path = _orders_by_status(spark, sf_dir)
    return _per_status(process_folder(spark, f"{path}/*", _mark_low))


@query
def folder_sources(spark, sf_dir):
    """Rows by the file they came from, files of one name lying in two folders."""
    path = new_path(spark, "same-names")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    for side in ("a", "b"):
        write_csv(orders.where(F.col("o_orderstatus").eqNullSafe("F") == F.lit(side == "a")), f"{path}/{side}/list.csv")
    out = new_path(spark, "by-file")
    write_by_file(process_folder(spark, f"{path}/*/*", _mark_low), out)
    back = read_csv(spark, f"{out}/*", source_col="path")
    side = F.regexp_extract(F.url_decode("path"), "source_file=(.)/list[.]csv", 1)
    return back.select(F.col("o_orderkey").cast("bigint"), "reason", side.alias("side"))


def _folder_stream(spark, sf_dir, op):
    path, out = _orders_by_status(spark, sf_dir), new_path(spark, "orders-out")
    columns = ["o_orderpriority", "o_orderkey", "o_orderstatus"]
    process_new_files(spark, f"{path}/*", out, columns, op, new_path(spark, "progress"))
    return read_csv(spark, f"{out}/*")


@query
def folder_stream(spark, sf_dir):
    return _per_status(_folder_stream(spark, sf_dir, _mark_low))


@query
def folder_stream_long_list(spark, sf_dir):
    """More chain names than one pattern takes, and a lookup table that is not broadcast."""
    orders = table(spark, sf_dir, "orders")
    names = orders.select(F.concat(F.lit("none "), "o_orderkey").alias("name"))
    names = names.unionByName(orders.select(F.substring_index("o_orderpriority", "-", -1).alias("name")).where("name = 'LOW'"))
    ref = orders.select(F.col("o_orderpriority").alias("prefix"), F.substring("o_orderpriority", 1, 1).alias("code"))

    def op(rows):
        rows = exclude_names(rows, "o_orderpriority", names, max_in_pattern=0, max_bytes=0)
        rows = rows.withColumn("level", F.lit(None).cast("string"))
        return fill_by_prefix(rows, "level", "o_orderpriority", ref, max_bytes=0)

    done = _folder_stream(spark, sf_dir, op)
    return done.select(F.col("o_orderkey").cast("bigint"), "reason", "level", "fill_status")


@query
def csv_odd_rows(spark, sf_dir):
    """Rows that do not fit their header are kept whole, beside the good ones."""
    path = new_path(spark, "odd")
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    line = F.when(status == "F", F.concat_ws(",", key, status, F.lit("surplus"))).when(status == "P", key)
    lines = table(spark, sf_dir, "orders").select(line.otherwise(F.concat_ws(",", key, status)).alias("value"))
    # A separator that no line holds keeps the lines as they are.
    raw = {"header": True, "sep": "\u0001", "quote": "", "escapeQuotes": False}
    lines.toDF("key,status").write.options(**raw).csv(path)
    rows = read_csv(spark, path, bad_rows="raw")
    good = F.col("raw").isNull()
    return rows.select(F.when(good, F.col("key")).alias("key"), F.when(good, F.col("status")).alias("status"), "raw")


def _folder_of(spark, rows: DataFrame, packed: bool = False) -> str:
    """``rows`` as CSV files in a new folder."""
    path = new_path(spark, "in")
    with ending_shuffles(spark):
        write_csv(rows, path, packed=packed)
    return path


@query
def postal_fill_folder(spark, sf_dir):
    source = _folder_of(spark, part_addresses(spark, sf_dir))
    out = new_path(spark, "out")
    ref = part_postal_ref(spark, sf_dir)
    fill_postal_codes(spark, source, out, ref, "postal", "address")
    return read_csv(spark, out).withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query
def recruiter_fill_folder(spark, sf_dir):
    source = _folder_of(spark, customer_contacts(spark, sf_dir))
    jobs = _folder_of(spark, order_jobs(spark, sf_dir))
    out = new_path(spark, "out")
    fill_recruiters(spark, source, out, [jobs], "c_name", "tel", "contact")
    return read_csv(spark, out).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query
def chain_exclude_folder(spark, sf_dir):
    source = _folder_of(spark, part_shops(spark, sf_dir))
    out = new_path(spark, "out")
    exclude_chains(spark, source, out, part_chains(spark, sf_dir), "name", suffix="SMALL")
    kept, excluded = read_csv(spark, f"{out}/kept"), read_csv(spark, f"{out}/excluded")
    both = kept.withColumn("reason", F.lit("kept")).unionByName(excluded)
    return both.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


# ---- the delivery job -----------------------------------------------------------------------

LINE_RULES = [
    ("R", "quantity", "max", "45"),
    ("R", "name", "exclude_suffix", "anvil"),
    ("A", "name", "exclude_prefix", "Brand#1 "),
]


def line_config(spark, sf_dir, max_bytes: int = BROADCAST_MAX_BYTES) -> DeliveryConfig:
    """Every order line as a row of a delivery list."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    line = table(spark, sf_dir, "lineitem")
    postal = F.when(F.col("l_discount") <= 0.02, None).when(F.col("l_discount") <= 0.04, " ")
    # Numbers of no listed code, and of a range without a place.
    shift = F.when(F.col("l_linenumber") == 7, 30_000_000).when(F.col("l_linenumber") == 6, 50_000_000)
    rows = line.join(part, F.expr("l_partkey = p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("order_no"),
        F.col("l_linenumber").cast("string").alias("line_no"),
        # Order and line number do not tell the lines apart.
        F.concat_ws("-", *[f"l_{c}" for c in ("orderkey", "linenumber", "partkey", "suppkey", "quantity", "extendedprice")]).alias("line_id"),
        F.col("l_returnflag").alias("customer"),
        F.concat_ws("　", "p_brand", "p_name").alias("name"),
        part_address().alias("address"),
        postal.otherwise(F.col("p_brand")).alias("postal"),
        F.concat(F.lit("０"), F.lpad((F.col("l_suppkey") + shift.otherwise(0)).cast("string"), 8, "0")).alias("tel"),
        F.concat(F.lit("A"), "l_linenumber").alias("area"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity"),
    )
    supplier = table(spark, sf_dir, "supplier")
    tel = F.concat(F.lit("0"), _number("s_suppkey", 8))
    cfg = DeliveryConfig(
        rows=rows,
        fixes={
            "name": [X.squeeze_spaces],
            "tel": [X.narrow_digits],
            "postal": [X.trim_spaces, X.null_if("")],
        },
        rules=spark.createDataFrame(LINE_RULES, "customer string, column string, op string, arg string"),
        chains=part_chains(spark, sf_dir),
        branch_suffix="rod",
        postal_ref=part_postal_ref(spark, sf_dir),
        area_ref=supplier.select(tel.alias("code"), F.concat(F.lit("A"), "s_nationkey").alias("area")),
        jobs=supplier.select(tel.alias("TEL")),
        checks=[C.required("postal"), C.in_range("quantity", high=40)],
        key=["line_id"],
        max_bytes=max_bytes,
    )
    return cfg


def line_delivery(spark, sf_dir) -> Delivery:
    return run_delivery(line_config(spark, sf_dir))


def _delivery_job(done: Delivery) -> DataFrame:
    kept = done.delivered.withColumn("reason", F.lit("delivered"))
    return kept.select(DELIVERED).unionByName(done.excluded.select(DELIVERED))


DELIVERED = ["order_no", "line_no", "customer", "name", "postal", "tel", "reason"]


@query
def delivery_job(spark, sf_dir):
    return _delivery_job(line_delivery(spark, sf_dir))


@query
def delivery_job_shuffled(spark, sf_dir):
    """The form for reference tables too large to broadcast: the lookups answer different values."""
    return _delivery_job(run_delivery(line_config(spark, sf_dir, max_bytes=0)))


@query
def delivery_job_log(spark, sf_dir):
    log = line_delivery(spark, sf_dir).log
    cell = ["column_name", "before_value", "after_value"]
    return log.groupBy(*cell).agg(F.count("*").alias("n_cells"))


@query
def delivery_job_findings(spark, sf_dir):
    found = line_delivery(spark, sf_dir).findings
    what = ["column_name", "check_name", "value", "seen_in_jobs"]
    return found.groupBy(*what).agg(F.count("*").alias("n_rows"))


def _exported(spark, cfg: DeliveryConfig) -> dict[str, DataFrame]:
    """The written outputs, read back. What the job has staged goes when they are written."""
    root = new_path(spark, "export")
    with discarding(spark), ending_shuffles(spark):
        export(run_delivery(cfg), root, "2026-01-01", packed=True)
    return exported(spark, root, "2026-01-01")


@query
def delivery_export(spark, sf_dir):
    out = _exported(spark, line_config(spark, sf_dir))
    kept = out["result"].withColumn("reason", F.lit("delivered"))
    return kept.select(DELIVERED).unionByName(out["log/excluded"].select(DELIVERED))


@query
def delivery_export_replay(spark, sf_dir):
    """The input file, changed as the written log says, without the written excluded rows."""
    cfg = line_config(spark, sf_dir)
    source = _folder_of(spark, cfg.rows, packed=True)
    cfg.rows = read_csv(spark, source)
    out, key = _exported(spark, cfg), cfg.key
    columns = ["name", "postal", "tel"]
    after = {c: F.max(F.when(F.col("column_name") == c, F.struct("after_value"))).alias(f"new_{c}") for c in columns}
    # Cells of a row lie together in the log, so most become one row before they are dealt by key.
    changes = out["log/fixes"].groupBy(*key).agg(*after.values())
    rows = cfg.rows.join(out["log/excluded"].select(*key), key, "left_anti").join(changes, key, "left")

    def replayed(column):
        new = F.col(f"new_{column}")
        return F.when(new.isNotNull(), new["after_value"]).otherwise(F.col(column)).alias(column)

    return rows.select("order_no", "line_no", *[replayed(c) for c in columns])


@query
def delivery_export_findings(spark, sf_dir):
    """The written findings of the day, counted."""
    found = _exported(spark, line_config(spark, sf_dir))["log/findings"]
    seen = F.col("seen_in_jobs").cast("boolean").alias("seen_in_jobs")
    return found.groupBy("column_name", "check_name", "value", seen).agg(F.count("*").alias("n_rows"))


@query
def csv_row_key(spark, sf_dir):
    """The key of a row is the same in two readings of a folder, in whatever order the columns lie."""
    path = new_path(spark, "keyed")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    write_csv(orders.where("o_orderstatus <=> 'F'"), f"{path}/a")
    write_csv(orders.where("not o_orderstatus <=> 'F'").select("o_orderpriority", "o_orderkey", "o_orderstatus"), f"{path}/b")
    one, two = (read_csv(spark, f"{path}/*", row_key="row_key") for _ in range(2))
    both = one.join(two.select("row_key", F.col("o_orderkey").alias("again")), "row_key", "full_outer")
    return both.select(F.col("o_orderkey").cast("bigint"), (F.col("o_orderkey") == F.col("again")).alias("same"))
