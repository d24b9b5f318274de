"""Reference data: prefix tables, name lists and customer rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meibo.functions.names import col
from meibo.functions.text import is_blank, narrow_ascii, trim_spaces
from meibo.operators.fill import BY_BLOCK, BY_LOT, PART, REST
from meibo.operators.rules import checked
from meibo.sources.csv import read_csv_set, scan_without_header

# The columns of the public Japanese postal-code file, which has no header row.
POSTAL_COLUMNS = [
    "municipality_code", "old_code", "code",
    "prefecture_kana", "city_kana", "town_kana", "prefecture", "city", "town",
    "several_codes_per_town", "numbered_by_block", "has_blocks", "several_towns_per_code",
    "updated", "update_reason",
]
# The town cells that name no town. A code for the rest of a municipality; house
# numbers that follow the municipality at once; the whole of a municipality, its name before the mark.
REST_OF_CITY = "以下に掲載がない場合"
NUMBERS_FOLLOW = "の次に番地がくる場合"
WHOLE_OF_CITY = "一円"
# Remarks in brackets that leave a town's code to all of it that no other row names.
THE_REST = "その他|除く|番地のみ|丁目のみ|無番地|全域"

RULE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("customer", "column", "op", "arg")]
)


def read_prefix_ref(
    spark: SparkSession,
    paths: str | list[str],
    prefix_cols: list[str],
    value_col: str,
    names: tuple[str, str] = ("prefix", "code"),
    encoding: str = "UTF-8",
) -> DataFrame:
    """Distinct (prefix, value) pairs of a CSV with a header; the prefix is ``prefix_cols``, joined.

    With ``names=("code", "area")`` it reads an area-code list.
    """
    raw = read_csv_set(spark, paths, [*dict.fromkeys([*prefix_cols, value_col])], encoding)
    prefix = F.concat(*[F.coalesce(trim_spaces(col(c)), F.lit("")) for c in prefix_cols])
    pairs = raw.select(prefix.alias(names[0]), trim_spaces(col(value_col)).alias(names[1]))
    return pairs.where(~is_blank(F.col(names[0])) & ~is_blank(F.col(names[1]))).distinct()


def read_postal_ref(
    spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8", ranges: bool = False
) -> DataFrame:
    """(``prefix``, ``code``) from the public Japanese postal-code file.

    Remarks in brackets are cut off a town name. The three special kinds of town cell stand for
    the municipality itself: the rest of it, house numbers that follow it at once, and the whole of
    it. A town that is only called like the last kind keeps its name. Every prefix is given with
    and without the prefecture; one that then has several codes is ambiguous when it is looked up.

    With ``ranges`` the remarks are read as well, into ``kind``, ``low`` and ``high``: the numbers of a
    town's blocks or lots that a code holds for, one row for each range of a list; a kind alone for the
    rest of a town and for parts that are not told by numbers; all null for a whole town.

    The file has no header. A row that has not its fifteen cells, or whose code is no number,
    stops the job and is shown.
    """
    raw = scan_without_header(spark, paths, POSTAL_COLUMNS, encoding)
    good = F.when(
        F.col("code").isNotNull() & ~F.col("code").rlike("^ *[0-9]+ *$"),
        F.raise_error(F.concat(F.lit("not a postal code: "), "code", F.lit(" of "), F.coalesce("town", F.lit("")))).cast("boolean"),
    ).otherwise(True)
    raw = raw.where(good)
    town = F.regexp_replace(F.coalesce("town", F.lit("")), "（.*$", "")
    # The name before the mark is the municipality's, without the district it belongs to.
    place = F.substring_index(town, WHOLE_OF_CITY, 1)
    whole = town.endswith(WHOLE_OF_CITY) & (place != "") & F.col("city").endswith(place)
    special = (town == REST_OF_CITY) | town.endswith(NUMBERS_FOLLOW) | whole
    local = F.concat("city", F.when(special, "").otherwise(town))
    prefix = F.explode(F.array(F.concat("prefecture", local), local)).alias("prefix")
    parts = [F.lit(None).alias("part")] if not ranges else [number_ranges(F.regexp_extract("town", "（([^）]*)", 1)).alias("part")]
    pairs = raw.select("prefecture", "city", "town", "code", *parts).select(prefix, "code", "part")
    pairs = pairs.where("code is not null and prefix <> ''")
    if not ranges:
        return pairs.select("prefix", "code").distinct()
    return pairs.select("prefix", "code", F.explode("part").alias("part")).select("prefix", "code", "part.*").distinct()


def number_ranges(remark: Column) -> Column:
    """A remark such as ``１～５、７丁目`` as an array of (``kind``, ``low``, ``high``), never empty.

    A number without a unit has that of the next item that names one, and lots otherwise. ``以上`` and
    ``以下`` leave an end open.
    """
    narrow = F.translate(narrow_ascii(remark), "～〜−－‐", "~~---")
    kind = F.when(narrow.contains("丁目"), BY_BLOCK).otherwise(BY_LOT)

    def one(item: Column, at: Column) -> Column:
        number = "([0-9]{1,9})"
        unit = "(?:丁目|番地|番)?"
        low = F.regexp_extract(item, f"^{number}{unit}", 1).try_cast("int")
        high = F.regexp_extract(item, f"~{number}{unit}(?:以下)?$", 1).try_cast("int")
        # The unit is that of the item itself or of one behind it.
        behind = F.array_join(F.slice(F.split(narrow, "[、,]"), at + 1, F.lit(10_000)), "、")
        first_unit = F.regexp_extract(behind, "(丁目|番)", 1)
        own = F.when(first_unit == "丁目", BY_BLOCK).when(first_unit == "番", BY_LOT).otherwise(kind)
        alone = item.rlike(f"^{number}{unit}$")
        span = item.rlike(f"^{number}{unit}~{number}{unit}$")
        above, below = item.rlike(f"^{number}{unit}以上$"), item.rlike(f"^{number}{unit}以下$")
        null = F.lit(None)
        return F.struct(
            F.when(alone | span | above | below, own)
            .when(item.rlike(THE_REST), REST)
            .when(F.trim(item) != "", PART)
            .alias("kind"),
            F.when(alone | span | above, low).otherwise(null).cast("int").alias("low"),
            F.when(alone | below, low).when(span, high).otherwise(null).cast("int").alias("high"),
        )

    return F.transform(F.split(narrow, "[、,]"), one)


# The columns of the public list of area codes, and the words after a bracketed place that
# say whether the code holds for it alone or for all but it.
AREA_LIST_COLUMNS = ("番号区画", "市外局番")
ONLY, ALL_BUT = "に限る", "を除く"


def read_area_list(
    spark: SparkSession,
    paths: str | list[str],
    encoding: str = "UTF-8",
    columns: tuple[str, str] = AREA_LIST_COLUMNS,
) -> DataFrame:
    """(``code``, ``place``) from the public Japanese list of area codes, a CSV with a header.

    A code gets its leading 0. The area cell lists municipalities, the prefecture before the first one
    only; a district names its towns in brackets (``空知郡(南幌町、長沼町に限る。)``), and a code that holds for all of a
    place but some parts still serves it. Every place is given with and without the prefecture. A
    place may have several codes.
    """
    area, code = (col(c) for c in columns)
    raw = read_csv_set(spark, paths, list(columns), encoding)
    digits = F.regexp_replace(narrow_ascii(trim_spaces(code)), "[^0-9]", "")
    full = F.when(digits.startswith("0"), digits).otherwise(F.concat(F.lit("0"), digits))
    plain = F.regexp_replace(narrow_ascii(trim_spaces(area)), "[ \n]", "")
    prefecture = F.regexp_extract(plain, PREFECTURE, 1)
    rows = raw.select(full.alias("code"), prefecture.alias("prefecture"), places_of(F.regexp_replace(plain, PREFECTURE, "")).alias("places"))
    named = rows.where("code <> '0'").select("code", "prefecture", F.explode("places").alias("name"))
    both = F.explode(F.array("name", F.concat("prefecture", "name"))).alias("place")
    return named.select("code", both).where("place <> ''").distinct()


# The prefecture at the beginning of an area cell: by its last character, the capital and the north by name.
PREFECTURE = "^(東京都|北海道|京都府|大阪府|[^、(]{2,3}県)"


def places_of(cell: Column) -> Column:
    """The municipalities that an area cell lists, as an array of names.

    Items are separated by ``、`` outside brackets. In brackets a district's towns follow the district's name;
    any other remark is left out.
    """
    # Brackets within brackets are remarks on a part of a town.
    flat = F.regexp_replace(cell, "(\\([^()]*)\\([^()]*\\)([^()]*\\))", "$1$2")
    items = F.split(flat, "、(?![^(]*\\))")

    def named(item: Column) -> Column:
        head = F.regexp_replace(item, "\\(.*$", "")
        inside = F.regexp_extract(item, "\\((.*?)\\)?$", 1)
        towns = F.split(F.regexp_replace(inside, f"(?:{ONLY}|。).*$", ""), "、")
        listed = head.endswith("郡") & inside.contains(ONLY)
        return F.when(listed, F.transform(towns, lambda t: F.concat(head, t))).otherwise(F.array(head))

    names = F.flatten(F.transform(items, named))
    return F.transform(names, lambda n: F.regexp_replace(n, "[。.]$", ""))


def read_name_list(
    spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8"
) -> DataFrame:
    """Column ``name``: the lines of text files, trimmed, without blank lines and repeats."""
    raw = spark.read.text(paths).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    if encoding.upper() != "UTF-8":
        # The text source knows UTF-8 only. A separator that no line holds makes each line one cell.
        raw = spark.read.schema("value string").csv(paths, sep="\u0001", quote="", encoding=encoding)
    lines = raw.select(trim_spaces(F.col("value")).alias("name"))
    return lines.where(F.col("name") != "").distinct()


def read_rules(
    spark: SparkSession, path: str, multi_line: bool = True, encoding: str = "UTF-8"
) -> DataFrame:
    """Customer rules: JSON objects with ``customer``, ``column``, ``op`` and ``arg``.

    The file holds an array of them, or, without ``multi_line``, one object per line. An op that
    no rule kind knows, or an argument that its op cannot use, stops the job.
    """
    reader = spark.read.schema(RULE_SCHEMA).option("multiLine", multi_line).option("encoding", encoding)
    if not multi_line:
        reader = reader.option("lineSep", "\n")
    return checked(reader.json(path))
