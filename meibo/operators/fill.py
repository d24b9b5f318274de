"""Fill blank cells from reference data. A cell that holds something is never overwritten.

All operators add a status column: ``kept`` (was not blank), ``filled``, ``ambiguous`` (the best
match leads to more than one value; the cell stays blank) or ``no_match``. A fill by near names adds
``filled_near``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.functions.address import BLOCK_END, LOT_END, address_text
from meibo.functions.names import col
from meibo.functions.text import blank_to_null, company_text, digits, is_blank, match_text
from meibo.operators.lookup import (
    BROADCAST_MAX_BYTES,
    OWN,
    PrefixSearch,
    Sized,
    first_match,
    longest_prefix,
    lookup_join,
    prefix_search,
    sized,
)
from meibo.operators.staging import stage

# Between the parts of a composite key; no cell holds it after ``strip_controls``.
SEPARATOR = "\u0001"

# What makes two spellings of a key column the same.
AS_NAME = match_text
AS_COMPANY = company_text
AS_PHONE = digits

# The kinds of a ranged reference row: by block, by lot, the rest of a town, and any other part of it.
BY_BLOCK, BY_LOT, REST, PART = "block", "lot", "rest", "part"
# Numbers of a range lie below 2 to this; a larger one counts as the largest.
RANGE_BITS = 18

# A name key shorter than this is too short to be told from its neighbours.
MIN_NEAR = 4

N, VALUE, TEXT = OWN + "n_values", OWN + "value", OWN + "text"


def distinct_values(pairs: DataFrame) -> DataFrame:
    """(``key``, ``value``) pairs to one row per key: number of distinct values and the least one.

    The distinct step spreads over key *and* value, so a key with very many values is no hot spot.
    """
    return (
        pairs.select("key", "value")
        .where(F.col("key").isNotNull() & F.col("value").isNotNull())
        .distinct()
        .groupBy("key")
        .agg(F.count("*").alias("n_values"), F.min("value").alias("value"))
    )


def _own(table: DataFrame) -> DataFrame:
    """An index with its columns under names that meet no column of the rows."""
    return table.select("key", F.col("n_values").alias(N), F.col("value").alias(VALUE))


def _filled(rows: DataFrame, blank_col: str, status_col: str, columns: list[str]) -> DataFrame:
    blank = is_blank(col(blank_col))
    n = col(N)
    status = F.when(~blank, "kept").when(n == 1, "filled").when(n > 1, "ambiguous").otherwise("no_match")
    value = F.when(blank & (n == 1), col(VALUE)).otherwise(col(blank_col))
    return rows.select(
        *[value.alias(c) if c == blank_col else col(c) for c in columns],
        status.alias(status_col),
    )


# ---- longest prefix, and ranges of numbers behind it -------------------------------------------


class PrefixTable(NamedTuple):
    """``towns``: one row per prefix. ``ranges``: one row per piece of a range, or None. ``levels``: the
    sizes of pieces that occur, by kind. ``search``: the prefixes as they are searched, or None."""

    towns: Sized
    ranges: Sized | None
    levels: dict[str, list[int]]
    search: PrefixSearch | None = None

    @property
    def small(self) -> bool:
        return self.towns.small and (self.ranges is None or self.ranges.small)


def prefix_table(ref: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> PrefixTable:
    """The lookup tables of a reference with ``prefix`` and ``code``.

    With ``kind``, ``low`` and ``high`` a row may hold for a part of its prefix only: the numbers ``low`` to
    ``high`` of its blocks or lots, the rest, or a part that no number tells. Null ends are open.
    """
    key, code = address_text(F.col("prefix")).alias("key"), blank_to_null(F.col("code")).alias("value")
    if "kind" not in ref.columns:
        towns = sized(_own(distinct_values(ref.select(key, code))), max_bytes, "key")
        return PrefixTable(towns, None, {}, prefix_search(towns, max_bytes))
    pairs = stage(ref.select(key, code, "kind", "low", "high").where("key is not null and value is not null").distinct(), "prefix-parts")
    ranged = F.coalesce(F.col("kind").isin(BY_BLOCK, BY_LOT), F.lit(False))
    rest = F.when(F.col("kind").isNull() | (F.col("kind") == REST), F.col("value"))
    each = pairs.groupBy("key", "value").agg(
        F.max(ranged).alias("ranged"), F.min(rest).alias("rest"), F.max(F.coalesce(F.col("kind") == PART, F.lit(False))).alias("part")
    )
    towns = each.groupBy("key").agg(
        F.count("*").alias(N),
        F.min("value").alias(VALUE),
        F.max("ranged").alias(OWN + "ranged"),
        # The value of all numbers outside the ranges, if there is one and nothing else may be meant.
        F.when((F.count("rest") == 1) & ~F.max("part"), F.min("rest")).alias(OWN + "rest"),
    )
    towns = towns.withColumn(OWN + "town", F.col("key"))
    ranges = stage(_range_pieces(pairs.where(ranged)), "range-pieces")
    levels: dict[str, list[int]] = {}
    for row in ranges.select("kind", "level").distinct().collect():  # at most two kinds of RANGE_BITS levels
        levels.setdefault(row["kind"], []).append(row["level"])
    ranges = ranges.select("key", F.col("n_values").alias(OWN + "n_ranged"), F.col("value").alias(OWN + "ranged_value"))
    towns = sized(towns, max_bytes, "key")
    by_kind = {k: sorted(v) for k, v in levels.items()}
    return PrefixTable(towns, sized(ranges, max_bytes), by_kind, prefix_search(towns, max_bytes))


def _piece_key(town: Column, kind: Column, level: Column, start: Column) -> Column:
    return F.concat_ws(SEPARATOR, town, kind, level, start)


def _range_pieces(ranged: DataFrame) -> DataFrame:
    """Ranges as dyadic pieces: (``key``, ``kind``, ``level``, ``n_values``, ``value``).

    A range of any length is at most two pieces of each size, and a number lies in one piece of each
    size, so numbers and ranges meet by equality. A piece also has the values of the larger pieces
    around it, so that the smallest one that holds a number tells all values of that number.
    """
    top = (1 << RANGE_BITS) - 1
    bounded = ranged.select(
        "key",
        "kind",
        "value",
        F.least(F.greatest(F.coalesce(F.col("low"), F.lit(0)), F.lit(0)), F.lit(top)).alias("low"),
        F.least(F.coalesce(F.col("high"), F.lit(top)), F.lit(top)).alias("high"),
    )
    first, last = "shiftright(low + shiftleft(1, l) - 1, l)", "shiftright(high + 1, l) - 1"
    # Of the pieces inside the range those that no larger piece inside it covers.
    cut = f"""filter(flatten(transform(sequence(0, {RANGE_BITS}), l -> array(
        if({first} <= {last} and {first} % 2 = 1, struct(l as level, {first} as start), null),
        if({first} <= {last} and ({last}) % 2 = 0, struct(l as level, {last} as start), null)))), p -> p is not null)"""
    pieces = bounded.where("low <= high").select("key", "kind", "value", F.explode(F.expr(cut)).alias("p"))
    pieces = stage(pieces.select("key", "kind", "value", "p.level", "p.start").distinct(), "range-parts")
    around = pieces.select("key", "kind", "level", "start").distinct()
    around = around.withColumn("up", F.explode(F.expr(f"sequence(level, {RANGE_BITS})")))
    around = around.withColumn("over", F.expr("shiftright(start, up - level)"))
    larger = pieces.select("key", "kind", F.col("level").alias("up"), F.col("start").alias("over"), "value")
    found = around.join(larger, ["key", "kind", "up", "over"]).select("key", "kind", "level", "start", "value").distinct()
    return found.groupBy("key", "kind", "level", "start").agg(F.count("*").alias("n_values"), F.min("value").alias("value")).select(
        _piece_key(F.col("key"), F.col("kind"), F.col("level"), F.col("start")).alias("key"), "kind", "level", "n_values", "value"
    )


def _by_range(found: DataFrame, table: PrefixTable, max_bytes: int) -> DataFrame:
    """Let the number behind the prefix decide where a prefix with several values has ranges."""
    town, ranged, open_ = col(OWN + "town"), col(OWN + "ranged"), col(N) > 1
    behind = F.when(ranged & open_, F.substr(col(TEXT), F.length(town) + 1))
    block = F.nullif(F.regexp_extract(behind, f"^ ?([0-9]{{1,9}})(?![0-9{LOT_END}])", 1), F.lit(""))
    lot = F.coalesce(
        F.nullif(F.regexp_extract(behind, f"^ ?(?:[0-9]+{BLOCK_END})?([0-9]{{1,9}}){LOT_END}", 1), F.lit("")),
        F.nullif(F.regexp_extract(behind, "^ ?([0-9]{1,9})(?![0-9])", 1), F.lit("")),
    )
    # -1 stands for no number; all three are null where no range has to decide.
    town_at, blocks, lots = OWN + "town_at", OWN + "block", OWN + "lot"
    top, none = F.lit((1 << RANGE_BITS) - 1), F.lit(-1)

    def bounded(number: Column) -> Column:
        return F.when(behind.isNotNull(), F.when(number.isNotNull(), F.least(number.cast("int"), top)).otherwise(none))

    keyed = found.withColumns({town_at: F.when(behind.isNotNull(), town), blocks: bounded(block), lots: bounded(lot)})
    candidates = [
        F.when(col(number) >= 0, _piece_key(col(town_at), F.lit(kind), F.lit(level), F.shiftright(col(number), level)))
        for kind, number in ((BY_BLOCK, blocks), (BY_LOT, lots))
        for level in table.levels.get(kind, [])
    ]
    hit = first_match(keyed, [town_at, blocks, lots], candidates, table.ranges, max_bytes)
    n_hit, numbered = col(OWN + "n_ranged"), F.greatest(col(blocks), col(lots)) >= 0
    outside = n_hit.isNull() & numbered & col(OWN + "rest").isNotNull()
    return hit.withColumns(
        {
            VALUE: F.when(n_hit.isNotNull(), col(OWN + "ranged_value")).when(outside, col(OWN + "rest")).otherwise(col(VALUE)),
            N: F.when(n_hit.isNotNull(), n_hit).when(outside, 1).otherwise(col(N)),
        }
    )


def fill_by_prefix(
    rows: DataFrame,
    blank_col: str,
    text_col: str,
    ref: DataFrame | PrefixTable,
    status_col: str = "fill_status",
    only: Column | None = None,
    max_bytes: int = BROADCAST_MAX_BYTES,
    spelled: str | None = None,
    staged: bool = False,
) -> DataFrame:
    """Fill ``blank_col`` with the code of the longest prefix of ``text_col``.

    ``ref`` has ``prefix`` and ``code``. A longest prefix with several codes is ambiguous; shorter
    ones are not tried then. With ranges in ``ref`` (see :func:`prefix_table`) the number behind the
    prefix may decide; a number outside all ranges has the code of the rest, if there is one. Both
    sides are compared in the spelling of :func:`~meibo.functions.address.address_text`. Rows outside
    ``only`` are not looked up. ``spelled`` names a column that has that spelling already. ``staged`` says that
    ``rows`` are cheap to read more than once.
    """
    table = ref if isinstance(ref, PrefixTable) else prefix_table(ref, max_bytes)
    wanted = is_blank(col(blank_col))
    if only is not None:
        wanted = wanted & only
    text = F.when(wanted, col(spelled)) if spelled else address_text(F.when(wanted, col(text_col)))
    keyed = rows.withColumn(TEXT, text)
    # A number at the end of an address may be that of a block.
    ended = F.when(col(TEXT).rlike("[0-9]\\z"), F.concat(col(TEXT), F.lit(BLOCK_END))).otherwise(col(TEXT))
    found = longest_prefix(keyed.withColumn(TEXT, ended), TEXT, table.towns, table.search, max_bytes, staged)
    if table.ranges is not None and table.levels:
        found = _by_range(found, table, max_bytes)
    return _filled(found, blank_col, status_col, rows.columns)


# ---- keys ----------------------------------------------------------------------------------------


def _tier_keys(tiers: list[list[Column]]) -> list[Column]:
    """One string per tier, marked with the tier; null when a part of the key is blank."""
    return [
        F.concat(F.lit(f"{i}{SEPARATOR}"), *[x for p in tier for x in (p, F.lit(SEPARATOR))])
        for i, tier in enumerate(tiers)
    ]


def index_pairs(jobs: DataFrame, tiers: list[dict], value: str) -> DataFrame:
    """The (``key``, ``value``) pairs of every tier, with repeats."""
    # Each column is normalised once, whatever the number of tiers that use it.
    norms = {c: norm for tier in tiers for c, norm in tier.items()}
    parts = [norm(col(c)).alias(f"{OWN}part_{c}") for c, norm in norms.items()]
    known = jobs.select(*parts, blank_to_null(col(value)).alias("value")).where(F.col("value").isNotNull())
    keys = F.array(*_tier_keys([[col(f"{OWN}part_{c}") for c in tier] for tier in tiers]))
    return known.select(F.explode(keys).alias("key"), "value").where(F.col("key").isNotNull())


def build_index(jobs: DataFrame, tiers: list[dict], value: str) -> DataFrame:
    """Index ``value`` by every tier's key: one row per ``key`` with ``n_values`` and ``value``.

    A tier maps the columns of its key to the function that normalises them, such as
    ``{"name": AS_NAME, "tel": AS_PHONE}``. All tiers share one shuffle.
    """
    return distinct_values(index_pairs(jobs, tiers, value))


def fill_by_key(
    rows: DataFrame,
    blank_col: str,
    tiers: list[dict],
    index: DataFrame,
    status_col: str = "fill_status",
    only: Column | None = None,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> DataFrame:
    """Fill ``blank_col`` from ``index``, the first tier that knows the row's key deciding.

    ``tiers`` is as in :func:`build_index` with the column names of ``rows``. An ambiguous tier
    ends the search.
    """
    wanted = is_blank(col(blank_col))
    if only is not None:
        wanted = wanted & only
    norms = {c: norm for tier in tiers for c, norm in tier.items()}
    # Blank parts become '' so that the parts together still identify a row's key.
    empty = F.when(wanted, F.lit(""))
    part = {c: f"{OWN}part_{c}" for c in norms}
    keyed = rows.withColumns({part[c]: F.coalesce(f(F.when(wanted, col(c))), empty) for c, f in norms.items()})
    keys = _tier_keys([[F.nullif(col(part[c]), F.lit("")) for c in tier] for tier in tiers])
    table = sized(_own(index), max_bytes)
    found = first_match(keyed, list(part.values()), keys, table, max_bytes)
    return _filled(found, blank_col, status_col, rows.columns)


# ---- near names ----------------------------------------------------------------------------------


def _without(text: Column, i: Column) -> Column:
    """``text`` without its character number ``i``."""
    return F.concat(F.substring(text, F.lit(1), i - 1), F.substr(text, i + 1))


def _changed_keys(name: Column) -> Column:
    """What two names of one length share when they differ in one place: the place, and the rest."""
    places = F.sequence(F.lit(1), F.length(name))
    return F.transform(places, lambda i: F.concat_ws(SEPARATOR, F.lit("at"), i, _without(name, i)))


def _shortened(name: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(name))
    return F.array_distinct(F.transform(places, lambda i: _without(name, i)))


def _marked(mark: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.concat_ws(SEPARATOR, F.lit(mark), t))


def near_index(jobs: DataFrame, name: str, value: str, norm=AS_COMPANY) -> DataFrame:
    """An index by which names with one wrong, missing or surplus character meet.

    One row per ``key`` with ``n_names``, ``n_values`` and ``value``. A name of n characters has 2n + 1 keys: one
    for each place with the rest of the name, one for each form with a character left out, and
    itself. Two names share a key of the right kinds exactly when they are one edit apart, so no pair
    of names is ever compared.
    """
    names = build_index(jobs, [{name: norm}], value)
    text = F.element_at(F.split("key", SEPARATOR), 2)
    known = names.select(text.alias("name"), "n_values", "value").where(F.length("name") >= MIN_NEAR)
    keys = F.concat(_changed_keys(F.col("name")), _marked("longer", _shortened(F.col("name"))), F.array(F.concat_ws(SEPARATOR, F.lit("is"), F.col("name"))))
    return (
        known.select(F.explode(keys).alias("key"), "n_values", "value")
        .groupBy("key")
        .agg(F.count("*").alias("n_names"), F.max("n_values").alias("n_values"), F.min("value").alias("value"))
    )


def fill_by_near_name(
    rows: DataFrame,
    blank_col: str,
    name: str,
    index: DataFrame,
    norm=AS_COMPANY,
    status_col: str = "fill_status",
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> DataFrame:
    """Fill the cells that an exact fill has left with ``no_match``, from names one character away.

    ``rows`` have the ``status_col`` of :func:`fill_by_key`, ``index`` is of :func:`near_index`. A name with
    one near name that has one value is ``filled_near``; several near names, or several values, are
    ``ambiguous``. Names of fewer than ``MIN_NEAR`` characters are not looked up.
    """
    near, names = OWN + "near", OWN + "names"
    wanted = col(status_col) == "no_match"
    text = norm(F.when(wanted, col(name)))
    keyed = stage(rows.withColumn(TEXT, F.when(F.length(text) >= MIN_NEAR, text)), "near-rows")
    distinct = stage(keyed.select(TEXT).where(col(TEXT).isNotNull()).distinct(), "near-names")
    of = col(TEXT)
    itself = F.concat_ws(SEPARATOR, F.lit("is"), of)
    keys = F.concat(_changed_keys(of), _marked("is", _shortened(of)), F.array(F.concat_ws(SEPARATOR, F.lit("longer"), of), itself))
    tries = distinct.select(TEXT, F.explode(keys).alias("key"))
    found = lookup_join(tries, ["key"], index, "inner", max_bytes, staged=True)
    # A name that the index holds itself, in whatever legal form, is its own and only neighbour.
    same = F.col("key") == itself

    def of_same(column: str) -> Column:
        return F.max(F.when(same, F.col(column)))

    best = found.groupBy(TEXT).agg(
        F.coalesce(of_same("n_names"), F.sum("n_names")).alias(names),
        F.coalesce(of_same("n_values"), F.max("n_values")).alias(N),
        F.coalesce(of_same("value"), F.min("value")).alias(VALUE),
    )
    best = best.withColumn(near, F.lit(True))
    done = lookup_join(keyed, [TEXT], best, "left", max_bytes, staged=True)
    one = (col(names) == 1) & (col(N) == 1)
    hit = wanted & col(near)
    value = F.when(hit & one, col(VALUE)).otherwise(col(blank_col))
    status = F.when(hit & one, "filled_near").when(hit, "ambiguous").otherwise(col(status_col))
    return done.select(
        *[value.alias(c) if c == blank_col else status.alias(c) if c == status_col else col(c) for c in rows.columns]
    )
