"""Per-customer rules. A rule says when a customer does not want a row.

A rule is (``customer``, ``column``, ``op``, ``arg``). The ops:

=====================  ===================================================
``required``           the cell is blank
``exclude_value``      the cell is ``arg``
``exclude_prefix``     the cell begins with ``arg``
``exclude_suffix``     the cell ends in ``arg``
``exclude_contains``   the cell contains ``arg``
``min``, ``max``       the cell, read as a number, is below / above ``arg``
``max_length``         the cell has more than ``arg`` characters
=====================  ===================================================

Texts are compared in their normalised spelling and numbers in narrow digits. A space that ``arg``
has on its inner side counts: the prefix ``A `` is the word A. A cell that is not
blank and no number breaks ``min`` and ``max``. A blank cell breaks ``required`` only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from meibo.functions.names import col, cols
from meibo.functions.text import is_blank, match_text, narrow_ascii, spelling, trim_spaces
from meibo.operators.exclude import pieces
from meibo.operators.lookup import BROADCAST_MAX_BYTES, OWN, Base, Sized, lookup_join, sized
from meibo.operators.staging import stage

TEXT_OPS = ["exclude_value", "exclude_prefix", "exclude_suffix", "exclude_contains"]
NUMBER_OPS = ["min", "max", "max_length"]
OPS = ["required", *TEXT_OPS, *NUMBER_OPS]

# The tests of a text that are not for equality, as methods of a column.
TESTS = {"exclude_prefix": "startswith", "exclude_suffix": "endswith", "exclude_contains": "contains"}

CUSTOMER = OWN + "customer"

# A customer's row holds at most so many texts of one (op, column), and so many bytes of texts in
# all; the texts of every other (op, column) are joined by equality.
FEW_TEXTS = 64

# So many rules in all are compared where the rows lie, without a join.
RULES_IN_PLAN = 32
HELD_BYTES = 64 * 1024


def _number(text: Column) -> Column:
    return trim_spaces(narrow_ascii(text)).try_cast("double")


def _needle(op: str, arg: Column) -> Column:
    """The spelling of a text argument; cells have no spaces at their ends."""
    if op == "exclude_prefix":
        return F.ltrim(spelling(arg))
    if op == "exclude_suffix":
        return F.rtrim(spelling(arg))
    return spelling(arg) if op == "exclude_contains" else match_text(arg)


def checked(rules: DataFrame) -> DataFrame:
    """``rules``, stopping the job at an unknown op, a blank text or an argument that is no number."""
    op, arg = F.col("op"), F.col("arg")
    shown = F.concat_ws(" ", F.coalesce("customer", F.lit("")), F.coalesce("column", F.lit("")), op, arg)
    text, number = match_text(arg), _number(arg)
    fault = (
        F.when(op.isNull() | ~op.isin(OPS), "unknown rule op: ")
        .when(op.isin(TEXT_OPS) & text.isNull(), "a rule needs a text: ")
        .when(op.isin(NUMBER_OPS) & number.isNull(), "a rule needs a number: ")
    )
    known = F.when(fault.isNull(), op).otherwise(F.raise_error(F.concat(fault, shown)))
    return rules.withColumn("op", known)


def _held(kind: tuple[str, str], name: str) -> Column:
    """What a customer's rules of one (op, column) come down to.

    Only whether one of them is broken matters, so numbers become the strictest one.
    """
    op, column = kind
    mine = (F.col("op") == op) & (F.col("column") == column)
    if op == "required":
        held = F.max(F.when(mine, True))
    elif op in TEXT_OPS:
        held = F.collect_set(F.when(mine, _needle(op, F.col("arg"))))
    else:
        held = (F.max if op == "min" else F.min)(F.when(mine, _number(F.col("arg"))))
    return held.alias(name)


def _broken(kind: tuple[str, str], held: Column, texts: dict[str, str]) -> Column:
    """Whether the row breaks a rule of the kind; false or null when it does not."""
    op, column = kind
    cell = col(column).cast("string")
    if op == "required":
        return held & is_blank(cell)
    if op == "max_length":
        return F.length(cell) > held
    if op in NUMBER_OPS:
        number = _number(cell)
        out = (number < held) if op == "min" else (number > held)
        return held.isNotNull() & ~is_blank(cell) & F.coalesce(out, F.lit(True))
    text = col(texts[column]) if column in texts else match_text(cell)
    if op == "exclude_value":
        return F.array_contains(held, text)
    return F.exists(held, lambda arg: getattr(text, TESTS[op])(arg))


def _kinds(rules: DataFrame, columns: list[str]) -> tuple[list[tuple[str, str]], set[tuple[str, str]]]:
    """The (op, column) pairs that occur, and those with too many texts for a customer's row.

    An unknown op or column is an error.
    """
    most = len(OPS) * len(columns)
    size = F.sum(F.coalesce(F.octet_length("arg"), F.lit(0)) + 16).alias("bytes")
    each = rules.groupBy("op", "column", "customer").agg(F.count("*").alias("n"), size)
    # With more pairs than these there must be an unknown one among them.
    pairs = each.groupBy("op", "column").agg(F.max("n").alias("n"), F.max("bytes").alias("bytes")).limit(most + 1).collect()
    odd = [tuple(p)[:2] for p in pairs if p["op"] not in OPS or p["column"] not in columns]
    if odd:
        raise ValueError(f"unknown op or column in the rules: {odd[:5]}")
    many, held = set(), 0
    for p in sorted(pairs, key=lambda p: p["bytes"]):
        if p["op"] in TEXT_OPS:
            held += p["bytes"]
            if p["n"] > FEW_TEXTS or held > HELD_BYTES:
                many.add((p["op"], p["column"]))
                held -= p["bytes"]
    return sorted((p["op"], p["column"]) for p in pairs), many


def _part(op: str, text: Column, n: Column) -> Column:
    """The pieces of ``text`` with ``n`` characters that a rule's text may be equal to."""
    if op == "exclude_contains":
        return pieces(text, n)
    part = F.substring(text, F.lit(1), n) if op == "exclude_prefix" else F.right(text, n)
    return F.when(F.length(text) >= n, F.array(part))


def _joined(rows: DataFrame, text: str, kind: tuple[str, str], rules: DataFrame, name: str, max_bytes: int) -> DataFrame:
    """Add ``name``, true for rows that break one of the many rules of the kind, else null.

    ``text`` is the column's spelling. The join is by (customer, text), so the rules of one customer lie
    in many tasks. ``rows`` are cheap to read more than once, and stay so.
    """
    op, column = kind
    piece, size = OWN + "piece", OWN + "size"
    mine = checked(rules).where((F.col("op") == op) & (F.col("column") == column))
    listed = mine.select(F.col("customer").alias(CUSTOMER), _needle(op, F.col("arg")).alias(piece)).distinct()
    if op == "exclude_value":
        table = listed.select(CUSTOMER, col(piece).alias(text), F.lit(True).alias(name))
        return lookup_join(rows, [CUSTOMER, text], table, "left", max_bytes, staged=True)
    listed = sized(listed.withColumn(name, F.lit(True)), max_bytes)
    sizes = listed.rows.groupBy(CUSTOMER).agg(F.collect_set(F.length(col(piece))).alias(size))
    distinct = rows.select(CUSTOMER, text).where(col(CUSTOMER).isNotNull() & col(text).isNotNull()).distinct()
    # One length at a time, so that no row holds the pieces of all lengths at once.
    by_size = lookup_join(stage(distinct, "rule-texts"), [CUSTOMER], sizes, "inner", max_bytes, staged=True).select(
        CUSTOMER, text, F.explode(col(size)).alias(size)
    )
    tries = by_size.select(CUSTOMER, text, F.explode(_part(op, col(text), col(size))).alias(piece))
    found = lookup_join(tries, [CUSTOMER, piece], listed, "inner", max_bytes, staged=True)
    hits = found.select(CUSTOMER, text, name).distinct()
    return lookup_join(rows, [CUSTOMER, text], hits, "left", max_bytes, staged=True)


class RuleTable(NamedTuple):
    """Rules as they are applied: the kinds that occur, one row per customer for the kinds with few
    texts, and the rules of the kinds with many. ``given``: the rules themselves where they are few."""

    kinds: list[tuple[str, str]]
    held: Sized | None
    many: set[tuple[str, str]]
    rules: DataFrame
    given: list[Row] | None = None

    @property
    def small(self) -> bool:
        """Whether rows are judged where they lie."""
        return not self.many and (self.held is None or self.held.small)


def rule_table(rules: DataFrame, columns: list[str], max_bytes: int = BROADCAST_MAX_BYTES) -> RuleTable:
    """Prepare ``rules`` for rows with ``columns``."""
    rules = stage(rules.select("customer", "column", "op", "arg").distinct(), "rules")
    kinds, many = _kinds(rules, columns)
    few = [(kind, _name(i)) for i, kind in enumerate(kinds) if kind not in many]
    held = given = None
    if few:
        by_customer = checked(rules).groupBy(F.col("customer").alias(CUSTOMER))
        held = sized(by_customer.agg(*[_held(kind, name) for kind, name in few]), max_bytes)
        if held.small and not many:
            needle = F.coalesce(*[F.when(F.col("op") == op, _needle(op, F.col("arg"))) for op in TEXT_OPS])
            number = F.when(F.col("op").isin(NUMBER_OPS), _number(F.col("arg")))
            each = checked(rules).where("customer is not null")
            each = each.select("customer", "column", "op", needle.alias("text"), number.alias("number"))
            given = each.limit(RULES_IN_PLAN + 1).collect()
    return RuleTable(kinds, held, many, rules, given if given and len(given) <= RULES_IN_PLAN else None)


def _broken_given(kind: tuple[str, str], customer: str, given: list[Row], texts: dict[str, str]) -> Column:
    """Whether the row breaks one of the ``given`` rules of the kind; false or null when it does not."""
    op, column = kind
    broken = F.lit(False)
    for rule in given:
        if (rule["op"], rule["column"]) != kind:
            continue
        if op in TEXT_OPS:
            text = col(texts[column]) if column in texts else match_text(col(column).cast("string"))
            out = text == rule["text"] if op == "exclude_value" else getattr(text, TESTS[op])(rule["text"])
        else:
            out = _broken(kind, F.lit(True if op == "required" else rule["number"]), texts)
        broken = broken | F.coalesce((col(customer) == rule["customer"]) & out, F.lit(False))
    return broken


def _name(i: int) -> str:
    return f"{OWN}held{i}"


def apply_rules(
    rows: DataFrame,
    customer: str,
    rules: DataFrame | RuleTable,
    columns: list[str] | None = None,
    reason_col: str = "reason",
    max_bytes: int = BROADCAST_MAX_BYTES,
    texts: dict[str, str] | None = None,
    base: Base | None = None,
) -> DataFrame:
    """Add the op of the first rule a row breaks, in the order of (op, column), else null.

    ``columns`` are those that rules may name; all columns by default. ``texts`` names, of a column, the one that has its
    :func:`~meibo.functions.text.match_text` already. All rules of a customer
    become one row before the one join, so their number neither multiplies rows nor joins. Only an
    (op, column) with more texts than that row may hold has a join of its own; the rows are staged once
    for all of these. ``base`` is as in :func:`~meibo.operators.lookup.lookup_join`.
    """
    table = rules if isinstance(rules, RuleTable) else rule_table(rules, columns or rows.columns, max_bytes)
    if not table.kinds:
        return rows.withColumn(reason_col, F.lit(None).cast("string"))
    if table.given:
        reasons = [F.when(_broken_given(kind, customer, table.given, texts or {}), kind[0]) for kind in table.kinds]
        return rows.withColumn(reason_col, F.coalesce(*reasons))
    met = rows.withColumn(CUSTOMER, col(customer))
    if table.held:
        keys = base and base._replace(rows=base.rows.withColumn(CUSTOMER, col(customer)))
        met = lookup_join(met, [CUSTOMER], table.held, "left", max_bytes, base=keys)
    many = [(kind, _name(i)) for i, kind in enumerate(table.kinds) if kind in table.many]
    if many:
        texts = {column: f"{OWN}text{i}" for i, column in enumerate(sorted({column for (_, column), _ in many}))}
        met = stage(met.withColumns({name: match_text(col(c).cast("string")) for c, name in texts.items()}), "rule-rows")
        for kind, name in many:
            met = _joined(met, texts[kind[1]], kind, table.rules, name, max_bytes)
    reasons = [
        F.when(col(_name(i)) if kind in table.many else _broken(kind, col(_name(i)), texts or {}), kind[0])
        for i, kind in enumerate(table.kinds)
    ]
    return met.select(*cols(rows.columns), F.coalesce(*reasons).alias(reason_col))
