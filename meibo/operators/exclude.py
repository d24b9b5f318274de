"""Reasons to leave a row out of the delivery, and the split by reason."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.functions.names import col, cols
from meibo.functions.text import match_text, trim_spaces
from meibo.operators.lookup import BROADCAST_MAX_BYTES, OWN, Sized, lookup_join, sized
from meibo.operators.staging import stage

# A name list of at most this many names goes into the plan as one pattern.
MAX_IN_PATTERN = 1000

# Characters of the pieces by which names of a longer list are found.
PIECE = 4

NAME, HIT, LISTED, PART = OWN + "name", OWN + "hit", OWN + "listed", OWN + "piece"


def exclude_suffix(
    rows: DataFrame, name: str, suffix: str = "店", reason_col: str = "reason", reason: str = "branch"
) -> DataFrame:
    """Mark names that end in ``suffix`` with something before it."""
    c = trim_spaces(col(name))
    hit = col(name).contains(suffix) & c.endswith(suffix) & (F.length(c) > len(suffix))
    return rows.withColumn(reason_col, F.when(hit, reason))


class NameList(NamedTuple):
    """A list of names as it is matched: a few ``needles``, or a table of the ``listed`` names."""

    match: str
    needles: list[str] | None
    listed: Sized | None

    @property
    def small(self) -> bool:
        """Whether rows are marked where they lie."""
        return self.listed is None or (self.match == "exact" and self.listed.small)


def name_table(
    names: DataFrame,
    match: str = "contains",
    max_in_pattern: int = MAX_IN_PATTERN,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> NameList:
    """The list ``names`` (column ``name``) in its normalised spelling. Blank lines are dropped,
    since an empty name would be part of every name."""
    listed = names.select(match_text(F.col("name")).alias(LISTED)).where(col(LISTED).isNotNull()).distinct()
    if match == "exact":
        return NameList(match, None, sized(listed.select(col(LISTED).alias(NAME), F.lit(True).alias(HIT)), max_bytes))
    if match != "contains":
        raise ValueError(f"match must be 'exact' or 'contains', not {match!r}")
    few = listed.limit(max_in_pattern + 1).collect()
    if len(few) <= max_in_pattern:
        return NameList(match, [r[LISTED] for r in few], None)
    return NameList(match, None, sized(listed, max_bytes))


def exclude_names(
    rows: DataFrame,
    name: str,
    names: DataFrame | NameList,
    match: str = "contains",
    reason_col: str = "reason",
    reason: str = "chain",
    max_in_pattern: int = MAX_IN_PATTERN,
    max_bytes: int = BROADCAST_MAX_BYTES,
    texts: dict[str, str] | None = None,
) -> DataFrame:
    """Mark rows whose name is, or contains, a name on the list ``names`` (column ``name``).

    Both sides are compared in their normalised spelling. ``texts`` is as in :func:`~meibo.operators.rules.apply_rules`.
    """
    table = names if isinstance(names, NameList) else name_table(names, match, max_in_pattern, max_bytes)
    keyed = rows.withColumn(NAME, col(texts[name]) if name in (texts or {}) else match_text(col(name)))
    if table.match == "exact":
        hits = lookup_join(keyed, [NAME], table.listed, "left", max_bytes)
    elif table.needles is not None:
        hits = keyed.withColumn(HIT, holds_any(col(NAME), table.needles))
    else:
        # The rows are read for their names and again for the answers.
        keyed = stage(keyed, "named-rows")
        held = _names_holding(keyed, table.listed, max_bytes)
        hits = lookup_join(keyed, [NAME], held, "left", max_bytes, staged=True)
    return hits.select(*cols(rows.columns), F.when(col(HIT), reason).alias(reason_col))


def any_of_pattern(needles: list[str]) -> str:
    """A regular expression that finds any of ``needles``. Names that begin alike share that part."""
    tree: dict = {}
    for needle in needles:
        node = tree
        for ch in needle:
            node = node.setdefault(ch, {})
        node[""] = {}
    out: list[str] = []
    todo: list = [tree]  # nodes to write out and text between them, the next one last
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif "" not in node:  # else a name ends here, whatever follows
            branches = [[rest, re.escape(ch)] for ch, rest in sorted(node.items(), reverse=True)]
            if len(branches) == 1:
                todo += branches[0]
                continue
            todo.append(")")
            for i, branch in enumerate(branches):
                todo += ["|", *branch] if i else branch
            todo.append("(?:")
    return "".join(out)


def holds_any(text: Column, needles: list[str]) -> Column:
    """True when ``text`` contains one of ``needles``, else false or null."""
    return text.rlike(any_of_pattern(needles)) if needles else F.lit(False)


def pieces(text: Column, n) -> Column:
    """All pieces of ``text`` with ``n`` characters."""
    last = F.length(text) - n + 1
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, n))
    )


def rare_pieces(tries: DataFrame, listed: Sized, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """(listed name, piece): of every listed name that piece that the fewest names hold.

    ``tries`` has a row for every different piece of every name. A listed name with a piece that no name
    holds is left out, since no name can contain it.
    """
    size = F.least(F.length(col(LISTED)), F.lit(PIECE))
    wanted = stage(listed.rows.select(LISTED, _each_piece(LISTED, size).alias(PART)), "listed-pieces")
    # Only pieces of the list are counted.
    known = sized(wanted.select(PART).distinct().withColumn(OWN + "known", F.lit(True)), max_bytes)
    counts = lookup_join(tries.select(PART), [PART], known, "inner", max_bytes, staged=True).groupBy(PART).count()
    rated = lookup_join(wanted, [PART], counts, "left", max_bytes, staged=True)
    least = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), col(PART).alias("piece"))).alias("least")
    return rated.groupBy(LISTED).agg(least).where("least.n > 0").select(LISTED, F.col("least.piece").alias(PART))


def _each_piece(column: str, size: Column) -> Column:
    """A row for every different piece of a text."""
    return F.explode(F.array_distinct(pieces(col(column), size)))


def name_pieces(names: DataFrame, sizes: list[int]) -> DataFrame:
    """(name, piece): the different pieces of every name, one size at a time."""
    by_size = names.select(NAME, F.explode(F.array(*[F.lit(n) for n in sizes])).alias(OWN + "size"))
    return by_size.select(NAME, _each_piece(NAME, col(OWN + "size")).alias(PART))


def _names_holding(keyed: DataFrame, listed: Sized, max_bytes: int) -> DataFrame:
    """Distinct names that contain a listed name, found by the listed name's rarest piece.

    A name is looked up by its pieces of one size, about as many as it has characters, whatever
    lengths the list has. A listed name is a candidate only where its rarest piece occurs, and the
    candidates are then searched for the whole of it.
    """
    distinct = stage(keyed.select(NAME).where(col(NAME).isNotNull()).distinct(), "names")
    size = F.least(F.length(col(LISTED)), F.lit(PIECE))
    sizes = sorted(r[0] for r in listed.rows.select(size).distinct().collect())  # PIECE rows at most
    tries = name_pieces(distinct, sizes)
    rare = rare_pieces(tries, listed, max_bytes)
    # Several listed names may share a piece; the salts of a hot piece hold for all of them.
    found = lookup_join(tries, [PART], rare, "inner", max_bytes, staged=True).where(col(NAME).contains(col(LISTED)))
    return found.select(NAME, F.lit(True).alias(HIT)).distinct()


def first_reason(rows: DataFrame, reason_cols: list[str], reason_col: str = "reason") -> DataFrame:
    """Replace several reason columns by the first one that is set."""
    return rows.select(
        *cols(c for c in rows.columns if c not in reason_cols),
        F.coalesce(*cols(reason_cols)).alias(reason_col),
    )


def split(rows: DataFrame, reason_col: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(kept, excluded). ``rows`` is read once per side, so pass a staged table when it is costly."""
    kept = rows.where(col(reason_col).isNull()).drop(reason_col)
    return kept, rows.where(col(reason_col).isNotNull())
