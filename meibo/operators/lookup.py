"""Left joins against a table with one row per key, safe for hot keys and for any table size.

Three joins cover every lookup in this package:

* :func:`lookup_join` matches one key per row.
* :func:`first_match` tries several keys per row, best first.
* :func:`longest_prefix` finds the longest key that a text begins with.

All broadcast the table only after measuring it. A larger table is joined by shuffle, with the rows
of keys that hold more than one task's share salted. Columns that a step adds for itself
begin with ``OWN``, so that they meet no column of the rows.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from meibo.functions.names import col, cols
from meibo.operators.staging import stage

# A table is broadcast only when its measured size is at most this.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

# A key is hot when it holds more than half of a task's mean share of the rows, and at least so many.
HOT_ROWS = 1000

# Tasks over which rows without a key are spread.
NO_KEY_SALTS = 1 << 16

# What the names of added columns begin with.
OWN = "meibo:"

# Longest chain of broadcast probes; with more candidates per row the shuffle form is used.
MAX_PROBES = 48

# Prefixes of fewer different lengths are probed one length after another.
FEW_LENGTHS = 6


class Sized(NamedTuple):
    """A staged table, whether it may be broadcast, and the different lengths of its key texts,
    longest first."""

    rows: DataFrame
    small: bool
    lengths: list[int]


def sized(table: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES, key: str | None = None) -> Sized:
    """Compute ``table`` once into a staged copy, and take its size while writing.

    The size is the JSON text of every row plus 16 bytes for the row and for each column, which
    covers the words that Spark's row format adds. With ``key`` the lengths of that column are
    taken too.
    """
    width = F.octet_length(F.to_json(F.struct("*"))) + 16 * (len(table.columns) + 1)
    lengths = F.length(col(key)) if key else F.lit(None).cast("int")
    seen = Observation()
    observed = table.observe(
        seen,
        F.sum(width.cast("long")).alias("bytes"),
        F.collect_set(lengths).alias("lengths"),
    )
    copy = stage(observed, "table")
    small = (seen.get["bytes"] or 0) <= max_bytes
    return Sized(copy, small, sorted(seen.get["lengths"], reverse=True))


class Base(NamedTuple):
    """Where the keys of rows may be read ahead of a join: ``rows`` are cheap to read again and hold them, and
    the columns ``by`` tell the rows that are joined apart."""

    rows: DataFrame
    by: list[str]


def _all_present(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols(columns)])


def lookup_join(
    rows: DataFrame,
    on: list[str],
    table: DataFrame | Sized,
    how: str = "left",
    max_bytes: int = BROADCAST_MAX_BYTES,
    staged: bool = False,
    base: Base | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table`` on the columns ``on``, which are unique in ``table``.

    ``how`` is ``left`` or ``inner``. Rows with a null in ``on`` match nothing. ``staged`` says
    that ``rows`` are cheap to read more than once. With a ``base`` the hot keys are taken from there, so
    the rows are read once, wherever they come from, and are not staged.
    """
    table, small, _ = table if isinstance(table, Sized) else sized(table, max_bytes)
    if small:
        return rows.join(F.broadcast(table), on, how)

    if not staged and base is None:  # the rows are read twice below
        rows = stage(rows, "lookup-rows")
    seen = Observation()
    hot = stage(hot_keys(base.rows if base else rows, on).observe(seen, F.count(F.lit(1)).alias("n")), "lookup-hot")
    salt = OWN + "salt"
    # The same salts in every attempt of a task: they come from the place of the row in its files, or from its key.
    dice = F.xxhash64(*cols(base.by)) if base else F.xxhash64(F.monotonically_increasing_id())
    if not seen.get["n"]:  # only the rows without a key are spread
        spread = F.when(_all_present(on), F.lit(0).cast("long")).otherwise(F.pmod(dice, F.lit(NO_KEY_SALTS)))
        return _joined(rows.withColumn(salt, spread), on, table.withColumn(salt, F.lit(0).cast("long")), how)
    salted = _with_salts(rows, on, hot)
    salts = F.coalesce(col(OWN + "salts"), F.lit(1).cast("long"))
    spread = F.when(_all_present(on), F.pmod(dice, salts)).otherwise(F.pmod(dice, F.lit(NO_KEY_SALTS)))
    left = salted.select(*cols(rows.columns), spread.alias(salt))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias(salt)
    right = _with_salts(table, on, hot).select(*cols(table.columns), copies)
    return _joined(left, on, right, how)


def _joined(rows: DataFrame, on: list[str], table: DataFrame, how: str) -> DataFrame:
    """Join on ``on`` and the salt, and drop the salt."""
    salt = OWN + "salt"
    both = rows.join(table, [*on, salt], how)
    return both.select(*cols(c for c in rows.columns if c != salt), *cols(c for c in table.columns if c not in [*on, salt]))


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """(hash, salts) of the keys whose rows are too many for a task, and over how many tasks they go.

    A frequency sketch names them, so no key is counted exactly and nothing is shuffled. A key is hot
    by its share of the rows, whatever its rank. There are at most twice as many as shuffle
    partitions, and the copies of table rows that the salts make are at most as many again.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = 2 * tasks
    # The sketch errs by less than a quarter of the share that makes a key hot.
    tracked = min(1 << max(12, (16 * most - 1).bit_length()), 1 << 19)
    keys = rows.where(_all_present(on)).select(F.xxhash64(*cols(on)).alias("hash"))
    seen = keys.agg(F.expr(f"approx_top_k(hash, {min(most, tracked)}, {tracked})").alias("top"), F.count(F.lit(1)).alias("total"))
    fair = F.greatest(F.col("total") / most, F.lit(float(HOT_ROWS)))
    each = seen.select(fair.alias("fair"), F.inline("top"))
    return each.where("count > fair").select(
        F.col("item").alias(OWN + "hash"), F.ceil(F.col("count") / F.col("fair")).alias(OWN + "salts")
    )


def _with_salts(rows: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    return rows.withColumn(OWN + "hash", F.xxhash64(*cols(on))).join(F.broadcast(hot), [OWN + "hash"], "left")


def first_match(
    rows: DataFrame,
    subject: list[str],
    candidates: list[Column],
    table: Sized,
    max_bytes: int = BROADCAST_MAX_BYTES,
    staged: bool = False,
) -> DataFrame:
    """Add the columns of ``table`` for the first candidate key that ``table`` holds.

    ``candidates`` are string expressions over the ``subject`` columns, best first; a null
    candidate is skipped. ``table`` has a unique column ``key`` and at least one more column. A row
    with a null subject column gets nulls. ``staged`` is as in :func:`lookup_join`.
    """
    schema = table.rows.schema
    payload = [c for c in schema.names if c != "key"]
    if not candidates:
        return rows.withColumns({c: F.lit(None).cast(schema[c].dataType) for c in payload})
    if table.small and len(candidates) <= MAX_PROBES:
        return _probe(rows, candidates, table.rows, payload)
    return _explode(rows, subject, candidates, table, payload, max_bytes, staged)


def _probe(rows, candidates, table, payload):
    """One broadcast of the table, probed once per candidate: no shuffle, no row identity.

    A row that has its answer probes no further, as its next keys are null.
    """
    packed = table.select("key", F.struct(*payload).alias("hit"))
    out = rows
    for i, candidate in enumerate(candidates):
        if i:
            candidate = F.when(col(OWN + "hit").isNull(), candidate)
        side = packed.select(F.col("key").alias(OWN + "key"), F.col("hit").alias(OWN + "new"))
        out = out.join(F.broadcast(side), candidate == col(OWN + "key"), "left")
        hit = F.coalesce(OWN + "hit", OWN + "new") if i else col(OWN + "new")
        out = out.select(*cols(rows.columns), hit.alias(OWN + "hit"))
    return out.select(*cols(rows.columns), *[col(OWN + "hit")[c].alias(c) for c in payload])


def prefixes(text: Column, lengths: list[int]) -> list[Column]:
    """The beginnings of ``text`` that have one of ``lengths``; null where ``text`` is shorter."""
    return [F.when(F.length(text) >= n, F.substring(text, 1, n)) for n in lengths]


class PrefixSearch(NamedTuple):
    """Prefixes that are searched by halving their lengths.

    ``rows`` (``key``, ``hit``) has the prefixes and their signposts: the beginnings of a prefix at which the
    search for it turns to greater lengths. ``lengths`` are those of the prefixes, shortest first.
    """

    rows: DataFrame
    lengths: list[int]


def _turns(i: int) -> list[int]:
    """Where the search for length number ``i`` turns to greater lengths: the beginnings of its binary number."""
    bits = [1 << b for b in reversed(range(i.bit_length())) if i >> b & 1]
    return [sum(bits[:n]) for n in range(1, len(bits))]


def prefix_search(table: Sized, max_bytes: int = BROADCAST_MAX_BYTES) -> PrefixSearch | None:
    """The search table of the prefixes ``key``, or None for few lengths and for a table too large to broadcast."""
    lengths = sorted(table.lengths)
    if not table.small or len(lengths) < FEW_LENGTHS:
        return None
    packed = table.rows.select("key", F.struct(*cols(c for c in table.rows.columns if c != "key")).alias("hit"))
    turns = [F.array(*[F.lit(lengths[at - 1]) for at in _turns(i + 1)]).cast("array<int>") for i in range(len(lengths))]
    number = F.array_position(F.array(*[F.lit(n) for n in lengths]), F.length("key")).cast("int")
    posts = packed.select("key", F.explode(F.element_at(F.array(*turns), number)).alias("n"))
    posts = posts.select(F.substr("key", F.lit(1), "n").alias(OWN + "post")).distinct()
    posts = stage(posts.join(packed, F.col("key") == col(OWN + "post"), "left_anti"), "prefix-posts")
    # A signpost has the answer of the longest prefix that it begins with, if there is one.
    told = first_match(posts, [OWN + "post"], prefixes(col(OWN + "post"), table.lengths), table._replace(rows=packed), max_bytes)
    both = sized(packed.unionByName(told.withColumnRenamed(OWN + "post", "key")), max_bytes)
    return PrefixSearch(both.rows, lengths) if both.small else None


def longest_prefix(
    rows: DataFrame,
    text: str,
    table: Sized,
    search: PrefixSearch | None = None,
    max_bytes: int = BROADCAST_MAX_BYTES,
    staged: bool = False,
) -> DataFrame:
    """Add the columns of ``table`` for the longest of its prefixes ``key`` that the column ``text`` begins with.

    ``search`` is that of :func:`prefix_search`. With it n lengths take as many probes of one broadcast as
    n has binary digits: where the table holds the beginning, only greater lengths are left, else only smaller ones.
    """
    if search is None:
        return first_match(rows, [text], prefixes(col(text), table.lengths), table, max_bytes, staged)
    payload = [c for c in table.rows.columns if c != "key"]
    lengths = F.array(*[F.lit(n) for n in search.lengths])
    side = F.broadcast(search.rows.select(F.col("key").alias(OWN + "key"), F.col("hit").alias(OWN + "new")))
    at, hit, out = F.lit(0), F.lit(None).cast(search.rows.schema["hit"].dataType), rows
    for bit in reversed(range(len(search.lengths).bit_length())):
        turn = at + (1 << bit)
        size = F.get(lengths, turn - 1)
        out = out.join(side, F.when(F.length(col(text)) >= size, F.substr(col(text), F.lit(1), size)) == col(OWN + "key"), "left")
        at = F.when(col(OWN + "key").isNotNull(), turn).otherwise(at)
        out = out.select(*cols(rows.columns), at.alias(OWN + "at"), F.coalesce(col(OWN + "new"), hit).alias(OWN + "hit"))
        at, hit = col(OWN + "at"), col(OWN + "hit")
    return out.select(*cols(rows.columns), *[hit[c].alias(c) for c in payload])


def _explode(rows, subject, candidates, table, payload, max_bytes, staged):
    """Candidates of every distinct subject, joined by equality; the best one is joined back."""
    if not table.small and not staged:
        rows = stage(rows, "lookup-rows")
    wanted = rows.select(*cols(subject)).where(_all_present(subject)).distinct()
    if not table.small:
        wanted = stage(wanted, "lookup-subjects")
    tries = wanted.select(*cols(subject), F.posexplode(F.array(*candidates)).alias(OWN + "rank", "key"))
    tries = tries.where(F.col("key").isNotNull())
    found = lookup_join(tries, ["key"], table, "inner", staged=True)
    best = found.groupBy(*cols(subject)).agg(F.min(F.struct(OWN + "rank", *payload)).alias(OWN + "best"))
    best = best.select(*cols(subject), *[col(OWN + "best")[c].alias(c) for c in payload])
    return lookup_join(rows, subject, best, "left", max_bytes, staged=staged or not table.small)
