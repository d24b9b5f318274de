"""Exact copies by digest, with the frequent digests taken out of the shuffle.

A Misra-Gries summary (Spark's ``approx_top_k``) names the digests that may be frequent. An exact
map-side aggregate verifies them; the verified winners, at most ``HEAVY_MAX`` short rows, are broadcast
and settle their rows where these lie. Every other digest is rare and goes through an ordinary
shuffle: the summary errs by no more than ``3.5 / SUMMARY_SIZE`` of the rows, so fewer than ``HEAVY_MAX``
digests can look as frequent as one that holds twice that share, which therefore is a winner.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
row with the largest id stays, a null id being the smallest. Of rows equal in text and id exactly
one stays. An empty table gives an empty result. Other columns play no part and may have any name.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meibo.operators.staging import stage

SUMMARY_SIZE = 16384
#: More candidates than digests can hold the share that the summary errs by; about 1 MB when broadcast.
HEAVY_MAX = SUMMARY_SIZE // 3


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text as lowercase hex."""
    return F.sha2(F.encode(ascii_lower(F.coalesce(text, F.lit(""))), "UTF-8"), 256)


def heavy_winners(rows: DataFrame, digest: str, best: Column) -> DataFrame:
    """``heavy_digest``, ``best`` (the largest) and ``size`` of frequent digests, at most ``HEAVY_MAX`` rows."""
    summary = F.expr(f"approx_top_k({digest}, {HEAVY_MAX}, {SUMMARY_SIZE})")
    candidates = rows.agg(summary.alias("top")).select(F.inline("top")).select(F.col("item").alias("heavy_digest"))
    return (
        rows.join(F.broadcast(candidates), F.col(digest) == F.col("heavy_digest"))
        .groupBy("heavy_digest")
        .agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
    )


def mark_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[Column] = ()
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and ``carry``.

    ``row`` numbers the rows of the staged copy, so that of fully equal rows one can be told apart.
    """
    rows = stage(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.monotonically_increasing_id().alias("row"),
            text_digest(F.col(f"`{text_col}`")).alias("digest"),
            *([F.struct(*carry).alias("carried")] if carry else []),
        ),
        "digests",
    )
    carried = ["carried"] if carry else []
    winners = heavy_winners(rows, "digest", F.struct("id", "row"))
    split = rows.join(F.broadcast(winners), F.col("digest") == F.col("heavy_digest"), "left")
    heavy = split.where("heavy_digest is not null").select(
        "id",
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        "digest",
        *carried,
    )
    group = Window.partitionBy("digest")
    order = group.orderBy(F.col("id").desc_nulls_last(), F.col("row").desc())
    rest = split.where("heavy_digest is null").select(
        "id",
        F.max("id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"),
        "digest",
        *carried,
    )
    out = heavy.unionAll(rest)
    shown = [f"{c}.*" for c in carried]
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"), *shown)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies, all columns as they were.

    Rows of a frequent text leave where they lie unless they hold the winning id. Equal rows of
    that id that remain, and rows of rare texts, meet in a shuffle.
    """
    columns = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"),
        F.col(f"`{id_col}`").alias("id"),
        text_digest(F.col(f"`{text_col}`")).alias("digest"),
    )
    rows = stage(packed.select("id", "digest"), "digests")
    winners = heavy_winners(rows, "digest", F.struct("id")).select("heavy_digest", F.col("best.id").alias("best_id"))
    order = Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last(), F.xxhash64("doc"))
    return (
        packed.join(F.broadcast(winners), F.col("digest") == F.col("heavy_digest"), "left")
        .where(F.col("heavy_digest").isNull() | F.col("id").eqNullSafe(F.col("best_id")))
        .withColumn("place", F.row_number().over(order))
        .where("place = 1")
        .select("doc.*")
    )
