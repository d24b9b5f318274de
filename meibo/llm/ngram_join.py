"""Near copies by the Jaccard similarity of word shingles, with Bayesian candidate pruning.

1. Every text becomes the set of its five-word shingles and a MinHash signature. Texts with the
   same set are one *class of copies* from here on, known by a digest of the set.
2. Signatures are cut into bands. Classes that agree in a band are candidates of each other; the
   connected groups of such candidates are found as components.
3. A group is compared in blocks of bounded weight, each pair of blocks in one task group, so that
   no pair of classes is ever a row. Inside, only pairs that agree in a band count. Their MinHash
   values are compared a few at a time, and a pair is dropped as soon as the posterior probability
   that its similarity reaches the threshold is below the tolerance. For the rest the shingle sets
   are compared exactly.
4. The links that hold make groups of near copies.

At a similarity of 0.8 a pair agrees in none of the bands with a chance of 3e-6.

A text with fewer than five words has one shingle of all its words. A null or empty text, or one
without words, has none and is linked to nothing; it is a group of its own for each row. Rows with a
null id take part and are grouped like others. Repeated rows are copies of each other. An empty
table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import hashlib
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meibo.llm.components import components
from meibo.llm.words import shingles
from meibo.operators.staging import stage

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
BAND_ROWS = 5
#: MinHash values compared between two looks at the posterior.
LOOK = 16
#: Posterior probability below which a pair is dropped.
TOLERANCE = 1e-6
#: Shingles and classes that a block holds, about.
BLOCK_SHINGLES = 200_000
BLOCK_CLASSES = 512


@cache
def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    n = BANDS * BAND_ROWS
    return (
        random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
        random.integers(0, 1 << 63, n, dtype=np.uint64),
    )


def signature(found: np.ndarray) -> np.ndarray:
    """The 32-bit MinHash values of a set of shingle hashes."""
    factor, shift = _hash_family()
    out = np.full(len(factor), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), 512):
        part = found[start : start + 512]
        np.minimum(out, (factor[:, None] * part + shift[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def keep_counts(threshold: float, tolerance: float) -> np.ndarray:
    """How many values must agree at each look for a pair to stay.

    The prior of the similarity is uniform. After n values of which m agree, the posterior is
    Beta(m + 1, n - m + 1); a pair stays while P(similarity >= threshold) >= tolerance.
    """
    total = BANDS * BAND_ROWS
    at = np.linspace(0.0, 1.0, 20001)[1:-1]
    needed = []
    for n in range(LOOK, total + 1, LOOK):
        for m in range(n + 1):
            log = m * np.log(at) + (n - m) * np.log1p(-at)
            mass = np.exp(log - log.max())
            if mass[at >= threshold].sum() / mass.sum() >= tolerance:
                needed.append(m)
                break
    return np.array(needed)


def _band_of_pairs(left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """Index pairs (i, j) that agree in a band, each once; i < j when both sides are the same."""
    found = []
    for band in range(BANDS):
        cut = slice(band * BAND_ROWS, (band + 1) * BAND_ROWS)
        keys = np.concatenate((left[:, cut], right[:, cut])) if not same else left[:, cut]
        keys = np.ascontiguousarray(keys).view(np.dtype((np.void, 4 * BAND_ROWS))).ravel()
        _, code = np.unique(keys, return_inverse=True)
        one, two = (code, code) if same else (code[: len(left)], code[len(left) :])
        order = np.argsort(two, kind="stable")
        low = np.searchsorted(two[order], one, "left")
        high = np.searchsorted(two[order], one, "right")
        size = high - low
        i = np.repeat(np.arange(len(one)), size)
        j = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
        if same:
            i, j = i[i < j], j[i < j]
        found.append(np.unique(i * len(right) + j))
    pairs = np.unique(np.concatenate(found))
    return np.stack((pairs // len(right), pairs % len(right)), axis=1)


def _links(a: list, b: list | None, threshold: float, needed: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of two blocks (or within one) whose exact similarity reaches the threshold."""
    same = b is None
    b = a if same else b
    left = np.stack([np.frombuffer(x["signature"], np.uint32) for x in a])
    right = left if same else np.stack([np.frombuffer(x["signature"], np.uint32) for x in b])
    pairs = _band_of_pairs(left, right, same)
    sizes = [np.array([len(x["shingles"]) // 8 for x in side]) for side in (a, b)]
    small, large = np.sort(np.stack((sizes[0][pairs[:, 0]], sizes[1][pairs[:, 1]])), axis=0)
    pairs = pairs[small >= threshold * large - 1e-9]
    agree = np.zeros(len(pairs), dtype=np.int64)
    for look, least in enumerate(needed):
        cut = slice(look * LOOK, (look + 1) * LOOK)
        agree += (left[pairs[:, 0], cut] == right[pairs[:, 1], cut]).sum(axis=1)
        stay = agree >= least
        pairs, agree = pairs[stay], agree[stay]
    sets = [[np.frombuffer(x["shingles"], np.uint64) for x in side] for side in (a, b)]
    good = []
    for i, j in pairs.tolist():
        x, y = sets[0][i], sets[1][j]
        if len(x) > len(y):
            x, y = y, x
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        if both >= threshold * (len(x) + len(y) - both) - 1e-9:
            good.append((i, j))
    return good


def _compare(a: list, b: list | None, threshold: float, needed: np.ndarray) -> list[tuple]:
    """(class, linked documents, class it hangs on) rows of one unit; the last is null or a tree edge."""
    pairs = _links(a, b, threshold, needed)
    same = b is None
    b = a if same else b
    count: dict[bytes, int] = {}
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = []
    for i, j in pairs:
        x, y = a[i], b[j]
        count[x["class"]] = count.get(x["class"], 0) + y["copies"]
        count[y["class"]] = count.get(y["class"], 0) + x["copies"]
        one, two = root(x["class"]), root(y["class"])
        if one != two:
            parent[max(one, two)] = min(one, two)
            tree.append((x["class"], y["class"]))
    return [(c, n, None) for c, n in count.items()] + [(x, 0, y) for x, y in tree]


def summaries(texts: pd.Series) -> pd.DataFrame:
    """Class, shingles and signature of a text; a text without words has no class."""
    rows = []
    for value in texts:
        found = shingles(value, SHINGLE)
        rows.append((_digest(found), len(found), signature(found).tobytes()) if len(found) else (None, 0, None))
    return pd.DataFrame(rows, columns=["class", "size", "signature"])


def shingle_bytes(texts: pd.Series) -> pd.Series:
    """The shingle hashes of a text."""
    return pd.Series([shingles(t, SHINGLE).tobytes() for t in texts])


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def place_of(doc_id: Column, text: Column) -> Column:
    """Where a text is found again: a digest of id and text. Rows equal in both share it."""
    named = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.md5(F.concat_ws("\n", named, text).cast("binary"))


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id``, ``n_links``, ``group_id``, ``kept``.

    ``class_id`` is the smallest id with the same shingles, ``n_links`` the number of other rows
    at least ``threshold`` similar, ``group_id`` the smallest id of the group that links connect.
    One row of each group is ``kept``, the one with the smallest id.
    """
    rows = _marked(docs, F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), threshold, tolerance)
    return rows.select(F.col("id").alias(id_col), "class_id", "n_links", "group_id", "kept")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns as they were."""
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    kept = _marked(docs, doc_id, text, options.get("threshold", THRESHOLD), options.get("tolerance", TOLERANCE))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), place_of(doc_id, text).alias("place"))
    found = packed.join(kept.where("kept").select("place", "grouped").distinct(), "place")
    order = Window.partitionBy("place").orderBy(F.xxhash64("doc"))
    # Equal rows are copies of each other, unless they hold no words.
    return (
        found.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth").eqNullSafe(1) | ~F.col("grouped"))
        .select("doc.*")
    )


def _marked(docs: DataFrame, doc_id: Column, text: Column, threshold: float, tolerance: float) -> DataFrame:
    """One row per row of ``docs``; ``grouped`` says whether the text has words."""
    summary = F.pandas_udf(summaries, "class binary, size int, signature binary")
    made = docs.select(
        doc_id.alias("id"), F.monotonically_increasing_id().alias("row"), place_of(doc_id, text).alias("place"), summary(text).alias("made")
    )
    rows = stage(made.select("id", "row", "place", "made.*"), "signatures")
    classes = stage(
        rows.where("class is not null")
        .groupBy("class")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(F.struct("id", "row", "place")).alias("first"),
            F.min("id").alias("class_id"),
            F.max("size").alias("size"),
            F.min("signature").alias("signature"),
        ),
        "classes",
    )
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    width = 4 * BAND_ROWS
    banded = classes.select("class", "signature", band).select(
        "class", F.xxhash64("band", F.expr(f"substring(signature, band * {width} + 1, {width})")).alias("bucket")
    )
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("least")).where("n > 1")
    edges = banded.join(shared, "bucket").where(F.col("class") != F.col("least")).select(F.col("least").alias("a"), F.col("class").alias("b"))
    groups = stage(components(edges), "candidates")
    links = stage(_linked(docs, doc_id, text, classes, groups, threshold, tolerance), "links")
    degree = links.groupBy("class").agg(F.sum("n").alias("n"))
    trees = components(links.where("hang is not null").select(F.col("class").alias("a"), F.col("hang").alias("b")))
    named = (
        classes.drop("signature", "size")
        .join(degree, "class", "left")
        .join(trees.select(F.col("node").alias("class"), F.col("component").alias("tree")), "class", "left")
        .withColumn("tree", F.coalesce("tree", "class"))
    )
    heads = named.groupBy("tree").agg(F.min(F.struct(F.col("first.id").alias("id"), F.col("first.row").alias("row"))).alias("head"))
    known = named.join(heads, "tree").select(
        "class", "class_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.col("head.id").alias("group_id"), F.col("head.row").alias("head_row")
    )
    joined = rows.select("id", "row", "place", "class").join(known, "class", "left")
    alone = F.col("class").isNull()
    return joined.select(
        "id",
        "place",
        (~alone).alias("grouped"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("group_id")).alias("group_id"),
        (alone | (F.col("row") == F.col("head_row"))).alias("kept"),
    )


def _linked(docs, doc_id, text, classes, groups, threshold, tolerance) -> DataFrame:
    """(class, n, hang): linked documents of a class in one unit, and tree edges, from blocks of each group."""
    grouped = classes.join(groups.select(F.col("node").alias("class"), F.col("component").alias("group")), "class")
    wanted = grouped.select("first.place", "class", "copies", "group", "signature")
    blocks = grouped.groupBy("group").agg(
        F.greatest(
            F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.lit(1)
        ).alias("blocks")
    )
    packed = F.pandas_udf(shingle_bytes, "binary")
    # The join has dealt by place, so equal rows of a text meet without another shuffle.
    members = (
        docs.select(place_of(doc_id, text).alias("place"), text.alias("text"))
        .join(wanted, "place")
        .select("place", "class", "copies", "group", "signature", packed("text").alias("shingles"))
        .dropDuplicates(["place", "class"])
    )
    spread = (
        members.join(blocks, "group")
        .withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "group",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "own",
            "class",
            "copies",
            "signature",
            "shingles",
        )
    )
    needed = keep_counts(threshold, tolerance)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, held = None, []
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                key = (row["group"], row["low"], row["high"])
                if key != unit:
                    out += unit_rows(unit, held)
                    unit, held = key, []
                held.append(row)
            yield frame(out)
        yield frame(unit_rows(unit, held))

    def unit_rows(unit, held: list) -> list:
        if len(held) < 2:
            return []
        if unit[1] == unit[2]:
            return _compare(held, None, threshold, needed)
        a = [r for r in held if r["own"] == unit[1]]
        b = [r for r in held if r["own"] == unit[2]]
        return _compare(a, b, threshold, needed) if a and b else []

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["class", "n", "hang"])

    unit = ["group", "low", "high"]
    return spread.repartition(*unit).sortWithinPartitions(*unit).mapInPandas(compare, "class binary, n long, hang binary")
