"""SimHash near copies, found exactly with vantage-point trees.

1. A text becomes a 64-bit fingerprint: a bit is 1 when it is set in over half the hashes of the text's
   four-word shingles. Rows with one fingerprint are one point from here on.
2. Two points within ``DISTANCE`` bits are, on at least one of ``FIELDS`` equal fields of the fingerprint,
   within ``DISTANCE // FIELDS`` bits. The Hamming distance on a field obeys the triangle inequality, so each
   field has a vantage-point tree of its own: a node holds a vantage point and a radius, and points inside
   and outside the radius go to different branches. The trees are fitted on a sample of at most ``SAMPLE``
   points; they decide where points go, not what is found.
3. Every point lives in one leaf, a shard, of each tree. A branch is pruned when the triangle bound says
   that no partner can be there; a point near a boundary is sent as a query to the shards beyond it. Of two
   shards it is the outer one's point that visits.
4. In a shard, points are compared by their whole fingerprints. A search from point to point takes each
   point off the list when it is reached, so a group of very many near copies costs about one pass and
   gives the links of a spanning tree only. A shard of more than ``BLOCK`` points is compared in pairs of
   blocks.
5. The links make components.

A null or empty text, or one of white space only, has the fingerprint zero, which is linked like any other.
Null ids take part; a component of null ids alone has a null id. Repeated rows share a fingerprint. An empty
table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meibo.llm.components import components
from meibo.operators.lookup import lookup_join
from meibo.operators.staging import stage

SHINGLE = 4
SEED = 42
DISTANCE = 4
FIELDS = 4
BITS = 64
#: Points that the trees are fitted on at most; about 1 MB on the driver.
SAMPLE = 1 << 17
#: Points that live in a shard, about, and sample points that a node needs to be split.
SHARD = 2048
FEW = 32
#: Vantage points and radii tried for a node.
TRIES = 12
#: Points of a shard that are compared in one piece.
BLOCK = 1 << 16
#: Words of a text that are hashed at once.
WORDS = 1 << 16


# ---- fingerprints --------------------------------------------------------------------------


def _bit_counts(words: list[bytes], size: int) -> np.ndarray:
    """How many shingles of ``size`` words have each bit set."""
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    # Bytes split and lower at ASCII signs only, which is what the words are defined by.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1 if words else 0
    total = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, WORDS):
        total += _bit_counts(words[start : min(start + WORDS, n) + size - 1], size)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed 64-bit numbers."""
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


# ---- trees ---------------------------------------------------------------------------------


@dataclass
class Tree:
    """A vantage-point tree over the bits of ``mask``. A child below 0 is the shard -1 - child."""

    mask: np.uint64
    slack: int
    vantage: list[int] = field(default_factory=list)
    radius: list[int] = field(default_factory=list)
    inner: list[int] = field(default_factory=list)
    outer: list[int] = field(default_factory=list)
    shards: int = 0

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, shard, visiting) for the home of each point and every shard that it must visit."""
        vantage, radius = np.array(self.vantage, np.uint64), np.array(self.radius, np.int64)
        inner, outer = np.array(self.inner, np.int64), np.array(self.outer, np.int64)
        point = np.arange(len(points))
        node = np.zeros(len(points), np.int64) if len(vantage) else np.full(len(points), -1)
        visiting = np.zeros(len(points), bool)
        done = []
        while len(point):
            leaf = node < 0
            done.append((point[leaf], -1 - node[leaf], visiting[leaf]))
            point, node, visiting = point[~leaf], node[~leaf], visiting[~leaf]
            far = np.bitwise_count((points[point] ^ vantage[node]) & self.mask).astype(np.int64)
            inside = far <= radius[node]
            # A point at home goes its way; as a query it also goes inward over a boundary. A visitor goes both ways.
            inward = far - self.slack <= radius[node]
            outward = far + self.slack > radius[node]
            sides = (
                (~visiting & inside, inner, False),
                (~visiting & ~inside, outer, False),
                (~visiting & ~inside & inward, inner, True),
                (visiting & inward, inner, True),
                (visiting & outward, outer, True),
            )
            parts = [(point[go], child[node[go]], np.full(go.sum(), as_visitor)) for go, child, as_visitor in sides]
            point, node, visiting = (np.concatenate(x) for x in zip(*parts, strict=True))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (point, node, visiting)


def _split(values: np.ndarray, tree: Tree, random: np.random.Generator) -> tuple[int, int] | None:
    """The vantage point and radius with the fewest comparisons expected, or None when no split helps."""
    best, cost = None, 0.95
    for vantage in random.choice(values, min(TRIES, len(values)), replace=False):
        share = np.bincount(np.bitwise_count((values ^ vantage) & tree.mask), minlength=BITS + 1).cumsum() / len(values)
        for radius in range(BITS):
            within = share[radius]
            if 0 < within < 1:
                inward = share[min(radius + tree.slack, BITS)]
                outward = 1 - (share[radius - tree.slack] if radius >= tree.slack else 0)
                expected = within * inward + (1 - within) * outward
                if expected < cost:
                    best, cost = (int(vantage), radius), expected
    return best


def build_tree(sample: np.ndarray, total: int, mask: int, slack: int, seed: int) -> Tree:
    """A tree whose shards hold about ``SHARD`` of ``total`` points, as far as the sample tells."""
    tree = Tree(np.uint64(mask), slack)
    random = np.random.default_rng(seed)
    open_nodes = [(sample, None)]
    while open_nodes:
        values, place = open_nodes.pop()
        many = len(values) >= FEW and len(values) * total > SHARD * len(sample)
        chosen = _split(values, tree, random) if many else None
        if chosen is None:
            number = -1 - tree.shards
            tree.shards += 1
        else:
            number = len(tree.vantage)
            for column, value in zip((tree.vantage, tree.radius, tree.inner, tree.outer), (*chosen, 0, 0), strict=True):
                column.append(value)
            inside = np.bitwise_count((values ^ np.uint64(chosen[0])) & tree.mask) <= chosen[1]
            open_nodes += [(values[inside], (tree.inner, number)), (values[~inside], (tree.outer, number))]
        if place:
            place[0][place[1]] = number
    return tree


def masks(fields: int = FIELDS) -> list[int]:
    """The bits of each field."""
    edges = [BITS * i // fields for i in range(fields + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def fit(points: DataFrame, distance: int = DISTANCE, fields: int = FIELDS, sample: int = SAMPLE) -> list[Tree]:
    """Trees for ``points`` (column ``point``). At most ``sample`` of them, in the order of a hash, reach the driver."""
    total = points.count()
    picked = points.select("point").orderBy(F.xxhash64("point")).limit(sample)
    values = np.array([r["point"] for r in picked.collect()], dtype=np.int64).view(np.uint64)
    return [build_tree(values, total, mask, distance // fields, i) for i, mask in enumerate(masks(fields))]


# ---- shards --------------------------------------------------------------------------------


def spanning_links(points: np.ndarray, visiting: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs that connect what links connect, where two visitors are not compared.

    A search goes from point to point; whoever is reached is taken off the list.
    """
    homes, guests = np.flatnonzero(~visiting), np.flatnonzero(visiting)
    links: list[tuple[int, int]] = []

    def reached(at: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.bitwise_count(points[left] ^ points[at]) <= distance
        return left[near], (left[~near] if near.any() else left)

    while len(homes):
        todo = [int(homes[0])]
        homes = homes[1:]
        while todo:
            at = todo.pop()
            found, homes = reached(at, homes)
            if not visiting[at]:
                more, guests = reached(at, guests)
                found = np.concatenate((found, more))
            links += [(at, int(x)) for x in found]
            todo += found.tolist()
    return links


def _routed(batches: Iterator[pd.DataFrame], trees: list[Tree]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        points = batch["point"].to_numpy().view(np.uint64)
        for number, tree in enumerate(trees):
            point, shard, visiting = tree.route(points)
            yield pd.DataFrame({"tree": number, "shard": shard, "point": points[point].view(np.int64), "visiting": visiting})


def find_links(points: DataFrame, distance: int = DISTANCE, fields: int = FIELDS) -> DataFrame:
    """Pairs (``a``, ``b``) of points within ``distance`` bits that connect all that such pairs connect."""
    trees = fit(points, distance, fields)
    routed = stage(points.select("point").mapInPandas(lambda b: _routed(b, trees), "tree int, shard long, point long, visiting boolean"), "routed")
    # One row for each large shard, of which there are as many as trees have leaves at most.
    large = routed.groupBy("tree", "shard").count().where(F.col("count") > BLOCK)
    large = large.select("tree", "shard", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    dealt = (
        routed.join(F.broadcast(large), ["tree", "shard"], "left")
        .withColumn("own", F.pmod(F.xxhash64("point"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("tree", "shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "point", "visiting")
    )

    def compare(unit: pd.DataFrame) -> pd.DataFrame:
        values = unit["point"].to_numpy().view(np.uint64)
        pairs = spanning_links(values, unit["visiting"].to_numpy(), distance)
        ends = values.view(np.int64)[np.array(pairs, dtype=np.int64).reshape(-1, 2)]
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return dealt.groupBy("tree", "shard", "low", "high").applyInPandas(compare, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, fields: int = FIELDS) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id that links reach from the row, its own included.
    """
    made = F.pandas_udf(fingerprints, "long")(F.col(f"`{text_col}`"))
    rows = stage(docs.select(F.col(f"`{id_col}`").alias("id"), made.alias("point")), "fingerprints")
    points = stage(rows.groupBy("point").agg(F.min("id").alias("least")), "points")
    nodes = stage(components(find_links(points, distance, fields)), "simhash-components")
    named = points.join(nodes.withColumnRenamed("node", "point"), "point", "left")
    named = stage(named.select("point", "least", F.coalesce("component", "point").alias("component")), "simhash-points")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = lookup_join(named.select("point", "component"), ["component"], least, "inner", staged=True)
    done = lookup_join(rows, ["point"], known.select("point", "component_id"), "inner", staged=True)
    shown = F.lower(F.lpad(F.hex("point"), 16, "0"))
    return done.select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")
