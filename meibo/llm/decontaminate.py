"""Benchmark passages in documents, found by greedy string tiling.

Runs of five words that a document shares with a benchmark item are the seeds. From them the
longest common run of words is marked in both texts, then the longest among the words still
unmarked, and so on (running Karp-Rabin greedy string tiling: the runs grow over rolling word
hashes). An item is contaminated by a document when its marked words reach the threshold, in
whatever order the passages stand.

The benchmark is handled in blocks of bounded size. Each block is broadcast and all documents are
searched in one map; a larger benchmark means more blocks, never a larger broadcast.

A null or empty document contains nothing. A benchmark item with fewer than five words, null or
empty, is contained in nothing. Repeated benchmark rows count once; different texts under one id are
searched and reported each. A text without item id is reported with a null id, or under the ids
that have the same words if there are any.
Among matches of equal length the first in the item, then the first in the document, is marked.
Repeated documents get equal results; other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.llm.words import grams, words
from meibo.operators.staging import stage

SEED = 5
COVERAGE = 0.8
#: Characters of benchmark text in one broadcast block, about.
BLOCK_CHARS = 4_000_000
#: Words compared at once where a text and an item share many seeds, and the share of their pairs of places
#: from which that is cheaper than the pairs.
DENSE_CELLS = 4_000_000
DENSE_SHARE = 0.02


@dataclass
class Block:
    """Benchmark items and where each of their seeds stands, sorted by the seed's hash."""

    ids: list
    items: list[np.ndarray]
    seeds: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def block_of(rows: list[tuple]) -> Block:
    """A block of (item id, text) rows."""
    items = [words(text)[0] for _, text in rows]
    found = [grams(x, SEED) for x in items]
    seeds = np.concatenate([*found, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(items)), [len(x) for x in found])
    place = np.concatenate([*[np.arange(len(x)) for x in found], np.zeros(0, np.int64)])
    order = np.argsort(seeds, kind="stable")
    return Block([r[0] for r in rows], items, seeds[order], owner[order], place[order])


def runs_of_seeds(at_doc: np.ndarray, at_item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common runs (place in the item, place in the document, length) from the places of shared seeds.

    Seeds that follow each other on a diagonal are one run.
    """
    diagonal = at_doc - at_item
    order = np.lexsort((at_item, diagonal))
    d, i = diagonal[order], at_item[order]
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1))))
    length = np.diff(np.concatenate((first, [len(i)]))) + SEED - 1
    return i[first], i[first] + d[first], length


def runs_of_diagonals(doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same runs from all diagonals, some at a time, for texts that share more seeds than they have places.

    Memory is bounded; a text that repeats itself costs a comparison of words and not a pair of seeds.
    """
    size = len(item)
    # No word has the hash of the padding on purpose; if one should, the tiles compare the words again.
    pad = np.full(size, np.uint64(0x9E3779B97F4A7C15))
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((pad, doc, pad)), size)
    real = np.concatenate((np.zeros(size, bool), np.ones(len(doc), bool), np.zeros(size, bool)))
    inside = np.lib.stride_tricks.sliding_window_view(real, size)
    step = max(1, DENSE_CELLS // size)
    found = []
    for start in range(0, len(windows), step):
        same = np.zeros((min(step, len(windows) - start), size + 2), dtype=np.int8)
        same[:, 1:-1] = (windows[start : start + step] == item) & inside[start : start + step]
        edge = np.diff(same, axis=1)
        row, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1]
        long = end - begin >= SEED
        found.append((begin[long], row[long] + start + begin[long] - size, end[long] - begin[long]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cut(runs: tuple, x: int, y: int, n: int) -> tuple:
    """What is left of the runs when ``n`` words from ``x`` in the item and ``y`` in the document are gone."""
    a, b, size = runs
    low1, high1 = (np.clip(x + e - a, 0, size) for e in (0, n))
    low2, high2 = (np.clip(y + e - b, 0, size) for e in (0, n))
    first = np.where(low1 <= low2, low1, low2)
    first_end, second = np.where(low1 <= low2, high1, high2), np.where(low1 <= low2, low2, low1)
    start = np.concatenate((np.zeros_like(a), first_end, np.maximum(high1, high2)))
    end = np.concatenate((first, second, size))
    a, b, kept = np.tile(a, 3) + start, np.tile(b, 3) + start, end - start >= SEED
    return a[kept], b[kept], (end - start)[kept]


def tiles(doc: np.ndarray, item: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, length) from the common runs.

    The longest run is taken; all runs lose the words that it has marked, and the longest of what is left
    is the next. Each tile is a step over all runs at once, and an item has few tiles.
    """
    done = []
    while len(runs[0]):
        a, b, size = runs
        n = int(size.max())
        longest = np.flatnonzero(size == n)
        best = longest[np.lexsort((b[longest], a[longest]))[0]]
        x, y = int(a[best]), int(b[best])
        # The hashes said so already; compare the words themselves.
        if np.array_equal(item[x : x + n], doc[y : y + n]):
            done.append((x, y, n))
            runs = _cut(runs, x, y, n)
        else:
            runs = tuple(np.delete(r, best) for r in runs)
    return done


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``first`` to ``first + size`` of every pair, one after another."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def matches(block: Block, text: str | None, coverage: float) -> list[tuple]:
    """(item id, coverage, spans) of the items that a text contains; spans in code points.

    A seed that a text repeats counts once until an item is known to be in reach.
    """
    hashes, starts, ends = words(text)
    found = grams(hashes, SEED)
    if not len(found) or not len(block.seeds):
        return []
    low = np.searchsorted(block.seeds, found, "left")
    hit = np.flatnonzero(block.seeds[np.minimum(low, len(block.seeds) - 1)] == found)
    if not len(hit):
        return []
    # Places in the text by seed, and the block's entries of each different seed.
    order = hit[np.argsort(low[hit], kind="stable")]
    low, first, times = np.unique(low[order], return_index=True, return_counts=True)
    size = np.searchsorted(block.seeds, block.seeds[low], "right") - low
    entry, seed = _spread(low, size), np.repeat(np.arange(len(low)), size)
    owner = block.owner[entry]
    out = []
    for k in np.unique(owner).tolist():
        item, mine = block.items[k], np.flatnonzero(owner == k)
        # Words in reach of a seed bound the coverage from above.
        reach = np.zeros(len(item), dtype=bool)
        for shift in range(SEED):
            reach[block.place[entry[mine]] + shift] = True
        if reach.sum() < coverage * len(item):
            continue
        n = times[seed[mine]]
        if n.sum() > max(len(hashes), DENSE_SHARE * len(hashes) * len(item)) or n.sum() > DENSE_CELLS:
            runs = runs_of_diagonals(hashes, item)
        else:
            runs = runs_of_seeds(order[_spread(first[seed[mine]], n)], np.repeat(block.place[entry[mine]], n))
        done = tiles(hashes, item, runs)
        share = sum(n for _, _, n in done) / len(item)
        if share >= coverage:
            spans = sorted((int(starts[b]), int(ends[b + n - 1])) for _, b, n in done)
            out.append((block.ids[k], share, spans))
    return out


FOUND = "array<struct<item_id: long, coverage: double, spans: array<struct<start: int, end: int>>>>"


def _finder(block: Block, coverage: float):
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([matches(block, t, coverage) for t in texts], dtype=object)

    return F.pandas_udf(find, FOUND)


def _wording(text: Column) -> Column:
    """A digest of the words of a text; null when they are too few to be found."""

    def digest(texts: pd.Series) -> pd.Series:
        found = [words(t)[0] for t in texts]
        return pd.Series([sha256(x.tobytes()).digest() if len(x) >= SEED else None for x in found], dtype=object)

    return F.pandas_udf(digest, "binary")(text)


def _items(benchmark: DataFrame) -> DataFrame:
    """Every (id, text) that can be found, once. A text without id stays unless an id has the same words."""
    rows = benchmark.select("id", "text").where("text is not null").distinct()
    rows = stage(rows.withColumn("wording", _wording(F.col("text"))).where("wording is not null"), "benchmark")
    named = rows.where("id is not null")
    unnamed = rows.where("id is null").join(named.select("wording").distinct(), "wording", "left_anti")
    return stage(named.unionByName(unnamed).select("id", "text"), "benchmark")


def _blocks(benchmark: DataFrame, block_chars: int) -> list[Block]:
    """The benchmark in blocks by a hash of the item; one block at a time is read to the driver."""
    items = _items(benchmark)
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    count = -(-chars // block_chars)
    part = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(max(1, count))))
    return [block_of([(r["id"], r["text"]) for r in part.where(F.col("block") == k).sort("id", "text").collect()]) for k in range(count)]


def contained_items(docs: DataFrame, benchmark: DataFrame, text: Column, coverage: float, block_chars: int) -> Column:
    """The items contained in ``text``: one search for each block of the benchmark."""
    found = [_finder(b, coverage)(text) for b in _blocks(benchmark, block_chars)]
    return reduce(F.concat, found) if found else F.array().cast(FOUND)


def _benchmark(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("id"), "text")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    coverage: float = COVERAGE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``contaminated``, ``items`` (id, coverage and spans, by item id)."""
    text = F.col(f"`{text_col}`")
    found = contained_items(docs, _benchmark(benchmark), text, coverage, block_chars)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.array_sort(found).alias("items"))
    return rows.select(F.col("id").alias(id_col), (F.size("items") > 0).alias("contaminated"), "items")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    coverage: float = COVERAGE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item."""
    found = contained_items(docs, _benchmark(benchmark), F.col(f"`{text_col}`"), coverage, block_chars)
    return docs.where(F.size(found) == 0)
