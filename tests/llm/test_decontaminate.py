import random

import numpy as np

from meibo.llm import decontaminate as D
from meibo.llm.words import words


def text(seed, n):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(3000)}" for _ in range(n))


ITEMS = [(i, text(i, 30)) for i in range(20)]


def items(spark, rows=tuple(ITEMS)):
    """A benchmark with an extra column whose name clashes."""
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, id int")


def plain_tiles(doc, item):
    """Longest unmarked common run again and again, every pair of places compared."""
    used_a, used_b, total = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < D.SEED:
            return total
        total.append(best)
        used_a |= set(range(best[0], best[0] + best[2]))
        used_b |= set(range(best[1], best[1] + best[2]))


def test_tiles_match_plain_search():
    for seed in range(150):
        pick = random.Random(seed)
        item = "".join(pick.choice("abc") for _ in range(pick.randrange(5, 25)))
        doc = "".join(pick.choice("abc") for _ in range(pick.randrange(5, 40)))
        hashed = [words(" ".join(x))[0] for x in (doc, item)]
        at = [(j, i) for j in range(len(doc) - 4) for i in range(len(item) - 4) if doc[j : j + 5] == item[i : i + 5]]
        runs = D.runs_of_seeds(np.array([a for a, _ in at], int), np.array([b for _, b in at], int)) if at else None
        got = D.tiles(*hashed, runs) if at else []
        assert got == plain_tiles(doc, item)
        # All diagonals give the same runs as the shared seeds.
        dense = D.runs_of_diagonals(*hashed)
        assert sorted(zip(*(x.tolist() for x in dense), strict=True)) == sorted(zip(*(x.tolist() for x in runs), strict=True) if at else [])


def test_both_ways_find_the_same(monkeypatch):
    """Texts of few different words, whose seeds repeat, with and without the search of all diagonals."""
    for seed in range(60):
        pick = random.Random(seed)
        body = " ".join(pick.choice("ab") for _ in range(200))
        block = D.block_of([(i, " ".join(pick.choice("ab") for _ in range(pick.randrange(5, 30)))) for i in range(8)])
        with monkeypatch.context() as patch:
            patch.setattr(D, "DENSE_SHARE", 2.0)
            sparse = D.matches(block, body, 0.8)
        with monkeypatch.context() as patch:
            patch.setattr(D, "DENSE_CELLS", 100)
            assert D.matches(block, body, 0.8) == sparse


def test_repeated_words_take_bounded_time_and_memory():
    import time
    import tracemalloc

    block = D.block_of([(i, "same " * (200 + i) + "end") for i in range(20)] + [(90, "a b " * 100)])
    tracemalloc.start()
    start = time.time()
    found = D.matches(block, "same " * 20_000 + "a b " * 5_000, 0.9)
    took, (_, peak) = time.time() - start, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [k for k, _, _ in found] == [*range(20), 90] and took < 60 and peak < 300e6


def found(docs, bench, **options):
    rows = D.find_contamination(docs, bench, **options).collect()
    return {r["doc_id"]: [(x["item_id"], round(x["coverage"], 2)) for x in r["items"]] for r in rows}


def test_whole_edited_and_reordered_passages(spark, documents):
    whole = ITEMS[3][1]
    cut = whole.split()
    rows = [
        (1, text(90, 50) + "\n" + whole.upper().replace(" ", ", ") + "! " + text(91, 50)),
        (2, " ".join(cut[15:] + text(92, 9).split() + cut[:15])),
        (3, " ".join(cut[:14] + ["new"] + cut[15:])),
        (4, " ".join(cut[:20])),
        (5, text(93, 300)),
        (6, whole + " " + ITEMS[4][1]),
        (7, None), (8, ""), (None, whole), (9, (text(94, 10) + " ") * 5000 + whole),
    ]
    want = {1: [(3, 1.0)], 2: [(3, 1.0)], 3: [(3, 0.97)], 4: [], 5: [], 6: [(3, 1.0), (4, 1.0)], 7: [], 8: [], None: [(3, 1.0)], 9: [(3, 1.0)]}
    docs = documents(rows)
    assert found(docs, items(spark)) == want
    assert found(docs, items(spark), block_chars=300) == want
    kept = D.drop_contaminated(docs, items(spark))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 7, 8}


def test_spans_are_the_passage(spark, documents):
    body = "Before é𝕏. " + ITEMS[0][1] + " After."
    (row,) = D.find_contamination(documents([(1, body)]), items(spark)).collect()
    (span,) = row["items"][0]["spans"]
    assert body[span["start"] : span["end"]] == ITEMS[0][1]


def test_odd_benchmarks(spark, documents):
    docs = documents([(1, "one two three four five six"), (1, "one two three four five six")])
    odd = [(1, None), (2, ""), (3, "one two three"), (None, "one two three four five"), (4, "One two three four five."), (4, "One two three four five.")]
    rows = D.find_contamination(docs, items(spark, odd)).collect()
    assert [[x["item_id"] for x in r["items"]] for r in rows] == [[4], [4]]
    assert found(docs, items(spark, [])) == {1: []}
    assert found(documents([]), items(spark)) == {}
    assert D.drop_contaminated(docs, items(spark, [])).count() == 2


def test_every_text_of_the_benchmark_is_searched(spark, documents):
    one, two, lone, many = (text(s, 30) for s in (70, 71, 72, 73))
    bench = items(spark, [(1, one), (1, two), (1, two), (2, many), (None, lone), (None, lone), (None, many.upper()), (None, None)])
    docs = documents([(1, one), (2, two), (3, lone), (4, many), (5, one + " " + lone + " " + two), (6, text(74, 30))])
    want = {1: [(1, 1.0)], 2: [(1, 1.0)], 3: [(None, 1.0)], 4: [(2, 1.0)], 5: [(None, 1.0), (1, 1.0), (1, 1.0)], 6: []}
    assert found(docs, bench) == want
    assert found(docs, bench, block_chars=100) == want
    assert {r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()} == {6}
