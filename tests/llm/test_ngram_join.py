import random
from collections import Counter

import numpy as np
import pytest

from meibo.llm import ngram_join as J
from meibo.llm.components import components
from meibo.llm.words import shingles


def text(seed, n=60):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(5000)}" for _ in range(n))


def changed(base, seed, n):
    pick, words = random.Random(seed), base.split()
    for i in pick.sample(range(len(words)), n):
        words[i] = f"x{pick.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rows, base = [], text(0, 120)
    rows += [(i, changed(base, i, i % 3)) for i in range(40)]
    rows += [(100 + i, text(7)) for i in range(6)] + [(110, text(7).upper() + " !")]
    rows += [(200 + i, text(1, 30) + " " + text(300 + i, 90)) for i in range(20)]
    rows += [(400, "one two"), (401, "One, two"), (402, "one"), (403, None), (404, ""), (405, "..."), (None, text(7)), (400, "one two")]
    return rows


def brute(rows, threshold=J.THRESHOLD):
    sets = [set(shingles(t).tolist()) for _, t in rows]
    links, group = Counter(), list(range(len(rows)))

    def root(x):
        return x if group[x] == x else root(group[x])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                group[root(i)] = root(j)
    return links, [root(i) for i in range(len(rows))], sets


def check(rows, got):
    links, group, sets = brute(rows)
    names = {}
    for i, (doc, _) in enumerate(rows):
        names.setdefault(group[i], []).append(doc)
    key = lambda x: (x is not None, x or 0)
    want = Counter((doc, links[i], min(names[group[i]], key=key)) for i, (doc, _) in enumerate(rows))
    assert Counter((r["doc_id"], r["n_links"], r["group_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(names)


@pytest.mark.parametrize("blocks", [None, 7])
def test_matches_brute_force(documents, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(J, "BLOCK_CLASSES", blocks)
    rows = corpus()
    check(rows, J.near_copies(documents(rows)).collect())


def test_drop_keeps_one_of_each_group(documents):
    rows = corpus()
    docs = documents(rows)
    kept = J.drop_near_copies(docs)
    assert kept.columns == docs.columns
    _, group, _ = brute(rows)
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert sum(got.values()) == len(set(group))
    assert all(got[d, None] == 1 for d in (403,)) and got[404, ""] == 1 and got[400, "one two"] == 1


def test_empty_tables_and_tables_without_words(documents):
    assert not J.near_copies(documents([])).collect() and not J.drop_near_copies(documents([])).collect()
    rows = [(1, None), (2, ""), (2, ""), (3, "only one here")]
    check(rows, J.near_copies(documents(rows)).collect())
    assert J.drop_near_copies(documents(rows)).count() == 4


def test_long_text(documents):
    base = text(3, 60_000)
    rows = [(1, base), (2, changed(base, 1, 100)), (3, text(4, 60_000))]
    check(rows, J.near_copies(documents(rows)).collect())


def test_pruning_needs_more_agreement_later():
    needed = J.keep_counts(0.8, 1e-6)
    assert (np.diff(needed) >= 0).all() and needed[0] < J.LOOK and needed[-1] <= 0.8 * J.BANDS * J.BAND_ROWS
    # A pair at the threshold is dropped so seldom that no link is lost.
    random_ = np.random.default_rng(1)
    agree = np.cumsum(random_.random((20_000, J.BANDS * J.BAND_ROWS)) < 0.8, axis=1)[:, J.LOOK - 1 :: J.LOOK]
    assert (agree < needed).any(axis=1).mean() < 1e-3


def test_signature_estimates_the_similarity():
    a, b = shingles(text(0, 2000)), shingles(changed(text(0, 2000), 1, 60))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((J.signature(a) == J.signature(b)).mean() - exact) < 0.12


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (102, 102), (None, 5)]
    random.Random(2).shuffle(path)
    got = dict(components(spark.createDataFrame(path, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 102}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
