import random
import re

import numpy as np
import pytest
import xxhash

from meibo.llm import simhash_join as S
from meibo.llm.components import components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    size = min(4, len(words))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(points, distance):
    """The smallest index that links reach, for each index."""
    group = list(range(len(points)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(points))]


def words(seed, n):
    pick = random.Random(seed)
    return [f"w{pick.randrange(3000)}" for _ in range(n)]


def corpus():
    rows, base = [], words(1, 400)
    for i in range(60):  # a chain and a cloud of near copies
        changed = list(base)
        changed[(7 * i) % 400] = f"x{i}"
        rows.append((100 + i, " ".join(changed[: 400 - i % 3])))
    rows += [(i, " ".join(words(i + 10, 5 + i))) for i in range(60)]
    rows += [(200, None), (201, ""), (199, " \t\n"), (202, "one"), (203, "ONE"), (204, "one two"), (202, "one")]
    rows += [(None, "one"), (300, " one two é É"), (301, " one two é é"), (302, "A\x0bb\x0cC d e"), (None, " ".join(base))]
    return rows


def test_fingerprints_match_the_definition():
    texts = [t for _, t in corpus()] + ["a " * 5000, "x" * 100_000, "a b c", "\x1c \x1d a \x85 b", "Ünï CODE words here"]
    assert [S.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(words(3, 1000))
    want = S.fingerprint(text)
    monkeypatch.setattr(S, "WORDS", 37)
    assert S.fingerprint(text) == want == plain_fingerprint(text)


def test_components_match_brute_force(documents):
    rows = corpus()
    points = [plain_fingerprint(t) for _, t in rows]
    group = brute_groups(points, 4)
    least = {}
    for (doc, _), g in zip(rows, group, strict=True):
        least[g] = min([x for x in (least.get(g), doc) if x is not None], default=None)
    want = sorted(((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, points, group, strict=True)), key=repr)
    got = sorted((tuple(r) for r in S.near_copies(documents(rows)).collect()), key=repr)
    assert got == want


def test_no_rows(documents):
    assert S.near_copies(documents([])).collect() == []


def near_points(seed, n=600):
    """Random points, clouds around some, and points that differ by the same bit of each field."""
    pick = random.Random(seed)
    out = [pick.getrandbits(64) for _ in range(n // 2)]
    while len(out) < n:
        point = pick.choice(out)
        for bit in pick.sample(range(64), pick.randrange(1, 6)):
            point ^= 1 << bit
        out.append(point)
    out += [p ^ 0x0001000100010001 for p in out[:20]] + [0, (1 << 64) - 1, 1 << 63]
    return sorted(set(out))


@pytest.mark.parametrize(
    "block, shard, distance, fields", [(1 << 16, 16, 4, 4), (40, 64, 4, 4), (50, 10_000, 4, 1), (1 << 16, 32, 3, 2), (60, 16, 0, 4)]
)
def test_trees_lose_no_link(spark, monkeypatch, block, shard, distance, fields):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "SHARD", shard)
    monkeypatch.setattr(S, "FEW", 8)
    points = near_points(distance)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in points]
    links = S.find_links(spark.createDataFrame(signed, "point long"), distance, fields)
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    known = {s[0]: p for s, p in zip(signed, points, strict=True)}
    assert all((known[a] ^ known[b]).bit_count() <= distance for a, b in pairs)
    nodes = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect()) if pairs else {}
    got, group = {}, brute_groups(points, distance)
    for (s,), g in zip(signed, group, strict=True):
        got.setdefault(nodes.get(s, s), set()).add(g)
    assert len(got) == len(set(group)) and all(len(g) == 1 for g in got.values())


def test_every_near_pair_meets_in_a_shard(monkeypatch):
    monkeypatch.setattr(S, "SHARD", 8)
    monkeypatch.setattr(S, "FEW", 4)
    points = np.array(near_points(9), dtype=np.uint64)
    # The trees are fitted on a part of the points only.
    trees = [S.build_tree(points[::3], len(points), mask, 1, i) for i, mask in enumerate(S.masks())]
    assert all(t.shards > 4 for t in trees)
    meet = set()
    for tree in trees:
        point, shard, visiting = tree.route(points)
        assert sorted(point[~visiting]) == list(range(len(points)))
        home = dict(zip(point[~visiting].tolist(), shard[~visiting].tolist(), strict=True))
        at = set(zip(point.tolist(), shard.tolist(), strict=True))
        meet |= {(i, j) for i in home for j in home if (i, home[j]) in at}
    for i in range(len(points)):
        for j in range(i):
            if int(points[i] ^ points[j]).bit_count() <= 4:
                assert (i, j) in meet or (j, i) in meet


def test_a_group_of_copies_gives_a_spanning_tree():
    cloud = np.array([0x0F0F << 8 ^ 1 << b for b in range(8)] * 200, dtype=np.uint64)
    assert len(S.spanning_links(cloud, np.zeros(len(cloud), bool), 4)) == len(cloud) - 1
    # Visitors are compared with points at home only.
    assert S.spanning_links(cloud, np.ones(len(cloud), bool), 4) == []
