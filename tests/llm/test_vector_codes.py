import hashlib
import math
import random

import numpy as np
import pytest

from meibo.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id string, vector string, error int"


def brute(rows, parts=16, n=64, rounds=2):
    """All in plain Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:n]] for p in range(parts)]

    def codes():
        out = []
        for c in cut:
            far = [[sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)) for e in books[p]] for p in range(parts)]
            out.append([(min(d), d.index(min(d))) for d in far])
        return out

    for _ in range(rounds):
        got = codes()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, got, strict=True) if g[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    done = [(i, "".join(f"{e:02x}" for _, e in g), sum(d for d, _ in g), label) for (i, _, label), g in zip(kept, codes(), strict=True)]
    sums = {}
    for _, _, error, label in done:
        sums[label] = sums.get(label, 0) + error
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in done), key=repr)


def coded(spark, rows):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(*r, "c", "i", "v", 1) for r in rows], SCHEMA)
    books = V.fit(table)
    done = V.with_label_error(V.encode(table, books))
    digest = books.sha256() if books else None
    return sorted((tuple(r) + (digest,) for r in done.select("vec_id", F.lower(F.hex("code")), "error", "label_error").collect()), key=repr)


def vectors(n, seed=0, width=32, scale=1.0):
    pick = random.Random(seed)
    return [float(np.float32(pick.gauss(0, scale))) for _ in range(n * width)]


def rows_of(n, seed=0, width=32, scale=1.0):
    flat = vectors(n, seed, width, scale)
    pick = random.Random(seed)
    return [(i, flat[i * width : (i + 1) * width], pick.choice([None, 1, 2, 2, 2])) for i in range(n)]


def test_matches_brute_force(spark):
    rows = rows_of(150)
    random.Random(5).shuffle(rows)
    odd = [float("nan")] + [0.0] * 31, [None] + [0.0] * 31, [float("inf")] * 32, [-float("inf")] + [0.0] * 31, None
    rows += [(900 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(3, rows[0][1], 1), (3, rows[1][1], None), (None, rows[2][1], 2), rows[4], rows[4]]  # repeated ids and rows, a null id
    assert coded(spark, rows) == brute(rows)


def test_ties_go_to_the_first_entry(spark):
    rows = [(i, [float(i % 3)] * 16, 1) for i in range(80)]
    assert coded(spark, rows) == brute(rows)


def test_few_or_no_vectors(spark):
    rows = rows_of(5)
    assert coded(spark, rows) == brute(rows)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 2)]) == []


def test_large_components_stay_exact(spark):
    rows = rows_of(70, 3, 16, 200_000.0)
    assert coded(spark, rows) == brute(rows)


def test_faults_name_the_vector(spark):
    from pyspark.errors import PythonException

    good = rows_of(70)
    for bad in ([0.5] * 16, [1e30] + [0.0] * 31, []):
        with pytest.raises((PythonException, ValueError), match="vector 777"):
            coded(spark, [*good, (777, bad, 1)])
    with pytest.raises(ValueError, match="cannot be cut"):
        coded(spark, [(1, [1.0] * 17, 1)])


@pytest.mark.parametrize("top", [1, 1 << 20, 1 << 28])
@pytest.mark.parametrize("length", [1, 4, 33])
def test_products_of_limbs_are_exact(top, length):
    random_ = np.random.default_rng(length)
    x, y = (random_.integers(-top, top, (30, length), dtype=np.int64, endpoint=True) for _ in range(2))
    x[0], y[0], y[1] = top, -top, top
    assert (V.exact_product(x, y) == x @ y.T).all()
    bits = V.limb_bits(length)
    for part in V.limbs(x, bits):
        assert abs(part).max() <= 1 << bits and length * (1 << 2 * bits) <= V.EXACT
    assert (sum((p.astype(np.int64) << (bits * k)) for k, p in enumerate(V.limbs(x, bits))) == x).all()


def test_decode_gives_the_entries(spark):
    rows = rows_of(100)
    table = spark.createDataFrame([(*r, "c", "i", "v", 1) for r in rows], SCHEMA)
    books = V.fit(table)
    done = V.encode(table, books).orderBy("vec_id").collect()
    codes = np.array([list(r["code"]) for r in done])
    whole = np.floor(256 * np.array([r[1] for r in rows]))
    error = ((whole - 256 * V.decode(books, codes)) ** 2).sum(axis=1)
    assert error.astype(int).tolist() == [r["error"] for r in done]
