import random

from meibo.llm.components import components


def brute(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for node in sorted(near):
        if node not in out:
            todo = [node]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = node
                    todo += near[x]
    return out


def star(hub, n):
    return [(hub, i) for i in range(hub + 1, hub + n)]


CASES = {
    "path": [(i, i + 1) for i in range(300)],
    "path downward": [(i + 1, i) for i in range(300)],
    "star and its copy": star(0, 400) + [(b, a) for a, b in star(0, 400)],
    "stars in a row": [e for h in range(0, 2000, 100) for e in star(h, 100)] + [(h, h + 199) for h in range(0, 1900, 100)],
    "loops, nulls and repeats": [(1, 1), (2, None), (None, 3), (4, 5), (5, 4), (4, 5), (7, 7)],
    "random": [(random.Random(i).randrange(900), random.Random(-i - 1).randrange(900)) for i in range(700)],
}


def test_matches_brute_force(spark):
    # Far enough apart to stay graphs of their own in one table.
    edges = [tuple(None if x is None else x + 10_000 * i for x in e) for i, case in enumerate(CASES.values()) for e in case]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(dict(got)) and dict(got) == brute(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(1, None)], "a long, b long")).collect() == []


def test_hub_that_no_table_is_broadcast_for(spark, monkeypatch):
    from meibo.llm import components as C
    from meibo.operators import lookup

    monkeypatch.setattr(C, "lookup_join", lambda *a, **k: lookup.lookup_join(*a, **k | {"max_bytes": 0}))
    edges = star(0, 300) + [(500, 501)]
    assert dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) == brute(edges)
