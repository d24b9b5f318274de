import hashlib
import re

import pyarrow as pa
import pytest

from meibo.llm import fill_middle as M


def plain(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ROWS = [(i, f"Some words, number {i}.\n<tag{i}> größer 漢字 \U0001f600 end") for i in range(150)]
ROWS += [(200, None), (201, ""), (202, "has <P> in it"), (203, "<S"), (204, ">"), (205, "<M><"), (206, "a"), (None, "x y z")]
ROWS += [(207, "Word " * 4000), (208, "漢" * 3000), (209, "\x00\x01﻿\xff"), (210, "<<>S>P><P"), (3, "again"), (3, "again"), (211, "y" * 5000)]


@pytest.mark.parametrize("group", [1, 4000, 2 << 20])
def test_matches_the_definition(documents, monkeypatch, group):
    monkeypatch.setattr(M, "GROUP_BYTES", group)
    got = M.fill_in_middle(documents(ROWS))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain(*r) for r in ROWS), key=repr)


def test_all_forms_occur_and_are_undone(documents):
    done = M.fill_in_middle(documents(ROWS))
    assert {r["form"] for r in done.collect()} == {"plain", "psm", "spm"}
    back = M.restore(done).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((d, t or "") for d, t in ROWS), key=repr)


def test_rates(documents):
    assert {r["form"] for r in M.fill_in_middle(documents(ROWS), rate=0).collect()} == {"plain"}
    forms = {r["form"] for r in M.fill_in_middle(documents(ROWS[:150]), rate=100, spm_rate=100).collect()}
    assert forms == {"spm"}


def test_text_ids_and_no_rows(documents, spark):
    docs = spark.createDataFrame([("k1", "one two"), ("k2", None)], "key string, output string")
    got = M.fill_in_middle(docs, "key", "output").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain("k1", "one two"), plain("k2", None)), key=repr)
    assert M.restore(M.fill_in_middle(documents([]))).collect() == []


def test_units_are_lists_of_whole_characters():
    texts = ["ab1 Çd", "", "\U0001f600x"]
    lists = M.units(pa.array([t.encode() for t in texts], pa.large_binary())).to_pylist()
    assert [[u.decode() for u in x] for x in lists] == [re.findall("[A-Za-z]+|[^A-Za-z]", t) for t in texts]
