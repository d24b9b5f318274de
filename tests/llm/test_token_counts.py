import base64
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from meibo.llm import token_counts as C
from meibo.operators.staging import new_path

CHANGE = "op string, doc_id long, source string, lang string, version string, tokens long, old int"


@pytest.fixture
def rollup(spark):
    return C.TokenRollup(spark, new_path(spark, "rollup-test"))


def changes(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], CHANGE)


def groups(rollup):
    return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().where("level = 0").collect()}


def test_inserts_revisions_and_deletes(spark, rollup):
    first = [("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", "en", "v1", 5), ("insert", 3, None, None, "v1", 7), ("insert", 1, "a", "en", "v2", 11)]
    assert rollup.commit("1", changes(spark, first))
    assert groups(rollup) == {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 7), ("a", "en", "v2"): (1, 11)}
    second = [("revise", 1, "b", "en", "v1", 12), ("delete", 2, None, None, "v1", None), ("delete", 99, None, None, "v1", None), ("insert", 3, None, None, "v1", 8)]
    assert rollup.commit("2", changes(spark, second))
    assert groups(rollup) == {("b", "en", "v1"): (1, 12), (None, None, "v1"): (1, 8), ("a", "en", "v2"): (1, 11)}
    assert not rollup.commit("1", changes(spark, first)) and not rollup.commit("2", changes(spark, first))
    assert groups(rollup) == {("b", "en", "v1"): (1, 12), (None, None, "v1"): (1, 8), ("a", "en", "v2"): (1, 11)}


def test_a_batch_that_broke_off_is_written_anew(spark, rollup):
    rollup.commit("1", changes(spark, [("insert", 1, "a", "en", "v", 10)]))
    changes(spark, [("insert", 8, "a", "en", "v", 99)]).selectExpr("doc_id", "version", "source", "lang", "1L as docs", "tokens").write.parquet(rollup._path("records", "2"))
    assert rollup.committed() == ["1"] and groups(rollup) == {("a", "en", "v"): (1, 10)}
    assert rollup.commit("2", changes(spark, [("insert", 2, "a", "en", "v", 1)]))
    assert groups(rollup) == {("a", "en", "v"): (2, 11)}


def test_odd_changes(spark, rollup):
    assert rollup.totals().where("level = 0").count() == 0
    rows = [("insert", None, "a", "en", "v", 10), ("insert", 1, "a", "en", "v", 3), ("delete", 1, None, None, "v", None), ("insert", 1, "a", "en", "v", 9), ("insert", 1, "a", "en", "v", 9), ("insert", 2, "a", "en", "v", None)]
    rollup.commit("1", changes(spark, rows))
    assert groups(rollup) == {("a", "en", "v"): (2, 9)}
    assert rollup.commit("empty", changes(spark, [])) and groups(rollup) == {("a", "en", "v"): (2, 9)}
    rollup.commit("2", changes(spark, [("delete", 1, None, None, "v", None), ("delete", 2, None, None, "v", None)]))
    assert groups(rollup) == {}


def test_subtotals(spark, rollup):
    rollup.commit("1", changes(spark, [("insert", i, "ab"[i % 2], "en", "v", i) for i in range(10)]))
    rows = rollup.totals().collect()
    assert Counter(r["level"] for r in rows) == {0: 2, 1: 2, 3: 2, 7: 1}
    assert [(r["n_docs"], r["n_tokens"]) for r in rows if r["level"] == 7] == [(10, 45)]


def test_counts_are_the_librarys(spark, documents):
    with open(public_tokenizers.path(C.TOKENIZER), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "some text é漢 <|endoftext|>"), (2, ""), (3, None), (4, "long text " * 20_000), (4, "long text " * 20_000)]
    got = Counter(map(tuple, documents(rows).select("doc_id", C.token_count(F.col("text"))).collect()))
    assert got == Counter((d, len(plain.encode_ordinary(t or ""))) for d, t in rows)


def test_query_counts_the_documents_that_dedup_keeps(spark):
    from meibo.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "text", C.token_count(F.col("text"))).collect()
    kept = {}
    for r in docs:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        kept[key] = max(kept.get(key, r), r, key=lambda x: x["doc_id"])
    want = Counter()
    for r in kept.values():
        want[r["source"], r["lang"], "n"] += 1
        want[r["source"], r["lang"], "tokens"] += r[4]
    got = Counter()
    for r in QUERIES["op8_token_counts"](spark, sf).where("level = 0").collect():
        got[r["source"], r["lang"], "n"], got[r["source"], r["lang"], "tokens"] = r["n_docs"], r["n_tokens"]
    assert got == want


def test_rows_of_one_id_are_told_apart(spark, rollup):
    rows = [("insert", None, "a", "en", "v", 10, "x"), ("insert", None, "a", "en", "v", 4, "y"), ("insert", 1, "a", "en", "v", 3, "x"), ("insert", 1, "a", "en", "v", 3, "x"), ("insert", 1, "b", "en", "v", 5, "y")]
    schema = "op string, doc_id long, source string, lang string, version string, tokens long, `row of` string"
    rollup.commit("1", spark.createDataFrame(rows, schema), "row of")
    assert groups(rollup) == {("a", "en", "v"): (4, 20), ("b", "en", "v"): (1, 5)}
    gone = [("delete", None, None, None, "v", None, "x"), ("delete", 1, None, None, "v", None, "x"), ("delete", 1, None, None, "v", None, "z")]
    rollup.commit("2", spark.createDataFrame(gone, schema), "row of")
    assert groups(rollup) == {("a", "en", "v"): (2, 7), ("b", "en", "v"): (1, 5)}
    rollup.commit("3", spark.createDataFrame([gone[1], ("delete", 1, None, None, "v", None, "y"), rows[0]], schema), "row of")
    assert groups(rollup) == {("a", "en", "v"): (2, 14)}


def test_query_counts_what_dedup_keeps_of_repeated_and_null_ids(spark, documents, tmp_path):
    from meibo.llm.queries import QUERIES

    # (1, p) twice and a row of its own under id 1; 2 is a copy of 3 and has another text too; null ids repeat.
    rows = [(1, "one two"), (1, "one two"), (1, "other words here"), (2, "same text"), (3, "Same text"), (2, "third of two"), (None, "no id at all"), (None, "no id at all"), (None, "lone"), (None, "one two"), (4, None), (4, "")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    kept = ["one two", "other words here", "Same text", "third of two", "no id at all", "lone", ""]
    with open(public_tokenizers.path(C.TOKENIZER), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    (total,) = QUERIES["op8_token_counts"](spark, str(tmp_path)).where("level = 7").collect()
    assert (total["n_docs"], total["n_tokens"]) == (len(kept), sum(len(plain.encode_ordinary(t)) for t in kept))
