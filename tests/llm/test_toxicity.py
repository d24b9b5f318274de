import random
import zlib

import pytest

from meibo.llm import toxicity as T

BAD = ["scoundrel", "filth", "vermin"]
GOOD = [f"word{i}" for i in range(200)]


def corpus(n=400):
    pick, rows, labels = random.Random(1), [], []
    for i in range(n):
        toxic = i % 4 == 0
        sentences = [[pick.choice(GOOD) for _ in range(8)] for _ in range(5)]
        if toxic:
            pick.choice(sentences)[3] = pick.choice(BAD)
        rows.append((i, " ".join(" ".join(s).capitalize() + "." for s in sentences)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture
def fitted(spark, documents):
    rows, labels = corpus()
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    return rows, dict(labels), T.model_for(documents([*rows, (None, "lost"), (7, None)]), marks)


def test_held_out_documents_are_told_apart(fitted, documents):
    rows, labels, model = fitted
    got = {r["doc_id"]: r for r in T.score_documents(documents(rows), model).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    assert sum(got[i]["predicted"] == labels[i] for i in held) >= 0.97 * len(held)


def test_offending_sentences_are_located(fitted):
    _, _, model = fitted
    text = "Word1 word2 word3. Word4 FILTH word5! Word6 word7."
    score, bad = T.score_text(model, text)
    assert score >= T.THRESHOLD and [text[a:b] for a, b, _ in bad] == ["Word4 FILTH word5"]


def test_noisy_or_of_sentences(fitted):
    _, _, model = fitted
    clean, one, two = (T.score_text(model, t)[0] for t in ("Word1 word2.", "Filth word1.", "Filth word1. Vermin word2."))
    assert clean < one < two and two == pytest.approx(1 - (1 - one) * (1 - T.score_text(model, "Vermin word2.")[0]))


def test_edges(fitted, documents):
    _, _, model = fitted
    rows = [(1, None), (2, ""), (3, " .!? "), (None, "filth"), (4, "filth"), (4, "filth"), (5, "word1 " * 100_000)]
    got = T.score_documents(documents(rows), model).collect()
    assert len(got) == len(rows) and all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    docs = documents(rows)
    assert T.drop_toxic(docs, model).columns == docs.columns
    assert {r["doc_id"] for r in T.drop_toxic(docs, model).collect()} == {1, 2, 3, 5}
    assert not T.score_documents(documents([]), model).collect()


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, None)]])
def test_without_labels_of_both_kinds_all_score_zero(spark, documents, labels):
    docs = documents([(1, "filth"), (2, "word")])
    model = T.model_for(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r["score"] for r in T.score_documents(docs, model).collect()] == [0.0, 0.0]
