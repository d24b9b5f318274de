import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meibo.llm import language as L

LANGS = {"aa": ["sha", "the", "ing", "ond"], "bb": ["lich", "und", "keit", "ver"], "cc": ["eau", "oir", "que", "les"]}


def line(pick, lang, n=12):
    return " ".join("".join(pick.choice(LANGS[lang]) for _ in range(pick.randrange(1, 4))) for _ in range(n))


@pytest.fixture
def rows():
    pick = random.Random(4)
    return [(i, line(pick, lang), lang) for i in range(300) for lang in [sorted(LANGS)[i % 3]]]


def test_held_out_accuracy(rows, documents):
    docs = documents([*rows, (None, "lost", "aa"), (500, None, "bb"), (501, "no lang", None)])
    got = {r["doc_id"]: r for r in L.predict(docs, L.model_for(docs)).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i]["held_out"] and i is not None and i < 300} == set(held)
    names = {i: lang for i, _, lang in rows}
    assert np.mean([got[i]["lang_pred"] == names[i] for i in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {c for _, _, c in rows} >= {r["lang_pred"] for r in got.values()} - {"und"}


def test_edges(rows, documents):
    model = L.model_for(documents(rows))
    odd = [(1, None), (2, ""), (3, "12 34 ."), (4, "the"), (4, "the"), (None, "lich und"), (5, "eau oir " * 60_000), (6, "漢字")]
    got = L.predict(documents(odd), model).collect()
    assert len(got) == len(odd)
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (1, 2, 3))
    assert by[4]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb" and by[5]["lang_pred"] == "cc"
    assert by[6]["rejected"] and by[6]["lang_pred"] in LANGS and not by[5]["rejected"]
    assert not L.predict(documents([]), model).collect()


def test_nothing_to_learn_from(documents):
    model = L.model_for(documents([(1, "text", None), (None, "text", "aa")]))
    assert [(r["lang_pred"], r["score"]) for r in L.predict(documents([(1, "text")]), model).collect()] == [("und", 0.0)]


def test_the_sample_is_bounded(rows, documents, monkeypatch):
    """However many rows there are, and however often an id is repeated."""
    seen = []
    real = L._cluster
    monkeypatch.setattr(L, "_cluster", lambda vectors, k: seen.append(len(vectors)) or real(vectors, k))
    many = [(i, t, lang) for i, t, lang in rows if lang == "aa"] * 5 + [(7777, f"the sha {i}", "bb") for i in range(400)]
    docs = documents(many).select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    model = L.fit(docs, sample=20)
    assert seen == [20, 1] and set(model.langs) == {"aa", "bb"}


def brute_model(docs):
    """Weights by plain counting, and the cosine of every text with every centroid of ``model``."""
    counts = [L.ngram_counts(t) for _, t, _ in docs]
    held = sum((c > 0).astype(int) for c in counts)
    return np.log((len(docs) + 1.0) / (held + 1.0)) + 1.0


def test_weights_and_nearest_centroid_match_brute_force(rows, documents):
    learned = [(i, t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = documents(rows)
    model = L.model_for(docs)
    assert np.allclose(model.idf, brute_model(learned), atol=1e-5)
    got = {r["doc_id"]: r for r in L.predict(docs, model).collect()}
    for i, text, _ in rows:
        weighed = L.ngram_counts(text) * model.idf.astype(float)
        cosines = weighed / np.sqrt((weighed**2).sum()) @ model.centroids.astype(float)
        best = int(cosines.argmax())
        assert got[i]["lang_pred"] == model.langs[best] and abs(got[i]["score"] - cosines[best]) < 1e-4
        assert got[i]["rejected"] == (cosines[best] < model.radius[best]) or abs(cosines[best] - model.radius[best]) < 1e-5


def test_several_centroids_for_a_language(rows, documents):
    model = L.model_for(documents(rows))
    assert all(model.langs.count(x) > 1 for x in LANGS) and np.allclose(np.linalg.norm(model.centroids, axis=0), 1, atol=1e-3)


def test_counts_do_not_depend_on_pieces(monkeypatch):
    from meibo.llm import words

    text = "Ab1cd éa, b漢" * 40 + "long" * 30
    whole = L.ngram_counts(text)
    monkeypatch.setattr(words, "PIECE", 32)
    assert (L.ngram_counts(text) == whole).all() and whole.sum() > 0
