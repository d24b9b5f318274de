"""Language of a text by the nearest centroid.

A text becomes a vector of its letter n-grams (one to three letters, with the ends of words),
hashed into ``BUCKETS`` places, weighted by TF-IDF and normalised. Each language has several
centroids, found by spherical k-means. The language of the most similar centroid wins; a text
farther from it than nearly all texts it was made from is marked as rejected.

Document frequencies are counted over all labelled rows. The centroids are fitted on a sample of at
most ``SAMPLE`` documents of each language, the first in the order of a hash of the id; a repeated id is
one document, its smallest text. The driver holds that sample's counts, one language's vectors at a
time and a few centroids for each.

A text that is null or has no letter is ``und`` with score 0, as is every text when nothing can be
learned. Rows without language or id teach nothing. Between equally similar centroids the language
first in order wins. Repeated rows get equal results; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meibo.llm.words import _tables, code_points, pieces

BUCKETS = 1 << 14
#: Documents of each language that centroids are fitted on at most, and how many times as many may be
#: looked at to find them.
SAMPLE = 1000
SPARE = 4
CENTROIDS = 4
#: Share of a centroid's own sample that may lie outside its radius, and the slack beyond it.
OUTSIDE = 0.005
SLACK = 0.8
UNKNOWN = "und"
PREDICTED = "lang_pred string, score double, rejected boolean"


@dataclass
class Model:
    """Weights of the buckets, centroids as columns, and of each its language and smallest cosine."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    radius: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def ngram_counts(text: str | None) -> np.ndarray:
    """How often each bucket occurs; n-grams lie within a word and its two ends."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    _, lower = _tables()
    for _, piece in pieces(text or ""):
        codes = code_points(piece)
        kept = np.zeros(len(codes) + 2, dtype=np.uint32)
        kept[1:-1] = np.where(_letters()[codes], lower[codes], 0)
        c = kept[1:][(kept[1:] > 0) | (kept[:-1] > 0)]
        if not len(c):
            continue
        c = np.concatenate((np.zeros(1, np.uint32), c))
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = (two[:-1] * np.uint32(0x85EBCA77) + c[2:])[c[1:-1] > 0]
        for size, part in enumerate((c[c > 0], two, three)):
            spread = (part ^ (part >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(size * 0x297A2D39)
            spread = (spread ^ (spread >> np.uint32(13))) * np.uint32(0xC2B2AE3D)
            total += np.bincount(spread >> np.uint32(18), minlength=BUCKETS)
    return total


def predict_text(model: Model, text: str | None) -> tuple[str, float, bool]:
    counts = ngram_counts(text)
    used = np.flatnonzero(counts)
    if not len(used) or not model.langs:
        return UNKNOWN, 0.0, True
    vector = counts[used] * model.idf[used]
    near = (vector / np.linalg.norm(vector)) @ model.centroids[used]
    best = int(near.argmax())
    return model.langs[best], float(min(max(near[best], 0.0), 1.0)), bool(near[best] < model.radius[best])


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of a task that hold each bucket; bucket -1 counts the documents."""
    total, rows = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        rows += len(batch)
        for text in batch["text"]:
            total += ngram_counts(text) > 0
    used = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": np.append(used, -1), "docs": np.append(total[used], rows)})


def _sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, lang, text in zip(batch["id"], batch["lang"], batch["text"], strict=True):
            counts = ngram_counts(text)
            used = np.flatnonzero(counts)
            if len(used):
                rows.append((doc, lang, used.astype(np.int32).tobytes(), counts[used].astype(np.int32).tobytes()))
        yield pd.DataFrame(rows, columns=["id", "lang", "used", "counts"])


def _cluster(vectors: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out first centroids: centroids and each row's nearest."""
    chosen = [0]
    far = vectors @ vectors[0]
    for _ in range(1, min(k, len(vectors))):
        chosen.append(int(far.argmin()))
        far = np.maximum(far, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[own == c].sum(axis=0) for c in range(len(centroids))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-12), centroids)
    return centroids, (vectors @ centroids.T).argmax(axis=1)


def fit(docs: DataFrame, sample: int = SAMPLE, clusters: int = CENTROIDS) -> Model:
    """Fit to ``docs`` (id, text, lang), the rows that may be learned from."""
    known = docs.where("id is not null and lang is not null and text is not null")
    counted = {r["bucket"]: r["n"] for r in known.mapInPandas(_frequencies, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("n")).collect()}
    total = counted.pop(-1, 0)
    idf = np.full(BUCKETS, np.log(total + 1.0) + 1.0, dtype=np.float32)
    for bucket, n in counted.items():
        idf[bucket] = np.log((total + 1.0) / (n + 1.0)) + 1.0
    # Ids, not rows: one id may hold a third of the rows.
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("id").alias("n"))
    # Ids whose hash lies in the share of the language that holds some more than the sample.
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 62)) / F.lit(float(1 << 62))
    # One row for each language, of which the model holds whole vectors.
    near = known.join(F.broadcast(sizes), "lang").where(at * F.col("n") < SPARE * sample)
    once = near.groupBy("lang", "id").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    rows = sorted(picked.mapInPandas(_sparse, "id string, lang string, used binary, counts binary").collect())
    centroids, langs, radius = [], [], []
    for lang in sorted({r["lang"] for r in rows}):
        mine = [r for r in rows if r["lang"] == lang]
        vectors = np.zeros((len(mine), BUCKETS), dtype=np.float32)
        for i, r in enumerate(mine):
            used = np.frombuffer(r["used"], np.int32)
            vectors[i, used] = np.frombuffer(r["counts"], np.int32) * idf[used]
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        found, own = _cluster(vectors, clusters)
        near = (vectors * found[own]).sum(axis=1)
        for c in range(len(found)):
            if (own == c).any():
                centroids.append(found[c])
                langs.append(lang)
                radius.append(SLACK * np.quantile(near[own == c], OUTSIDE))
    matrix = np.stack(centroids, axis=1) if centroids else np.zeros((BUCKETS, 0), np.float32)
    return Model(idf, matrix.astype(np.float32), langs, np.array(radius))


def model_for(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the documents that are not held out."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")
    )
    return fit(rows.where(~held_out(F.col("id"))))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``lang_pred``, ``score`` (cosine), ``rejected``.

    ``lang_pred`` of a rejected text is still the nearest language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict_text(sent.value, t) for t in texts], columns=["lang_pred", "score", "rejected"])

    got = F.pandas_udf(apply, PREDICTED)(F.col(f"`{text_col}`")).alias("got")
    return docs.select(F.col(f"`{id_col}`"), held_out(F.col(f"`{id_col}`")).alias("held_out"), got).select(
        F.col(f"`{id_col}`"), "held_out", "got.*"
    )
