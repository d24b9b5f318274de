"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with a logistic probability of its words,
beginnings of words and word pairs; the document is toxic unless no sentence is (noisy-or). Only documents are labelled:
the gradient of the document's loss is what its sentences learn from. The same sentence
probabilities then locate the offending sentences.

The model is fitted to a bounded sample of labelled documents, at most ``SAMPLE`` for each label,
chosen by a hash of the id over all labelled rows. Its features are counted on Spark, the weights
are found on the driver from sentences reduced to those features. Scoring is one map over the
documents.

A null or empty text, or one without words, scores 0. A document without id is scored but never
learned from. Of several labels of one document the largest counts; null labels count as none.
Without labels of both kinds every score is 0. Rows are scored one by one, so repeated rows score
alike, and other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.llm.words import code_points, grams, words

#: Labelled documents of each label that a model is fitted to, at most.
SAMPLE = 4000
#: Beginnings of words that are features beside the words, in characters.
PREFIXES = (4, 5, 6)
#: Words, beginnings and word pairs with a weight.
FEATURES = 4096
#: Documents of the sample that a feature must occur in.
MIN_DOCS = 5
THRESHOLD = 0.7
OFFENDING = 0.5
SCORED = "score double, offending array<struct<start: int, end: int, score: double>>"

_ENDS = np.array([ord(c) for c in ".!?\n。！？"], dtype=np.uint32)


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the bias of a sentence."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def sentence_features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes and the sentence each is in, then start and end of every sentence with words.

    A sentence ends at an end mark or line break. A word pair belongs to the sentence of its
    second word and does not cross sentences.
    """
    hashes, starts, ends, *heads = words(text, PREFIXES)
    if not len(hashes):
        empty = np.zeros(0, np.int64)
        return hashes, empty, empty, empty
    marks = np.flatnonzero(np.isin(code_points(text), _ENDS))
    part = np.searchsorted(marks, starts)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    sentence = np.cumsum(np.concatenate(([0], (part[1:] != part[:-1]).astype(np.int64))))
    last = np.concatenate((first[1:], [len(hashes)])) - 1
    pairs = grams(hashes, 2)
    same = sentence[1:] == sentence[:-1]
    found, inside = [hashes, pairs[same]], [sentence, sentence[1:][same]]
    for head in heads:
        found.append(head[head != 0])
        inside.append(sentence[head != 0])
    return np.concatenate(found), np.concatenate(inside), starts[first], ends[last]


def _lookup(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash among the features, or -1."""
    if not len(model.features):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(model.features, hashes), len(model.features) - 1)
    return np.where(model.features[at] == hashes, at, -1)


def score_text(model: Model, text: str | None) -> tuple[float, list]:
    """Noisy-or of the sentences, and the offending sentences (code points, end exclusive)."""
    hashes, sentence, starts, ends = sentence_features(text)
    if not len(starts) or not len(model.features):
        return 0.0, []
    at = _lookup(model, hashes)
    hit = at >= 0
    # A feature counts once in a sentence.
    once = np.unique(sentence[hit] * len(model.features) + at[hit])
    logit = model.bias + np.bincount(
        once // len(model.features), model.weights[once % len(model.features)], minlength=len(starts)
    )
    score = -np.expm1(-np.logaddexp(0.0, logit).sum())
    chance = 1.0 / (1.0 + np.exp(-logit))
    bad = [(int(starts[i]), int(ends[i]), float(chance[i])) for i in np.flatnonzero(chance >= OFFENDING)]
    return float(min(max(score, 0.0), 1.0)), bad


def scorer(model: Model):
    """The model as a function of a text column."""

    @F.pandas_udf(SCORED)
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([score_text(model, t) for t in texts], columns=["score", "offending"])

    return score


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(id, text, label) of at most ``size`` labelled documents of each label, spread by a hash of the id."""
    known = labels.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    picked = None
    for label in (0, 1):
        ids = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(size)
        picked = ids if picked is None else picked.unionAll(ids)
    return docs.join(F.broadcast(picked), "id")


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Fit to ``docs`` (id, text) and ``labels`` (id, label 0 or 1)."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                found = np.unique(sentence_features(text)[0]).view(np.int64)
                yield pd.DataFrame({"feature": found, "label": label})

    sample = _sample(docs, labels, size)
    counts = (
        sample.mapInPandas(features, "feature long, label int")
        .groupBy("feature")
        .agg(F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic"))
        .where(F.col("clean") + F.col("toxic") >= MIN_DOCS)
    )
    sides = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sides) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    gain = F.abs(F.log((F.col("toxic") + 0.5) / (sides[1] + 1)) - F.log((F.col("clean") + 0.5) / (sides[0] + 1)))
    weighed = gain * F.sqrt(F.col("toxic") / sides[1] + F.col("clean") / sides[0])
    top = counts.orderBy(weighed.desc(), "feature").limit(FEATURES).select("feature").collect()
    model = Model(np.sort(np.array([r[0] for r in top], dtype=np.int64).view(np.uint64)), np.zeros(len(top)), 0.0)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, label in zip(batch["text"], batch["label"], strict=True):
                hashes, sentence, starts, _ = sentence_features(text)
                at = _lookup(model, hashes)
                hit = at >= 0
                once = np.unique(sentence[hit] * max(1, len(model.features)) + at[hit])
                used = once // max(1, len(model.features))
                # Sentences are numbered anew: those without features only count.
                names, new = np.unique(used, return_inverse=True)
                rows.append((label, len(starts) - len(names), new.tolist(), (once % max(1, len(model.features))).tolist()))
            yield pd.DataFrame(rows, columns=["label", "plain", "sentence", "feature"])

    bags = sample.mapInPandas(reduced, "label int, plain long, sentence array<int>, feature array<int>").collect()
    return _descend(model, bags)


def _descend(model: Model, bags: list, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Adam on the mean log loss of the noisy-or, both labels weighing the same."""
    label = np.array([b["label"] for b in bags], dtype=float)
    plain = np.array([b["plain"] for b in bags], dtype=float)
    order = sorted(range(len(bags)), key=lambda i: tuple(bags[i]))  # rows arrive in any order
    label, plain, bags = label[order], plain[order], [bags[i] for i in order]
    sizes = np.array([max(b["sentence"], default=-1) + 1 for b in bags])
    base = np.concatenate(([0], np.cumsum(sizes)))
    bag = np.repeat(np.arange(len(bags)), sizes)
    row = np.concatenate([np.array(b["sentence"], dtype=np.int64) + base[i] for i, b in enumerate(bags)])
    col = np.concatenate([np.array(b["feature"], dtype=np.int64) for b in bags])
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    state = np.zeros(len(model.features) + 1)
    state[-1] = -6.0
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        w, bias = state[:-1], state[-1]
        logit = bias + np.bincount(row, w[col], minlength=base[-1])
        alone = np.logaddexp(0.0, bias)
        total = np.bincount(bag, np.logaddexp(0.0, logit), minlength=len(bags)) + plain * alone
        total = np.maximum(total, 1e-12)
        slope = weight * np.where(label == 1, -1.0 / np.expm1(np.minimum(total, 500.0)), 1.0)
        chance = 1.0 / (1.0 + np.exp(-logit))
        each = slope[bag] * chance
        grad = np.empty_like(state)
        grad[:-1] = np.bincount(col, each[row], minlength=len(w)) + decay * w
        grad[-1] = each.sum() + (slope * plain).sum() / (1.0 + np.exp(-bias))
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        state -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(model.features, state[:-1], float(state[-1]))


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def model_for(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the documents that are not held out."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marks = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
    return fit(rows, marks.where(~held_out(F.col("id"))))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``, ``offending``."""
    scored = docs.select(F.col(f"`{id_col}`").alias("id"), scorer(model)(F.col(f"`{text_col}`")).alias("got"))
    return scored.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "got.score",
        (F.col("got.score") >= THRESHOLD).cast("int").alias("predicted"),
        "got.offending",
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents predicted toxic."""
    return docs.where(scorer(model)(F.col(f"`{text_col}`"))["score"] < THRESHOLD)
