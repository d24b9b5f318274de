"""Product-quantisation codes of vectors, exact to the last integer.

A component x becomes the integer floor(256 x). A vector is cut into ``PARTS`` equal parts, and each
part position has a codebook of ``ENTRIES`` entries, which starts as that part of the vectors with the
smallest ids. Every round assigns each part to the nearest entry of its codebook and moves the entries to
the mean, rounded down, of what they got.

Distances come from matrix products. Integers are broken into limbs so narrow that a product of two limb
matrices stays below 2^53 and is exact in float64 BLAS; the products are recombined in int64, and the
first smallest distance wins. Each task returns integer sums for each entry, so results depend neither on
the order of rows nor on how they lie in tasks. Codebooks, ``PARTS * ENTRIES`` short rows, are all
that reaches the driver.

A vector that is null, or has a null or non-finite component, is dropped; all others must have one length,
a multiple of ``PARTS``, and components within the bound that keeps sums of squares in int64 (about
400,000 for 64 components), or the job stops and names the vector. With fewer vectors than entries the
codebooks are shorter. Of rows with one id the smaller vector comes first; null ids come last.
Repeated rows are coded each. Labels may be null, nulls counting as one label. An empty table gives an
empty result. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.operators.lookup import lookup_join
from meibo.operators.staging import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Float64 holds every integer below this.
EXACT = 1 << 53
#: Vectors multiplied at once.
BLOCK = 4096


@dataclass
class Codebooks:
    """Entries as (part, entry, component) integers, and the bound of a component."""

    entries: np.ndarray
    bound: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def component_bound(width: int) -> int:
    """The largest component for which the squared distance of two vectors stays within int64."""
    return int(np.sqrt((1 << 62) / max(width, 1))) // 2 - 1


# ---- exact products ------------------------------------------------------------------------


def limb_bits(length: int) -> int:
    """The widest limbs whose products, summed over ``length`` components, stay below 2^53."""
    bits = (53 - max(length - 1, 0).bit_length()) // 2
    if bits < 2:
        raise ValueError(f"vectors of {length} components are too long")
    return bits


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 matrices whose sum, the k-th times 2^(bits k), is the integer matrix ``x``.

    All limbs but the last lie in [0, 2^bits); the last keeps the sign.
    """
    parts, rest = [], x
    while rest.size and (rest.min() < -(1 << bits) or rest.max() >= 1 << bits):
        parts.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*parts, rest.astype(np.float64)]


def exact_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y.T`` of int64 matrices, exact as long as the results fit int64."""
    bits = limb_bits(x.shape[1])
    right = limbs(y, bits)
    total = np.zeros((len(x), len(y)), dtype=np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            total += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest row of ``entries`` for each row of ``x``, and the squared distance."""
    distance = (entries * entries).sum(axis=1)[None, :] - 2 * exact_product(x, entries)
    code = distance.argmin(axis=1)
    return code, distance[np.arange(len(x)), code] + (x * x).sum(axis=1)


def assign(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vector, part) and the squared distances summed over the parts."""
    parts, _, size = entries.shape
    codes = np.empty((len(vectors), parts), dtype=np.uint8)
    error = np.zeros(len(vectors), dtype=np.int64)
    for start in range(0, len(vectors), BLOCK):
        block = vectors[start : start + BLOCK].reshape(-1, parts, size)
        for part in range(parts):
            code, distance = nearest(np.ascontiguousarray(block[:, part]), entries[part])
            codes[start : start + BLOCK, part] = code
            error[start : start + BLOCK] += distance
    return codes, error


# ---- rows ----------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Whether every component is a finite number."""
    infinite = float("inf")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | x.cast("double").isin(infinite, -infinite))
    return vector.isNotNull() & ~bad


def _rows(docs: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    vector = F.col(f"`{vector_col}`")
    kept = docs.select(
        F.col(f"`{id_col}`").alias("id"), vector.cast("array<double>").alias("vector"), F.col(f"`{label_col}`").alias("label")
    )
    return kept.where(usable(F.col("vector")))


def quantised(batch: pa.RecordBatch, width: int, bound: int) -> np.ndarray:
    """The integer vectors of a batch; a vector that does not fit stops the job."""
    vectors = batch["vector"]
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if (sizes != width).any():
        odd = int(np.flatnonzero(sizes != width)[0])
        raise ValueError(f"vector {batch['id'][odd]} has {sizes[odd]} components, not {width}")
    scaled = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
    if len(scaled) and np.abs(scaled).max() > bound:
        odd = int(np.flatnonzero(np.abs(scaled).max(axis=1) > bound)[0])
        raise ValueError(f"vector {batch['id'][odd]} has a component too large for exact sums")
    return scaled.astype(np.int64)


def _first_entries(rows: DataFrame, parts: int, n_entries: int) -> Codebooks | None:
    """Codebooks from the vectors with the smallest ids; ``n_entries`` rows reach the driver."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(n_entries).collect()
    if not first:
        return None
    width = len(first[0]["vector"])
    if width == 0 or width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    table = pa.table({"id": pa.array([str(r["id"]) for r in first]), "vector": pa.array([r["vector"] for r in first], pa.list_(pa.float64()))})
    bound = component_bound(width)
    vectors = quantised(table.combine_chunks().to_batches()[0], width, bound)
    return Codebooks(np.ascontiguousarray(vectors.reshape(len(first), parts, -1).transpose(1, 0, 2)), bound)


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The entries after one round. A task returns one row for each entry that it has used."""
    parts, n, size = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, n, size), dtype=np.int64)
        count = np.zeros((parts, n), dtype=np.int64)
        for batch in batches:
            vectors = quantised(batch, parts * size, books.bound)
            codes, _ = assign(vectors, books.entries)
            cut = vectors.reshape(-1, parts, size)
            for part in range(parts):
                order = np.argsort(codes[:, part], kind="stable")
                used, start = np.unique(codes[order, part], return_index=True)
                total[part, used] += np.add.reduceat(cut[order, part], start) if len(used) else 0
                count[part] += np.bincount(codes[:, part], minlength=n)
        part, entry = np.nonzero(count)
        columns = [pa.array(part), pa.array(entry), pa.array(count[part, entry]), *[pa.array(total[part, entry, i]) for i in range(size)]]
        yield pa.RecordBatch.from_arrays(columns, names)

    names = ["part", "entry", "n", *[f"s{i}" for i in range(size)]]
    found = rows.mapInArrow(sums, ", ".join(f"{c} long" for c in names)).groupBy("part", "entry")
    entries = books.entries.copy()
    for row in found.agg(*[F.sum(c).alias(c) for c in names[2:]]).collect():
        entries[row["part"], row["entry"]] = [row[c] // row["n"] for c in names[3:]]
    return Codebooks(entries, books.bound)


def fit(docs: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", parts=PARTS, n_entries=ENTRIES, rounds=ROUNDS) -> Codebooks | None:
    """Codebooks of all vectors; None when there is no vector."""
    rows = _rows(docs, id_col, vector_col, label_col)
    books = _first_entries(rows, parts, n_entries)
    for _ in range(rounds if books else 0):
        books = _moved(rows, books)
    return books


def encode(docs: DataFrame, books: Codebooks | None, id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """One row per kept vector: id, ``label``, ``code`` (a byte for each part) and ``error``."""
    rows = _rows(docs, id_col, vector_col, label_col)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    if books is None:
        return rows.where("false").select(F.col("id").alias(id_col), "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    parts, _, size = books.entries.shape

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = assign(quantised(batch, parts * size, books.bound), books.entries)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(codes), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], packed.cast(pa.binary()), pa.array(error)], ["id", "label", "code", "error"])

    coded = rows.mapInArrow(apply, f"id {kinds['id']}, label {kinds['label']}, code binary, error long")
    return coded.withColumnRenamed("id", id_col)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over equal labels.

    Sums are taken map-side first; a label of very many rows is joined where its rows lie.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    keyed = stage(coded.withColumn("label_key", named), "codes")
    sums = keyed.groupBy("label_key").agg(F.sum("error").alias("label_error"))
    return lookup_join(keyed, ["label_key"], sums, "inner", staged=True).drop("label_key")


def decode(books: Codebooks, codes: np.ndarray) -> np.ndarray:
    """The vectors that codes (vector, part) stand for."""
    parts = np.arange(books.entries.shape[0])
    return books.entries[parts, codes].reshape(len(codes), -1) / SCALE
