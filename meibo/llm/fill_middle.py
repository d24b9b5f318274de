"""Fill-in-the-middle by a pipeline of whole-array Arrow functions.

A text is cut into units (runs of ASCII letters, and every other character alone), and two places
between units divide it into prefix, middle and suffix. Its hash decides whether it stays plain or
becomes ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each part behind its mark.

For each batch the units become one list array. It is flattened beside the indices of its parents, the
ordinal of each unit in its text is compared with the two places, units are filtered by role, and each
role's units are made lists again and joined to one piece for each text. No Python loop runs over units
or texts. Texts are handled in groups of about ``GROUP_BYTES``; a longer text is a group by itself.

A null text counts as empty; an empty text, and one that holds a mark, stays plain, so that every output
can be undone. A null id is hashed as the word ``null``. Rows are treated one by one, so repeated rows
and ties change nothing, an empty table gives an empty result, and other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 texts so many are transformed, and of 100 transformed ones so many are ``spm``.
RATE = 90
SPM_RATE = 20
#: Bytes of text that are cut into units at once, about.
GROUP_BYTES = 2 << 20
#: A byte that UTF-8 never holds.
_CUT = b"\xff"
#: A unit in bytes: letters, another ASCII character, or the bytes of one character beyond ASCII.
_UNIT = rb"([A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc0-\xf7][\x80-\xbf]*)"
#: What tasks get and return; ``doc`` is the id whatever its type.
_OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def numbers(doc_id: Column, seed: int = 1) -> list[Column]:
    """The first four 32-bit numbers of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _modulo(a: pa.Array, b) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def units(texts: pa.Array) -> pa.Array:
    """Every text (binary) as the list of its units."""
    cut = pc.replace_substring_regex(texts, pattern=_UNIT, replacement=rb"\1" + _CUT)
    lists = pc.split_pattern(cut, pattern=_CUT)
    # Behind the last cut is an empty part.
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    flat, parents = pc.filter(flat, full), pc.filter(parents, full)
    return _lists(flat, np.bincount(parents.to_numpy(zero_copy_only=False), minlength=len(texts)))


def _lists(flat: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Consecutive parts of ``flat`` as lists of ``sizes``."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), flat)


def _transform(batch: pa.RecordBatch, rate: int, spm_rate: int) -> pa.RecordBatch:
    """One group of texts; columns text, h0 to h3 in, those of ``_OUT`` out."""
    texts = pc.fill_null(batch["text"], "").cast(pa.large_binary())
    lists = units(texts)
    n = pc.list_value_length(lists).cast(pa.int64())
    places = pc.add(n, 1)
    one, two = _modulo(batch["h0"], places), _modulo(batch["h1"], places)
    first, second = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    starts = pa.array(lists.offsets.to_numpy()[:-1])
    ordinals = pc.subtract(pa.array(np.arange(len(flat))), pc.take(starts, parents))
    role = pc.add(
        pc.greater_equal(ordinals, pc.take(first, parents)).cast(pa.int8()),
        pc.greater_equal(ordinals, pc.take(second, parents)).cast(pa.int8()),
    )
    sizes = (first, pc.subtract(second, first), pc.subtract(n, second))
    prefix, middle, suffix = (
        pc.binary_join(_lists(pc.filter(flat, pc.equal(role, r)), size.to_numpy(zero_copy_only=False)), pa.scalar(b"", pa.large_binary()))
        for r, size in enumerate(sizes)
    )
    marked = pc.equal(n, 0)
    for mark in MARKS:
        marked = pc.or_(marked, pc.match_substring(texts, pattern=mark))
    plain = pc.or_(marked, pc.greater_equal(_modulo(batch["h2"], 100), rate))
    reverse = pc.less(_modulo(batch["h3"], 100), spm_rate)
    p, s, m = (pa.scalar(x, pa.large_binary()) for x in MARKS)
    none = pa.scalar(b"", pa.large_binary())
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    output = pc.if_else(plain, texts, pc.if_else(reverse, spm, psm))
    shown = pc.invert(plain)
    chars = [pc.if_else(shown, pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64()), pa.scalar(None, pa.int64())) for x in (prefix, middle)]
    form = pc.if_else(plain, PLAIN, pc.if_else(reverse, SPM, PSM))
    return pa.RecordBatch.from_arrays(
        [batch["doc"], n, form, *chars, output.cast(pa.large_string()).cast(pa.string())],
        ["doc", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def _between(texts: pa.Array, heads: tuple[bytes, bytes, bytes]) -> list[pa.Array]:
    """The parts after three marks that each text holds once, in this order, the first at its start."""
    parts = []
    for mark in heads:
        halves = pc.split_pattern(texts, pattern=mark, max_splits=1)
        parts.append(pc.list_element(halves, 0))
        texts = pc.list_element(halves, 1)
    return [*parts[1:], texts]


def _restore(batch: pa.RecordBatch) -> pa.RecordBatch:
    p, s, m = MARKS
    none = pa.scalar(b"", pa.large_binary())
    shown = [i for i, name in enumerate(batch.schema.names) if name != "output"]
    done = []
    for form, heads in ((PLAIN, ()), (PSM, (p, s, m)), (SPM, (s, p, m))):
        mine = batch.filter(pc.equal(batch["form"], form))
        texts = mine["output"].cast(pa.large_binary())
        if heads:
            parts = dict(zip(heads, _between(texts, heads), strict=True))
            texts = pc.binary_join_element_wise(parts[p], parts[m], parts[s], none)
        columns = [mine.column(i) for i in shown]
        done.append(pa.RecordBatch.from_arrays([*columns, texts.cast(pa.large_string()).cast(pa.string())], [*[batch.schema.names[i] for i in shown], "text"]))
    return pa.Table.from_batches(done).combine_chunks()


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``GROUP_BYTES`` of text, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + GROUP_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = 1
) -> DataFrame:
    """One row per row of ``docs``: id, units ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    The two lengths are in code points and null for a plain text.
    """
    doc_id = F.col(f"`{id_col}`")
    rows = docs.select(
        doc_id.alias("doc"), F.col(f"`{text_col}`").alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(numbers(doc_id, seed))]
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups(batch, "text"):
                yield _transform(group, rate, spm_rate)

    done = rows.mapInArrow(apply, f"doc {rows.schema['doc'].dataType.simpleString()}, {_OUT}")
    return done.withColumnRenamed("doc", id_col)


def restore(done: DataFrame) -> DataFrame:
    """The rows of :func:`fill_in_middle` with ``text``, rebuilt from ``output`` and ``form``, in place of ``output``."""
    kept = [c for c in done.columns if c != "output"]
    schema = ", ".join(f"`{c}` {done.schema[c].dataType.simpleString()}" for c in kept) + ", text string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups(batch, "output"):
                yield from _restore(group).to_batches()

    return done.mapInArrow(apply, schema)
