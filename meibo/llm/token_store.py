"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are sorted by id. Every task encodes its range of them and cuts it into shards of about
``SHARD_IDS`` ids. In a shard the frequent pairs of neighbouring symbols are replaced by new symbols
(nonterminals), round after round: a round takes the most frequent pairs, replaces them from left to
right where they do not overlap, and the next round may pair the new symbols. The rounds end when no
pair occurs ``MIN_COUNT`` times any more. No pair crosses the end of a document. A shard holds its rules, the expansion length of each rule, and where each document
begins, so a document, or a slice of one, is decoded without the rest of the shard.

Shards are rows of a Parquet table in the shared folder: a task that is lost is simply run again, and
only whole results are read. Of the sizes, one row for each partition reaches the driver.

A null text counts as empty; an empty text is the end id alone. Null ids come first. Rows with one
id are ordered by a hash of the text; repeated rows are stored each. Other columns may have any name.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meibo.operators.staging import stage

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARD_IDS = 1 << 20
#: Pairs replaced in a round, and how often a pair must occur in a shard to be replaced.
PAIRS = 4096
MIN_COUNT = 16
#: Words that a worker remembers.
REMEMBERED = 800_000
#: How the tokenizer marks the last piece of a word, and a bound below which letters stay single letters.
WORD_END = "</w>"
PLAIN_BELOW = "\u0130"
MAGIC = b"IDRP"


# ---- grammar -------------------------------------------------------------------------------


@dataclass
class Shard:
    """Symbols below ``first`` are ids; symbol ``first + k`` stands for the pair ``rules[k]``."""

    first: int
    rules: np.ndarray  # (rules, 2)
    lengths: np.ndarray  # ids that a rule expands to
    symbols: np.ndarray
    offsets: np.ndarray  # first symbol of every document, and the end
    counts: np.ndarray  # ids of every document
    doc_ids: np.ndarray
    nulls: np.ndarray


#: Buckets that pairs are hashed to for a first count.
PAIR_BITS = 18


def _bucket(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - PAIR_BITS)


def _frequent_pairs(left, right, bucket, inner, pairs: int, min_count: int) -> np.ndarray:
    """The most frequent (left << 32 | right), counted exactly among pairs whose hash bucket is frequent.

    Of pairs in one bucket the most frequent is taken; another waits for a later round.
    """
    size = np.bincount(bucket[inner], minlength=1 << PAIR_BITS)
    hot = size >= min_count
    if hot.sum() > 2 * pairs:
        hot &= size >= np.partition(size, -2 * pairs)[-2 * pairs]
    at = np.flatnonzero(hot[bucket] & inner)
    keys, counts = np.unique(left[at].astype(np.uint64) << np.uint64(32) | right[at], return_counts=True)
    keys, counts = keys[counts >= min_count], counts[counts >= min_count]
    best = keys[np.lexsort((keys, -counts))]
    mine = _bucket((best >> np.uint64(32)).astype(np.uint32), best.astype(np.uint32))
    return best[np.sort(np.unique(mine, return_index=True)[1])][:pairs]


def compress(ids: np.ndarray, offsets: np.ndarray, pairs: int = PAIRS, min_count: int = MIN_COUNT):
    """(first nonterminal, rules, symbols, offsets) of ids cut into documents at ``offsets``."""
    symbols = ids.astype(np.uint32)
    first = int(symbols.max(initial=0)) + 1
    last = np.zeros(len(symbols), dtype=bool)  # the last symbol of its document
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    rules = np.zeros((0, 2), dtype=np.uint32)
    while len(symbols) > 1:
        inner = ~last[:-1]
        left, right = symbols[:-1], symbols[1:]
        bucket = _bucket(left, right)
        keys = _frequent_pairs(left, right, bucket, inner, pairs, min_count)
        if not len(keys):
            break
        rule_of = np.full(1 << PAIR_BITS, -1, dtype=np.int16)
        rule_of[_bucket((keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32))] = np.arange(len(keys))
        rule = rule_of[bucket]
        at = np.flatnonzero((rule >= 0) & inner)
        rule = rule[at].astype(np.int64)
        hit = keys[rule] == left[at].astype(np.uint64) << np.uint64(32) | right[at]
        at, rule = at[hit], rule[hit]
        # In a run of overlapping pairs every other one is replaced.
        start = np.concatenate(([True], np.diff(at) != 1))
        head = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        chosen = (np.arange(len(at)) - head) % 2 == 0
        used = np.bincount(rule[chosen], minlength=len(keys)) >= 2
        chosen &= used[rule]
        if not used.any():
            # Pairs that overlap stand in each other's way; one pair alone always has two places.
            if pairs == 1:
                break
            pairs = 1
            continue
        number = np.cumsum(used) - 1 + first + len(rules)
        at, rule = at[chosen], rule[chosen]
        symbols[at] = number[rule]
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
        new = keys[used]
        rules = np.concatenate((rules, np.stack((new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)), axis=1).astype(np.uint32)))
    sizes = np.diff(offsets) > 0
    ends = np.zeros(len(offsets) - 1, dtype=np.int64)
    ends[sizes] = np.flatnonzero(last) + 1
    return first, rules, symbols, np.concatenate(([0], np.maximum.accumulate(ends)))


def rule_lengths(first: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each rule stands for. A rule uses earlier ones only."""
    sizes: list[int] = []
    for a, b in rules.tolist():
        sizes.append((1 if a < first else sizes[a - first]) + (1 if b < first else sizes[b - first]))
    return np.array(sizes, dtype=np.int64)


def expansions(first: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rules written out one after another, and where each begins. A rule uses earlier ones only."""
    parts: list[np.ndarray] = []
    for a, b in rules.tolist():
        sides = [np.array([s], np.uint32) if s < first else parts[s - first] for s in (a, b)]
        parts.append(np.concatenate(sides))
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), starts


def expand(symbols: np.ndarray, first: int, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of ``symbols``."""
    if not len(flat):
        return symbols.astype(np.uint32)
    ruled = symbols >= first
    rule = np.where(ruled, symbols.astype(np.int64) - first, 0)
    size = np.where(ruled, starts[rule + 1] - starts[rule], 1)
    end = np.cumsum(size)
    out = np.repeat(symbols.astype(np.uint32), size)
    many = np.flatnonzero(ruled)
    inside = np.arange(size[many].sum()) - np.repeat(np.cumsum(size[many]) - size[many], size[many])
    out[np.repeat(end[many] - size[many], size[many]) + inside] = flat[np.repeat(starts[rule[many]], size[many]) + inside]
    return out


def make_shard(documents: list[np.ndarray], doc_ids: list[int | None]) -> Shard:
    counts = np.array([len(d) for d in documents], dtype=np.int64)
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    first, rules, symbols, offsets = compress(ids, np.concatenate(([0], np.cumsum(counts))))
    nulls = np.array([d is None for d in doc_ids], dtype=bool)
    numbers = np.array([0 if d is None else d for d in doc_ids], dtype=np.int64)
    return Shard(first, rules, rule_lengths(first, rules), symbols, offsets, counts, numbers, nulls)


def write_shard(shard: Shard) -> bytes:
    """The file format: magic, five sizes, then little-endian arrays."""
    wide = shard.first + len(shard.rules) > 1 << 16
    head = struct.pack("<4sIIIIB", MAGIC, shard.first, len(shard.rules), len(shard.symbols), len(shard.counts), wide)
    arrays = (
        shard.rules.astype("<u4"),
        shard.lengths.astype("<u4"),
        shard.symbols.astype("<u4" if wide else "<u2"),
        shard.offsets.astype("<u4"),
        shard.counts.astype("<u4"),
        shard.doc_ids.astype("<i8"),
        shard.nulls.astype("u1"),
    )
    return head + b"".join(a.tobytes() for a in arrays)


def read_shard(data: bytes) -> Shard:
    magic, first, n_rules, n_symbols, n_docs, wide = struct.unpack_from("<4sIIIIB", data)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at = struct.calcsize("<4sIIIIB")

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += part.nbytes
        return part

    rules = take("<u4", 2 * n_rules).reshape(-1, 2)
    lengths = take("<u4", n_rules)
    symbols = take("<u4" if wide else "<u2", n_symbols)
    return Shard(first, rules, lengths, symbols, take("<u4", n_docs + 1), take("<u4", n_docs), take("<i8", n_docs), take("u1", n_docs).astype(bool))


def document_slice(shard: Shard, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of one document; rules outside the slice are skipped by their length."""
    count = int(shard.counts[document])
    stop = count if stop is None else min(stop, count)
    out: list[int] = []
    open_symbols = shard.symbols[shard.offsets[document] : shard.offsets[document + 1]].tolist()[::-1]
    at = 0
    while open_symbols and at < stop:
        symbol = open_symbols.pop()
        size = 1 if symbol < shard.first else int(shard.lengths[symbol - shard.first])
        if at + size <= start:
            at += size
        elif symbol < shard.first:
            out.append(symbol)
            at += 1
        else:
            a, b = shard.rules[symbol - shard.first].tolist()
            open_symbols += [b, a]
    return np.array(out, dtype=np.uint32)


# ---- encoding ------------------------------------------------------------------------------


class Encoder:
    """The library's ids, word by word.

    The tokenizer drops white space and no token crosses it, so the ids of a text are those of its
    parts between spaces; the ids of parts met before are remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def _learn(self, parts: list[str]) -> None:
        """Ask the library for the ids of parts.

        A part of Latin letters is a word by itself, and the last id of a word tells that it ends, so
        all of them are encoded as one text. Other parts are encoded one by one.
        """
        words = [w for w in parts if w.isalpha() and max(w) < PLAIN_BELOW]
        (got,) = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(got.ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(words):
            data, at = ids.tobytes(), 0
            for word, stop in zip(words, (4 * stops).tolist(), strict=True):
                self.known[word] = data[at:stop]
                at = stop
            rest = [w for w in parts if not (w.isalpha() and max(w) < PLAIN_BELOW)]
        else:
            rest = parts
        for part, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[part] = np.array(found.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        known = self.known
        found = [list(map(known.get, words)) for words in split]
        new = {w for words, ids in zip(split, found, strict=True) for w, i in zip(words, ids, strict=True) if i is None}
        # A plain word before punctuation is a part by itself.
        cut = {w: b for w in new if (b := w.rstrip(string.punctuation)) != w and b.isalpha() and max(b) < PLAIN_BELOW}
        ask = new.difference(cut)
        for w, b in cut.items():
            ask.update(p for p in (b, w[len(b) :]) if p not in known)
        self._learn(list(ask))
        for word, base in cut.items():
            known[word] = known[base] + known[word[len(base) :]]
        return [
            np.frombuffer(b"".join([known[w] if i is None else i for w, i in zip(words, ids, strict=True)]), dtype="<u4")
            for words, ids in zip(split, found, strict=True)
        ]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


SHARD_SCHEMA = "part int, number int, first_token long, n_tokens long, payload binary"


def write_token_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The table of shards of ``docs``, written once: partition, number in it, ids before and in it, payload."""
    path = path or public_tokenizers.path(TOKENIZER)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list = []
        size = 0
        end = np.array([END_ID], dtype=np.uint32)

        def flush() -> pd.DataFrame:
            nonlocal number, before, size
            row = (part, number, before, size, write_shard(make_shard(held, names)))
            number, before, size = number + 1, before + size, 0
            held.clear()
            names.clear()
            return pd.DataFrame([row], columns=["part", "number", "first_token", "n_tokens", "payload"])

        for batch in batches:
            ids = batch["id"].tolist()
            texts = [t or "" for t in batch["text"]]
            for start in range(0, len(texts), 512):
                for name, found in zip(ids[start : start + 512], encoder(path).encode(texts[start : start + 512]), strict=True):
                    held.append(np.concatenate((found, end)))
                    names.append(None if name is None else int(name))
                    size += len(found) + 1
                    if size >= SHARD_IDS:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    # The id travels as text, since pandas would make a float of a number that may be null.
    sent = ordered.select(F.col("id").cast("string").alias("id"), "text")
    return stage(sent.mapInPandas(encode, SHARD_SCHEMA), "token-shards")


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            shard = read_shard(row.payload)
            flat, starts = expansions(shard.first, shard.rules)
            ids = expand(shard.symbols, shard.first, flat, starts)
            begin = np.concatenate(([0], np.cumsum(shard.counts.astype(np.int64))))
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pd.DataFrame(
                {
                    "id": pd.arrays.IntegerArray(shard.doc_ids.copy(), shard.nulls.copy()),
                    "part": row.part,
                    "first_token": row.first_token + begin[:-1],
                    "n_tokens": shard.counts.astype(np.int64),
                    "ids_crc32": np.array(crc, dtype=np.int64),
                }
            )


def read_token_store(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document, read back from the shards: id, ``start``, ``n_tokens``, ``ids_crc32``."""
    spark = shards.sparkSession
    sizes = sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, base = 0, []
    for part, n in sizes:
        base.append((part, before))
        before += n
    bases = spark.createDataFrame(base, "part int, base long")
    rows = shards.mapInPandas(_decoded, "id long, part int, first_token long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "part").select(
        F.col("id").alias(id_col), (F.col("base") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32"
    )
