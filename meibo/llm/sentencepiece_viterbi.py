"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The pieces and scores come from a public model file; the result is the segmentation with the
largest sum of scores (of equal ones, the one whose last differing piece is longer). Spaces become
the mark U+2581, one is put in front, and a character without a piece becomes its UTF-8 byte
pieces. A literal U+2581 is written as bytes too, so decoding gives every text back exactly.

The search holds no more than a window: pieces have a bounded length, so only the last places can
begin another piece. Ids are committed as soon as every path that can still win runs through one
place: where no piece crosses a boundary, or where the backpointers of all open places meet. Between
two such places words are independent of each other, so the ids of short words are remembered, in a
bounded table.

A null text has null ids and an empty one none. Rows are encoded one by one: repeated rows get equal
ids, and other columns may have any name.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Open places after which the backpointers are compared.
WINDOW = 64
#: Words that a worker remembers beside as many older ones, and the longest one.
REMEMBERED = 250_000
REMEMBERED_LENGTH = 48
UNREACHED = float("-inf")
SPACED, BARE = 0, 1
#: Rows that a worker hands back at once.
ROWS_OUT = 512


def _packed(ids) -> bytes:
    return np.array(ids, dtype="<i4").tobytes()



class Pieces:
    """A piece vocabulary as a tree of characters."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], special: set[int]) -> None:
        self.text = [p for p, _ in pieces]
        self.byte_ids = byte_ids
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        # By character: the nodes that follow, and score and ids of the piece that ends here.
        self.tree: dict[str, list] = {}
        self.longest = 1
        usable = [(i, p, s) for i, (p, s) in enumerate(pieces) if i not in special and i not in self.byte_of and p]
        for i, piece, score in usable:
            node = self.tree
            for char in piece[:-1]:
                entry = node.setdefault(char, [None, None, None])
                if entry[0] is None:
                    entry[0] = {}
                node = entry[0]
            node.setdefault(piece[-1], [None, None, None])[1:] = score, (i,)
            self.longest = max(self.longest, len(piece))
        #: Neighbours inside pieces. No piece crosses the place between any other two characters.
        self.inside = {pair for _, p, _ in usable for pair in zip(p, p[1:], strict=False)}
        self.unknown = min((s for _, _, s in usable), default=0.0) - 10.0
        self.cut_space = not any(b == SPACE != a for a, b in self.inside)
        self.cut_line = not any("\n" in pair for pair in self.inside)
        # What a piece decodes to by itself; bytes above ASCII only do together.
        self.plain = [p.replace(SPACE, " ") for p in self.text]
        self.joined = set()
        for i, b in self.byte_of.items():
            self.plain[i] = chr(b) if b < 0x80 else ""
            if b >= 0x80:
                self.joined.add(i)

    def of_char(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode("utf-8"))


def load(path: str) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(size)]
    bytes_at = {int(p[3:5], 16): i for i, (p, _) in enumerate(pieces) if model.is_byte(i)}
    special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
    return Pieces(pieces, [bytes_at[b] for b in range(256)], special)


@cache
def vocabulary(path: str) -> Pieces:
    return load(path)


def segment(pieces: Pieces, text: str, window: int = WINDOW) -> list[int]:
    """Ids of ``text``, in which spaces are already marks.

    ``best`` and ``back`` hold the places since the last committed one only.
    """
    out: list[int] = []
    tree, unknown, longest = pieces.tree, pieces.unknown, pieces.longest
    size = len(text)
    base = 0  # the committed place; index 0 of the lists
    best: list[float] = [0.0]
    back: list = [None]
    reach, look = 0, window  # how far pieces reach so far; where backpointers are compared next

    def write(place: int) -> None:
        """Write the ids from the committed place to ``place``, counted from there."""
        found = []
        while place > 0:
            place, ids = back[place]
            found.append(ids)
        for ids in reversed(found):
            out.extend(ids)

    for at in range(size):
        if reach <= at:
            # No piece crosses this place, so all paths run through it.
            if at > base:
                write(at - base)
                base, look = at, at + window
            best, back = [0.0], [None]
        elif at >= look:
            place = _meeting(best, back, at - base, longest)
            if place > 0:
                write(place)
                base += place
                best = best[place:]
                back = [x and (x[0] - place, x[1]) for x in back[place:]]
            # Where paths do not meet for long, looking twice as late each time keeps the work linear.
            look = at + max(window, at - base)
        here = at - base
        if len(best) <= here + longest:
            best += [UNREACHED] * longest
            back += [None] * longest
        score = best[here]
        if score == UNREACHED:
            continue
        place, single = here, False
        entry = tree.get(text[at])
        while entry is not None:
            node, gain, ids = entry
            place += 1
            if gain is not None:
                single |= place == here + 1
                if score + gain > best[place]:
                    best[place] = score + gain
                    back[place] = here, ids
                if base + place > reach:
                    reach = base + place
            if node is None or base + place == size:
                break
            entry = node.get(text[base + place])
        if not single:
            if score + unknown > best[here + 1]:
                best[here + 1] = score + unknown
                back[here + 1] = here, pieces.of_char(text[at])
            reach = max(reach, at + 1)
    write(size - base)
    return out


def _meeting(best: list, back: list, here: int, longest: int) -> int:
    """The last place that the paths to all open places share; only the last ``longest`` can go on."""
    low = max(0, here - longest + 1)
    open_places = {p for p in range(low, len(best)) if best[p] != UNREACHED}
    while len(open_places) > 1:
        last = max(open_places)
        open_places.discard(last)
        open_places.add(back[last][0] if last else 0)
    return open_places.pop()


class Encoder:
    """Encodes texts, remembering the ids of short words as bytes."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        # Words after one space mark; words at the start of a line, and after several marks.
        self.known: tuple[dict[str, bytes], ...] = ({}, {})
        self.older: tuple[dict[str, bytes], ...] = ({}, {})
        self.newline = _packed(pieces.of_char("\n"))
        self.mark = _packed(pieces.of_char(SPACE))

    def _part(self, kind: int, part: str, text: str) -> bytes:
        """The ids of ``text``, remembered under ``part``.

        When the table is full it becomes the older one, whose words move back when they are met.
        """
        found = self.known[kind].get(part)
        if found is not None:
            return found
        found = self.older[kind].get(part)
        if found is None:
            word = part.rstrip(string.punctuation)
            end = part[len(word) :]
            if word and end and (word[-1], end[0]) not in self.pieces.inside:
                found = self._part(kind, word, text[: -len(end)]) + self._part(BARE, end, end)
            else:
                found = _packed(segment(self.pieces, text))
        if len(part) <= REMEMBERED_LENGTH:
            if sum(map(len, self.known)) >= REMEMBERED:
                self.older, self.known = self.known, ({}, {})
            self.known[kind][part] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text. A literal mark cuts the text, being bytes of its own."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        out: list[bytes] = []
        for i, run in enumerate(text.split(SPACE)):
            if i:
                out.append(self.mark)
            self._run(run, out, not i)
        return np.frombuffer(b"".join(out), dtype="<i4")

    def _run(self, run: str, out: list[bytes], first: bool) -> None:
        """``first``: a space mark goes in front."""
        if not (self.pieces.cut_space and self.pieces.cut_line):
            out.append(_packed(segment(self.pieces, SPACE * first + run.replace(" ", SPACE))))
            return
        for i, line in enumerate(run.split("\n")):
            if i:
                out.append(self.newline)
            words = line.split(" ")
            marked = first and not i
            if "" in words:
                self._spaces(SPACE * marked + line.replace(" ", SPACE), out)
                continue
            if not marked:
                out.append(self._part(BARE, words[0], words[0]))
                del words[0]
            found = list(map(self.known[SPACED].get, words))
            if None in found:
                found = [self._part(SPACED, w, SPACE + w) if f is None else f for w, f in zip(words, found, strict=True)]
            out += found

    def _spaces(self, line: str, out: list[bytes]) -> None:
        """A line with spaces at its ends or next to each other: every part begins with its marks."""
        words = line.split(SPACE)
        if words[0]:
            out.append(self._part(BARE, words[0], words[0]))
        marks = SPACE
        for word in words[1:-1]:
            if word:
                out.append(self._part(BARE, marks + word, marks + word))
                marks = SPACE
            else:
                marks += SPACE
        if len(words) > 1:
            out.append(self._part(BARE, marks + words[-1], marks + words[-1]))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the space put in front."""
        pieces = self.pieces
        if pieces.joined.isdisjoint(ids):
            text = "".join(map(pieces.plain.__getitem__, ids))
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in pieces.byte_of:
                    held.append(pieces.byte_of[i])
                    continue
                parts += [held.decode("utf-8", "replace"), pieces.plain[i]]
                held.clear()
            text = "".join(parts) + held.decode("utf-8", "replace")
        return text.removeprefix(" ")


@cache
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``ids``, ``n_ids`` and ``round_trip`` (decoding gave the text back)."""
    path = path or public_tokenizers.path(MODEL)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for batch in batches:
            # Ids take more room than their text, so they leave in small parts.
            for start in range(0, len(batch), ROWS_OUT):
                part = batch.iloc[start : start + ROWS_OUT]
                rows = []
                for text in part["text"]:
                    ids = None if text is None else coder.encode(text)
                    whole = ids is None or coder.decode(ids.tolist()) == text
                    rows.append((ids, 0 if ids is None else len(ids), whole))
                made = pd.DataFrame(rows, columns=["ids", "n_ids", "round_trip"], index=part.index)
                yield pd.concat([part[["id"]], made], axis=1)

    # The id travels as text, since pandas would make a float of a number that may be null.
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sent = rows.select(F.col("id").cast("string").alias("id"), "text")
    coded = sent.mapInPandas(encode, "id string, ids array<int>, n_ids long, round_trip boolean")
    return coded.select(F.col("id").cast(rows.schema["id"].dataType).alias(id_col), "ids", "n_ids", "round_trip")


def decode_documents(coded: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``coded`` with the text of its ids in ``text_col``; null ids give null."""
    path = path or public_tokenizers.path(MODEL)

    def decode(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else encoder(path).decode(list(r)) for r in rows], dtype=object)

    return coded.withColumn(text_col, F.pandas_udf(decode, "string")(F.col(f"`{ids_col}`")))
