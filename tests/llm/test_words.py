import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from meibo.llm import words as W


def plain(text):
    found, at = [], None
    for i, c in enumerate(text + " "):
        if c.isalnum() and i < len(text):
            at = i if at is None else at
        elif at is not None:
            found.append((at, i))
            at = None
    return found


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbB éÉ漢𝕏1_-.\n", max_size=60))
def test_words_stand_where_they_do_in_the_text(text):
    hashes, starts, ends = W.words(text)
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == plain(text)
    names = [text[a:b].lower() for a, b in plain(text)]
    assert len(set(names)) == len(set(hashes.tolist()))
    assert all((hashes[i] == hashes[j]) == (names[i] == names[j]) for i in range(len(names)) for j in range(i))


def test_pieces_do_not_cut_words(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500)) + " " + "z" * 300
    whole = W.words(text)
    monkeypatch.setattr(W, "PIECE", 64)
    cut = W.words(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))


def test_shingles():
    text = "a b c d e f a b c d e"
    words = re.findall(r"\w+", text)
    assert len(W.shingles(text)) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert len(W.shingles("one two")) == 1 and len(W.shingles("Two")) == 1
    assert not len(W.shingles("")) and not len(W.shingles(None)) and not len(W.shingles(" .,"))
    assert W.shingles("One, two.")[0] == W.shingles("one two")[0] != W.shingles("two one")[0]


def test_prefixes():
    _, _, _, four = W.words("abcdX abcdY abcd abc", (4,))
    assert four[0] == four[1] != 0 and four[2] == four[3] == 0
