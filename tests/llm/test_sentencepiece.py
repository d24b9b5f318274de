import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from meibo.llm import sentencepiece_viterbi as V

PATH = public_tokenizers.path(V.MODEL)
PARTS = ["the", "ing ", "  ", "\n", "a", "er", "ution", "é", "漢", "𝕏", "▁", "\t", "1", "2024", " of", "xq", ".", "\x00", "<0x41>", "<s>"]
texts = st.lists(st.sampled_from(PARTS), max_size=25).map("".join)


@pytest.fixture(scope="module")
def pieces():
    return V.load(PATH)


@pytest.fixture(scope="module")
def usable():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return {model.id_to_piece(i): (i, model.get_score(i)) for i in ids}


def plain(pieces, usable, text):
    """Viterbi over the whole text at once."""
    best, back = [0.0] + [None] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - pieces.longest), end):
            part = text[start:end]
            if best[start] is None:
                continue
            if part in usable:
                ids, score = (usable[part][0],), best[start] + usable[part][1]
            elif len(part) == 1:
                ids, score = pieces.of_char(part), best[start] + pieces.unknown
            else:
                continue
            if best[end] is None or score > best[end]:
                best[end], back[end] = score, (start, ids)
    out, at = [], len(text)
    while at:
        out.append(back[at][1])
        at = back[at][0]
    return [i for ids in reversed(out) for i in ids]


@settings(max_examples=400, deadline=None)
@given(text=texts)
def test_ids_and_round_trip(pieces, usable, text):
    coder = V.Encoder(pieces)
    ids = coder.encode(text).tolist()
    assert coder.decode(ids) == text
    if text and V.SPACE not in text:
        assert ids == plain(pieces, usable, V.SPACE + text.replace(" ", V.SPACE))


@settings(max_examples=100, deadline=None)
@given(text=texts, window=st.integers(1, 40))
def test_any_window_gives_the_same(pieces, usable, text, window):
    text = text.replace(" ", V.SPACE)
    assert V.segment(pieces, text, window) == plain(pieces, usable, text)


def test_long_run_without_boundary(pieces, usable):
    pick = random.Random(1)
    text = "".join(pick.choice("abcdefgh") for _ in range(5000))
    assert V.segment(pieces, text) == plain(pieces, usable, text)


def test_the_window_stays_bounded(monkeypatch, pieces):
    held = []
    monkeypatch.setattr(V, "_meeting", lambda best, *a, f=V._meeting: held.append(len(best)) or f(best, *a))
    V.segment(pieces, "aaaaaaaaabababab" * 500)
    assert not held or max(held) < 20 * V.WINDOW


def test_pieces_across_words_and_lines():
    own = V.Pieces([("a", -1.0), ("b", -1.0), (V.SPACE, -1.0), (f"a{V.SPACE}b", -1.5), ("b\n", -1.0), *[(f"<{i}>", 0.0) for i in range(256)]], list(range(5, 261)), set())
    coder = V.Encoder(own)
    assert not own.cut_space and not own.cut_line
    assert coder.encode("a b\na").tolist() == [2, 0, 2, 4, 0] and coder.decode([2, 0, 2, 4, 0]) == "a b\na"
    assert coder.encode("a b").tolist() == [2, 3] and coder.decode([2, 3]) == "a b"


def test_a_full_memory_is_set_aside(monkeypatch, pieces):
    monkeypatch.setattr(V, "REMEMBERED", 3)
    coder = V.Encoder(pieces)
    text = "one two three four five six seven one two"
    assert (coder.encode(text) == V.Encoder(pieces).encode(text)).all() and max(map(len, coder.known + coder.older)) <= 3


def test_table(documents):
    rows = [(1, None), (2, ""), (3, " "), (4, "a  b\n▁ é𝕏"), (4, "a  b\n▁ é𝕏"), (None, "x"), (2**60 + 1, "large id"), (5, "long " * 50_000), (6, "y" * 100_000)]
    docs = documents(rows)
    coded = V.encode_documents(docs)
    got = coded.collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    assert {r["doc_id"]: r["n_ids"] for r in got if r["doc_id"] in (1, 2)} == {1: 0, 2: 0}
    back = sorted((str(r["doc_id"]), str(r["text"])) for r in V.decode_documents(coded).collect())
    assert back == sorted((str(d), str(t)) for d, t in rows)
    assert not V.encode_documents(documents([])).collect()
