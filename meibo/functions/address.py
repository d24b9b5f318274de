"""One spelling for Japanese addresses. Every function takes and returns a Spark ``Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meibo.functions.text import match_text

# Kanji digits from zero to nine, and the signs for ten and a hundred.
KANJI_DIGITS = "〇一二三四五六七八九"
TEN, HUNDRED = "十", "百"
# What stands behind a number in an address: block, lot (two ways), house, street, line.
NUMBERED = "丁目|番地|番|号|条|線"
# How a folded address shows the end of a block number and of a lot number.
BLOCK_END, LOT_END = "-", "_"

_SIGN = f"[{KANJI_DIGITS}{TEN}{HUNDRED}]"


def _digit(sign: Column, missing: str) -> Column:
    """A kanji digit, or ``missing`` where there is none, as a number."""
    return F.coalesce(F.nullif(F.translate(sign, KANJI_DIGITS, "0123456789"), F.lit("")), F.lit(missing)).cast("int")


def _number(piece: Column) -> Column:
    """A piece of kanji digits only as a number: read by place, or with tens and hundreds; other pieces as they are."""
    hundreds = _digit(F.regexp_extract(piece, f"([{KANJI_DIGITS}]?){HUNDRED}", 1), "1")
    tens = _digit(F.regexp_extract(piece, f"([{KANJI_DIGITS}]?){TEN}", 1), "1")
    ones = _digit(F.regexp_extract(piece, f"([{KANJI_DIGITS}]?)\\z", 1), "0")
    value = (
        F.when(piece.contains(HUNDRED), hundreds * 100).otherwise(0)
        + F.when(piece.contains(TEN), tens * 10).otherwise(0)
        + ones
    )
    counted = f"\\A[{KANJI_DIGITS}]?({HUNDRED}[{KANJI_DIGITS}]?{TEN}|{HUNDRED}|{TEN})[{KANJI_DIGITS}]?\\z"
    return (
        F.when(piece.rlike(f"\\A[{KANJI_DIGITS}]+\\z"), F.translate(piece, KANJI_DIGITS, "0123456789"))
        .when(piece.rlike(counted), value.cast("string"))
        .otherwise(piece)
    )


def read_numerals(c: Column) -> Column:
    """Kanji numbers that count blocks, lots, houses, streets or lines to digits; names keep theirs.

    ``三重県四日市市一丁目二十三番`` becomes ``三重県四日市市1丁目23番``.
    """
    # A cut before such a number and one behind it, so that the number is a piece by itself.
    cut = f"(?<!{_SIGN})(?={_SIGN}+(?:{NUMBERED}))|(?<={_SIGN})(?={NUMBERED})"
    read = F.array_join(F.transform(F.split(c, cut), _number), "")
    return F.when(c.rlike(f"{_SIGN}(?:{NUMBERED})"), read).otherwise(c)


def address_text(c: Column) -> Column:
    """The spelling used to compare addresses; null for a blank cell.

    Beyond :func:`match_text`: numbers of blocks, lots and so on in digits; ``大字``, and ``字`` behind a
    municipality, left out; one sign for the small ke (``霞ヶ関``, ``霞が関``) and one for the joining no between
    kanji; ``1丁目2番地3号``, ``1丁目2番3`` and ``1丁目の2番の3`` as ``1-2_3``. A plain ``1-2-3`` stays.
    """
    folded = read_numerals(match_text(c))
    steps = [
        ("大字|(?<=[市区町村])字", ""),
        ("(?<=\\p{IsHan})[ヶケヵカがガ](?=\\p{IsHan})", "ヶ"),
        ("(?<=\\p{IsHan})[のノ之](?=\\p{IsHan})", "ノ"),
        ("(?<=[0-9])(?:[ー~]|の)(?=[0-9])", BLOCK_END),
        ("(?<=[0-9])丁目[の-]?", BLOCK_END),
        ("(?<=[0-9])番地?[の-]?(?![一-龠])", LOT_END),
        ("(?<=[0-9])号(?![一-龠])", ""),
    ]
    for old, new in steps:
        folded = F.regexp_replace(folded, old, new)
    # Nothing of this is found in plain ASCII.
    return F.when(c.rlike("[^ -~]"), folded).otherwise(match_text(c))
