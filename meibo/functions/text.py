"""Text helpers. Every function takes and returns a Spark ``Column``; none uses a UDF."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII white space, no-break space, full-width space.
SPACES = " \t\r\n\u00a0\u3000"

# Hyphen, non-breaking hyphen, figure dash, en dash, em dash, horizontal bar,
# minus sign, small hyphen-minus, full-width hyphen-minus. The long vowel mark is a letter, so
# it is not listed.
HYPHENS = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d"

HYPHENS_BUT_WIDE = HYPHENS.replace("\uff0d", "")

# Full-width ASCII U+FF01..U+FF5E lies 0xFEE0 above its narrow form.
WIDE_ASCII = "".join(chr(code) for code in range(0xFF01, 0xFF5F))
NARROW_ASCII = "".join(chr(ord(ch) - 0xFEE0) for ch in WIDE_ASCII)
WIDE_DIGITS = "".join(chr(code) for code in range(0xFF10, 0xFF1A))

# Half-width katakana U+FF61..U+FF9F and their full forms, by the Unicode compatibility mapping.
HALF_KANA = "".join(chr(code) for code in range(0xFF61, 0xFFA0))
FULL_KANA = unicodedata.normalize("NFKC", "\0".join(HALF_KANA)).replace("\0", "")
# The two combining sound marks; of each the letters that it joins, and what they become.
SOUND_MARKS = "\u3099\u309a"


def _voiced(mark: str) -> tuple[str, str]:
    pairs = [(x, unicodedata.normalize("NFC", x + mark)) for x in FULL_KANA]
    pairs = [(x, y) for x, y in pairs if len(y) == 1]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


VOICED = {mark: _voiced(mark) for mark in SOUND_MARKS}

# Control characters, zero-width marks and the byte-order mark.
CONTROLS = "".join(chr(c) for c in (*range(0x20), *range(0x7F, 0xA0))) + "\u200b\u200c\u200d\u2060\ufeff"


def trim_spaces(c: Column) -> Column:
    """Remove ASCII and full-width space at both ends."""
    return F.trim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """True for null and for a cell that holds nothing but space; never null."""
    return ~F.coalesce(c.rlike(f"[^{SPACES}]"), F.lit(False))


def blank_to_null(c: Column) -> Column:
    """The trimmed cell, or null when nothing is left."""
    return F.nullif(trim_spaces(c), F.lit(""))


def _translate(c: Column, old: str, new: str) -> Column:
    """``translate`` for signs outside ASCII; plain ASCII cells, told by their length, skip it."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, old, new))


def narrow_digits(c: Column) -> Column:
    """Full-width digits to ASCII digits."""
    return _translate(c, WIDE_DIGITS, "0123456789")


def narrow_ascii(c: Column) -> Column:
    """Full-width letters, digits and signs to ASCII, and the full-width space to a space."""
    return _translate(c, WIDE_ASCII + "\u3000", NARROW_ASCII + " ")


def unify_hyphens(c: Column) -> Column:
    """Every kind of hyphen and dash to ``-``."""
    return _translate(c, HYPHENS, "-" * len(HYPHENS))


def squeeze_spaces(c: Column) -> Column:
    """Runs of ASCII and full-width space to one space, none at the ends."""
    for space in SPACES[1:]:
        c = F.replace(c, F.lit(space), F.lit(" "))
    return F.trim(F.when(c.contains("  "), F.regexp_replace(c, " +", " ")).otherwise(c))


def strip_controls(c: Column) -> Column:
    """Remove control characters, zero-width marks and the byte-order mark."""
    return F.when(c.rlike(f"[{_PATTERN_CONTROLS}]"), F.translate(c, CONTROLS, "")).otherwise(c)


_PATTERN_CONTROLS = "\\p{Cc}\u200b\u200c\u200d\u2060\ufeff"


def digits(c: Column) -> Column:
    """The ASCII digits of a cell, null when it has none. Used as the key of a phone number.

    ``+81`` before a number becomes its leading 0. Of several numbers in a cell, with a
    sign between them that no number holds, the first counts.
    """
    narrow = F.translate(c, WIDE_ASCII + "\u3000", NARROW_ASCII + " ")
    first = F.regexp_extract(narrow, "^[^0-9+]*([^/,;、・\n]*)", 1)
    home = F.regexp_replace(first, r"^\+\s*81[\s().-]*(\(0\)|0)?", "0")
    # A plainly written number needs none of that.
    plain = c.rlike(r"\A[0-9 ().-]*\z")
    found = F.when(c.rlike(r"\A[0-9]+\z"), c).when(plain, F.translate(c, " ().-", "")).otherwise(F.regexp_replace(home, "[^0-9]", ""))
    return F.nullif(found, F.lit(""))


def spelling(c: Column) -> Column:
    """Narrow letters and signs, wide katakana, lower case, one space between words, no controls.

    A space at an end stays one. Every step names its input once, so the work for a cell does not
    multiply; a cell of plain ASCII with single spaces is only lowered.
    """
    breaks = "\t\r\n"
    gone = "".join(x for x in CONTROLS if x not in breaks)
    old = breaks + "\u3000" + WIDE_ASCII + HYPHENS_BUT_WIDE + HALF_KANA
    new = "   " + " " + NARROW_ASCII + "-" * len(HYPHENS_BUT_WIDE) + FULL_KANA
    plain = F.translate(c, old + gone, new)
    joined = F.when(c.rlike(f"[\uff9e\uff9f{SOUND_MARKS}]"), join_marks(plain)).otherwise(plain)
    tidy = F.regexp_replace(F.lower(joined), "[ \u00a0]+", " ")
    return F.when(c.rlike("[^ -~]") | c.contains("  "), tidy).otherwise(F.lower(c))


def match_text(c: Column) -> Column:
    """The spelling used to compare names and addresses; null for a blank cell."""
    # No other kind of space is left.
    return F.nullif(F.trim(spelling(c)), F.lit(""))


def company_text(c: Column) -> Column:
    """The spelling used to compare company names; null when nothing is left.

    Beyond :func:`match_text`: without the legal form (``株式会社``, ``(株)``, ``㈱``, ``Co., Ltd.`` and so on) at
    either end, and without spaces, middle dots, commas and full stops.
    """
    joined = F.regexp_replace(F.regexp_replace(match_text(c), f"^(?:{_FORMS})|(?:{_FORMS})$", " "), "[ ・.,\u3001\u3002]", "")
    return F.nullif(joined, F.lit(""))


# Legal forms of companies and other bodies, as they stand before or behind a name.
LEGAL_FORMS = [
    "株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "一般社団法人", "公益社団法人", "一般財団法人",
    "公益財団法人", "社会福祉法人", "医療法人社団", "医療法人財団", "医療法人", "学校法人", "宗教法人", "特定非営利活動法人",
]
SHORT_FORMS = ["株", "有", "同", "資", "名", "医", "福", "学", "社", "財"]
SIGN_FORMS = "㈱㈲㈳㈶㈻"
LATIN_FORMS = ["co", "ltd", "inc", "corp", "llc", "kk", "k.k", "gk", "corporation", "limited", "company"]
_FORMS = "|".join(
    [
        f" *(?:{'|'.join(LEGAL_FORMS)}|[{SIGN_FORMS}]|\\((?:{'|'.join(SHORT_FORMS)})\\)) *",
        f"(?:[ ,.]+(?:{'|'.join(x.replace('.', '[.]') for x in LATIN_FORMS)}))+[.]?",
    ]
)


def hyphenate_postal(c: Column) -> Column:
    """Seven digits, in any spelling, to ``123-4567``; other cells stay as they are."""
    number = F.translate(trim_spaces(c), WIDE_DIGITS + HYPHENS + "-", "0123456789")
    return F.when(
        number.rlike("\\A[0-9]{7}\\z"),
        F.concat_ws("-", F.substring(number, 1, 3), F.substring(number, 4, 4)),
    ).otherwise(c)


def join_marks(c: Column) -> Column:
    """Join every sound mark to the katakana before it, where there is such a letter."""
    for mark, (letters, joined) in VOICED.items():
        pair = f"[{letters}]{mark}"
        # Each piece ends in a pair, but for the last.
        pieces = F.split(c, f"(?<={pair})")
        c = F.array_join(F.transform(pieces, _joined(pair, letters, joined)), "")
    return c


def _joined(pair: str, letters: str, joined: str):
    def one(piece: Column) -> Column:
        n = F.length(piece)
        letter = F.substring(piece, n - 1, F.lit(1))
        whole = F.concat(F.substring(piece, F.lit(1), n - 2), F.translate(letter, letters, joined))
        return F.when(piece.rlike(f"{pair}\\z"), whole).otherwise(piece)

    return one


def widen_kana(c: Column) -> Column:
    """Half-width katakana to full-width; a sound mark joins the letter before it."""
    wide = F.translate(c, HALF_KANA, FULL_KANA)
    return F.when(c.rlike("[\uff61-\uff9f]"), join_marks(wide)).otherwise(c)


def replace(old: str, new: str):
    """A fix that puts ``new`` for every ``old``."""
    return lambda c: F.replace(c, F.lit(old), F.lit(new))


def null_if(value: str):
    """A fix that empties a cell holding exactly ``value``."""
    return lambda c: F.nullif(c, F.lit(value))
