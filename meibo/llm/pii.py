"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors: at-signs, plus-signs, digits, address schemes and
identifier cues. From each anchor a small parser expands to the boundaries of an email, number,
address or account identifier and validates it. Every kind keeps the end of its last match, so
matches of a kind are leftmost and do not overlap; the whole text is read once, whatever its length.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``. The anchors add ``url`` (an address after a
scheme) and ``account`` (an identifier after a cue). Places are code points, the end exclusive.

A null or empty text has no spans. Rows are treated one by one, so repeated rows, ties and other
columns change nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "ssn", "account", "acct", "passport", "tax id", "customer id", "user id", "member id", "konto", "compte", "cuenta")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ADDRESS = re.compile(r"[^\s<>\"'`{}|\\^]+")
_IDENTIFIER = re.compile(r"[ \t]*(?:no\.?|nr\.?|number|#)?[ \t]*[:=#]?[ \t]*([A-Za-z]{0,4}[0-9][A-Za-z0-9]*(?:[ -][A-Za-z0-9]{2,})*)([ -][A-Za-z0-9](?![A-Za-z0-9]))?", re.IGNORECASE)


@cache
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in _DIGITS:
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for kind, names in (("url", SCHEMES), ("account", CUES)):
        for name in names:
            found.add_word(name, (kind, len(name)))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    """A-Z in lower case; every character keeps its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _luhn(digits: str) -> bool:
    total = 0
    for place, char in enumerate(reversed(digits)):
        value = ord(char) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _iban(text: str) -> bool:
    plain = re.sub(r"[ -]", "", text).upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", plain):
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _account(text: str, cue: str, start: int) -> tuple[int, int] | None:
    """The identifier that follows a cue: an IBAN, or 4 to 34 characters of which at least 4 are digits."""
    found = _IDENTIFIER.match(text, start, start + 80)
    if not found:
        return None
    value, begin = found[1], found.start(1)
    # An IBAN printed in fours may end in a group of one.
    whole = value + (found[2] or "")
    if cue == "iban" or _iban(whole):
        value = whole
        while value and not _iban(value):
            value = value[: max(value.rfind(" "), value.rfind("-"), 0)]
        return (begin, begin + len(value)) if value else None
    # Groups of letters alone are words that follow, not part of the identifier.
    while (cut := max(value.rfind(" "), value.rfind("-"))) > 0 and not any(c in _DIGITS for c in value[cut:]):
        value = value[:cut]
    if len(value) > 34 or sum(c in _DIGITS for c in value) < 4:
        return None
    return begin, begin + len(value)


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, by start and then kind."""
    if not text:
        return []
    spans: list[tuple[str, int, int]] = []
    end = dict.fromkeys(KINDS, 0)
    lower = _lower(text)
    for at, (anchor, size) in _anchors().iter(lower):
        if anchor == "digit":
            if at >= end["card"] and (m := _CARD.match(text, at)):
                end["card"] = m.end()
                digits = _only_digits(m[0]) if m.end() - at <= 40 else ""
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    spans.append(("card", at, m.end()))
            if at >= end["ip"]:
                if m := _IP.match(text, at):
                    end["ip"] = m.end()
                    if all(map(_octet, m[0].split("."))):
                        spans.append(("ip", at, m.end()))
                else:
                    # No match begins inside this run of digits either.
                    end["ip"] = at + 1
                    while end["ip"] < len(text) and text[end["ip"]] in _DIGITS:
                        end["ip"] += 1
        elif anchor == "email":
            if m := _DOMAIN.match(text, at + 1):
                start = at
                while start > end["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    spans.append(("email", start, m.end()))
                    end["email"] = m.end()
        elif anchor == "phone":
            if at >= end["phone"] and (m := _PHONE.match(text, at)):
                end["phone"] = m.end()
                if 9 <= len(_only_digits(m[0])) <= 15:
                    spans.append(("phone", at, m.end()))
        elif anchor == "url":
            start = at - size + 1
            if start >= end["url"] and (m := _ADDRESS.match(text, at + 1)):
                stop = at + 1 + len(m[0].rstrip(".,;:!?)]"))
                host = re.split(r"[/?#]", text[at + 1 : stop], maxsplit=1)[0]
                if "." in host.strip("."):
                    spans.append(("url", start, stop))
                    end["url"] = stop
        else:
            start = at - size + 1
            alone = (start == 0 or not text[start - 1].isalnum()) and not text[at + 1 : at + 2].isalpha()
            if alone and (got := _account(text, lower[start : at + 1], at + 1)) and got[0] >= end["account"]:
                spans.append(("account", *got))
                end["account"] = got[1]
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of (kind, start, end)."""

    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([find_spans(t) for t in texts], dtype=object)

    spans = F.pandas_udf(find, "array<struct<kind: string, start: int, end: int>>")
    return docs.select(F.col(f"`{id_col}`"), spans(F.col(f"`{text_col}`")).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one."""

    def cover(text: str | None) -> str | None:
        out, at = [], 0
        for kind, start, end in find_spans(text):
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        return "".join(out) + text[at:] if out else text

    masked = F.pandas_udf(lambda texts: pd.Series([cover(t) for t in texts], dtype=object), "string")
    return docs.withColumn(text_col, masked(F.col(f"`{text_col}`")))
