import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meibo.llm import pii as P

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text) if valid(kind, m[0])]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def base(text):
    return [s for s in P.find_spans(text) if s[0] in P.BASE_KINDS]


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="aZ9.@-_%+ 0123()é𝕏", max_size=40))
def test_base_spans_match_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111", "+1 (168) 555-5254", "1.2.3.4", "1.2.3.256", ".5.6", "a.b@c-d.ef", "@x.y", "é", " ", "+", "0001.2.3.4"]), max_size=8).map("".join))
def test_base_spans_of_joined_parts(text):
    assert base(text) == brute(text)


LONG = {"9": "", "1.": "", "a@": "", "+1": "", "@": "", "a.": "@b.c", " 2": "+3"}


@pytest.mark.parametrize("part", LONG)
def test_very_long_texts(part):
    # The plain patterns take quadratic time, so they only see the shorter text.
    text = part * 1000 + LONG[part]
    assert base(text) == brute(text)
    P.find_spans(part * 200_000 + LONG[part])


def test_added_spans():
    text = "IBAN: DE89 3704 0044 0532 0130 00 paid. Account no. 12345678 then https://a.example.com/x?y=1. SSN 123-45-6789; recount 99999, IBAN DE00 1234"
    assert [(k, text[a:b]) for k, a, b in P.find_spans(text) if k in ("url", "account")] == [
        ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"), ("url", "https://a.example.com/x?y=1"), ("account", "123-45-6789"),
    ]


def accounts(text):
    return [text[a:b] for k, a, b in P.find_spans(text) if k == "account"]


@pytest.mark.parametrize("cue", ["Tax ID", "Customer ID", "User ID", "Member ID", "tAx iD", "SSN", "Konto", "aCCount"])
def test_cues_in_any_case(cue):
    assert accounts(f"İ é𝕏 {cue}: 123-45-6789.") == ["123-45-6789"]
    assert [k for k, *_ in P.find_spans("see hTTps://a.example.com/x")] == ["url"]


@pytest.mark.parametrize("iban", ["CH93 0076 2011 6238 5295 7", "LI21 0881 0000 2324 013A A", "LV80 BANK 0000 4351 9500 1", "HR12 1001 0051 8630 0016 0", "PT50 0002 0123 1234 5678 9015 4"])
def test_ibans_that_end_in_a_group_of_one(iban):
    for cue in ("IBAN ", "iban: ", "Account no. "):
        for after in ("", ".", " paid", " 3 times"):
            assert accounts(cue + iban + after) == [iban]


def test_a_single_sign_after_an_identifier_is_not_part_of_it():
    assert accounts("Account 12345678 9 items; IBAN DE89 3704 0044 0532 0130 00 a b") == ["12345678", "DE89 3704 0044 0532 0130 00"]


def test_table(spark, documents):
    rows = [(1, "mail a@b.co now"), (1, "mail a@b.co now"), (2, None), (3, ""), (None, "1.2.3.4")]
    docs = documents(rows)
    got = sorted((str(r[0]), [tuple(s) for s in r["spans"]]) for r in P.find_personal_data(docs).collect())
    assert got == sorted((str(d), brute(t or "")) for d, t in rows)
    masked = P.mask(docs)
    assert masked.columns == docs.columns
    assert {r["text"] for r in masked.collect()} == {"mail [email] now", None, "", "[ip]"}
    assert not P.find_personal_data(documents([])).collect()


def test_query_digests(spark):
    from meibo.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for r in QUERIES["op4_pii"](spark, sf).collect():
        want = brute(texts[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in want) for k in KINDS]
        assert set(joined.split(",")) <= set(r["spans"].split(",")) or not want
