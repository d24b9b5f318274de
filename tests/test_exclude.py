import pytest
from pyspark.sql import functions as F

from meibo.operators.area import check_area_code, corroborate
from meibo.operators.exclude import any_of_pattern, exclude_names, exclude_suffix, first_reason, split

CHAINS = [("すきや＋",), ("",), ("   ",), (" カフェ(A) ",), ("すきや＋",), ("ABC",), ("ABCD",), (None,)]


def marked(df, label="name"):
    return {r[label]: r["reason"] for r in df.collect()}


@pytest.mark.parametrize("form", ["pattern", "joined", "shuffled"])
def test_contains(table, form):
    limits = {
        "pattern": {},
        "joined": {"max_in_pattern": 0},
        "shuffled": {"max_in_pattern": 0, "max_bytes": 0},
    }[form]
    names = ["すきや+新宿", "喫茶カフェ(A)", "カフェA", "xＡＢＣx", "AB", "", None, "　", "A B C", "ABCDE"]
    out = exclude_names(table("name", [(n,) for n in names]), "name", table("name", CHAINS), **limits)
    assert marked(out) == {
        "すきや+新宿": "chain",
        "喫茶カフェ(A)": "chain",
        "カフェA": None,
        "xＡＢＣx": "chain",
        "AB": None,
        "": None,
        None: None,
        "　": None,
        "A B C": None,
        "ABCDE": "chain",
    }


def test_exact(table, max_bytes):
    names = ["すきや+", "すきや+新宿", "カフェ(A)", None, "", "ＡＢＣ"]
    out = exclude_names(
        table("name", [(n,) for n in names]), "name", table("name", CHAINS), "exact", max_bytes=max_bytes
    )
    assert marked(out) == {
        "すきや+": "chain", "すきや+新宿": None, "カフェ(A)": "chain", None: None, "": None, "ＡＢＣ": "chain",
    }


def test_empty_list(table):
    for limit in (500, 0):
        out = exclude_names(table("name", [("a",)]), "name", table("name", [("",)]), max_in_pattern=limit)
        assert marked(out) == {"a": None}


def test_unknown_match_kind(table):
    with pytest.raises(ValueError, match="fuzzy"):
        exclude_names(table("name", [("a",)]), "name", table("name", CHAINS), "fuzzy")


def test_pattern_shares_beginnings():
    assert any_of_pattern(["abc", "abd", "ab"]) == "ab"
    assert any_of_pattern(["abc", "abd", "x"]) == "(?:ab(?:c|d)|x)"


def test_branch_names(table):
    names = ["渋谷店", "店", "本店営業部", "渋谷店　", None, " 店", "渋谷店"]
    out = exclude_suffix(table("name", [(n,) for n in names]), "name")
    assert out.count() == 7
    assert marked(out) == {
        "渋谷店": "branch", "店": None, "本店営業部": None, "渋谷店　": "branch", None: None, " 店": None,
    }


def test_first_reason_and_split(table):
    rows = table("id rule chain branch", [
        ("1", "r", "c", "b"), ("2", None, "c", "b"), ("3", None, None, "b"), ("4", None, None, None),
    ])
    kept, excluded = split(first_reason(rows, ["rule", "chain", "branch"]))
    assert kept.columns == ["id"] and [r["id"] for r in kept.collect()] == ["4"]
    assert {r["id"]: r["reason"] for r in excluded.collect()} == {"1": "r", "2": "c", "3": "b"}


AREAS = [("03", "東京"), ("０４２", "立川"), ("0422", "武蔵野"), ("0422", "三鷹"), ("045", ""), ("", "x")]


def test_area_codes(table, max_bytes):
    phones = [
        ("1", "03-1234-5678", "東京"),
        ("2", "０４２２−１１−１１１１", "三鷹"),
        ("3", "0422-11-1111", "武蔵野"),
        ("4", "042-111-1111", "立川　"),
        ("5", "0422-11-1111", "立川"),
        ("6", "06-1111-1111", "大阪"),
        ("7", None, "東京"),
        ("8", "03-1", None),
        ("9", "045-1", "横浜"),
        ("10", "0", "東京"),
    ]
    out = check_area_code(
        table("id tel area", phones), "tel", "area", table("code area", AREAS), max_bytes=max_bytes
    )
    assert out.columns == ["id", "tel", "area", "verdict"]
    assert {r["id"]: r["verdict"] for r in out.collect()} == {
        "1": "ok", "2": "ok", "3": "ok", "4": "ok", "5": "mismatch", "6": "unknown_code", "7": None,
        "8": "mismatch", "9": "mismatch", "10": "unknown_code",
    }


def test_corroborate(table, max_bytes):
    jobs = table("TEL", [("03-1111-1111",), ("0311111111",), (None,), ("",)])
    rows = table("tel", [("（０３）1111-1111",), ("04",), (None,), ("",)])
    out = corroborate(rows, "tel", jobs, max_bytes=max_bytes)
    assert {r["tel"]: r["seen_in_jobs"] for r in out.collect()} == {
        "（０３）1111-1111": True, "04": False, None: False, "": False,
    }


def test_lookups_never_use_a_nested_loop(table):
    """Neither the names, the prefixes nor the area codes are compared row by row."""
    from meibo.operators.fill import fill_by_prefix

    rows = table("name tel area postal", [("a", "03", "x", None)])
    prefixes = table("prefix code", [("a", "1"), ("ab", "2")])
    for max_bytes in (0, 1 << 20):
        plans = [
            exclude_names(rows, "name", table("name", CHAINS), max_in_pattern=0, max_bytes=max_bytes),
            check_area_code(rows, "tel", "area", table("code area", AREAS), max_bytes=max_bytes),
            fill_by_prefix(rows, "postal", "name", prefixes, max_bytes=max_bytes),
        ]
        for plan in plans:
            text = plan._jdf.queryExecution().toString()
            assert "NestedLoop" not in text and "Cartesian" not in text
    small = fill_by_prefix(rows, "postal", "name", prefixes)
    assert "Exchange hashpartitioning" not in small._jdf.queryExecution().executedPlan().toString()


def test_very_long_and_many_names(table):
    long = "".join(chr(0x4E00 + i % 3000) for i in range(5000))
    rows = table("id name", [("1", f"a{long}b"), ("2", long[:-1]), ("3", "n77 x")])
    names = table("name", [(long,), *[(f"n{i}",) for i in range(1, 1002, 4)]])
    got = {r["id"]: r["reason"] for r in exclude_names(rows, "name", names).collect()}
    assert got == {"1": "chain", "2": None, "3": "chain"}


def test_long_lists_match_brute_force(spark, table, max_bytes):
    """Names and listed names of few letters, so that pieces are shared by many, and some listed names are short."""
    import random

    dice = random.Random(11)
    names = ["".join(dice.choice("abc ") for _ in range(dice.randrange(0, 14))) for _ in range(300)] + [None, "店", "東京店舗"]
    listed = ["".join(dice.choice("abc") for _ in range(dice.randrange(1, 9))) for _ in range(60)]
    listed = [x for x in listed if len(x) > 2] + ["店舗", "cc", " ", "", "abcabcabcabcabc"]
    rows = table("n", [(n,) for n in names])
    done = exclude_names(rows, "n", table("name", [(x,) for x in listed]), max_in_pattern=0, max_bytes=max_bytes)
    held = [" ".join(x.split()) for x in listed if x.strip()]
    for r in done.collect():
        plain = " ".join((r["n"] or "").split())
        assert (r["reason"] == "chain") == any(x in plain for x in held), r["n"]


def test_the_rarest_piece_of_a_listed_name(spark, table):
    from meibo.operators import exclude as E
    from meibo.operators.lookup import sized

    names = table("n", [(f"xxxx{i}",) for i in range(50)] + [("zxxxxq",), ("short",)])
    distinct = names.select(F.col("n").alias(E.NAME))
    listed = sized(table("l", [("xxxxq",), ("or",), ("absent",), ("xxxx",)]).select(F.col("l").alias(E.LISTED)))
    tries = E.name_pieces(distinct, [2, 4])
    got = {r[E.LISTED]: r[E.PART] for r in E.rare_pieces(tries, listed).collect()}
    assert got == {"xxxxq": "xxxq", "or": "or", "xxxx": "xxxx"}
