from conftest import rows_of

from meibo.operators import lookup
from meibo.operators.fill import AS_NAME, AS_PHONE, build_index, fill_by_key, fill_by_prefix

ADDRESSES = [
    ("1", None, "東京都渋谷区神南１−２"),
    ("2", "", "東京都渋谷区恵比寿"),
    ("3", " 　", "東京都港区芝"),
    ("4", "999", "東京都渋谷区神南"),
    ("5", None, "大阪府"),
    ("6", None, None),
    ("7", None, "東京都渋谷区"),
    ("8", None, "　東京都渋谷区神南"),
    ("9", None, "東京"),
]
POSTAL = [
    ("東京都渋谷区", "150"),
    ("東京都渋谷区神南", "151"),
    ("東京都港区", "105"),
    ("東京都港区", "106"),
    ("東京都", "100"),
    ("東京都", "100"),
    ("", "000"),
    ("東京都渋谷区神南", " "),
    ("東京都渋谷区神南", None),
]


def test_longest_prefix_with_all_statuses(table, max_bytes):
    rows = table("id postal address", ADDRESSES)
    out = fill_by_prefix(rows, "postal", "address", table("prefix code", POSTAL), max_bytes=max_bytes)
    assert out.columns == ["id", "postal", "address", "fill_status"]
    got = {r["id"]: (r["postal"], r["fill_status"]) for r in out.collect()}
    assert got == {
        "1": ("151", "filled"),
        "2": ("150", "filled"),
        "3": (" 　", "ambiguous"),
        "4": ("999", "kept"),
        "5": (None, "no_match"),
        "6": (None, "no_match"),
        "7": ("150", "filled"),
        "8": ("151", "filled"),
        "9": (None, "no_match"),
    }


def test_more_lengths_than_probes(table, monkeypatch):
    monkeypatch.setattr(lookup, "MAX_PROBES", 1)
    rows = table("id postal address", ADDRESSES)
    out = fill_by_prefix(rows, "postal", "address", table("prefix code", POSTAL))
    assert sorted(r["fill_status"] for r in out.collect()).count("filled") == 4


def test_empty_reference(table, max_bytes):
    rows = table("id postal address", ADDRESSES)
    out = fill_by_prefix(rows, "postal", "address", table("prefix code", []), max_bytes=max_bytes)
    assert {r["fill_status"] for r in out.collect()} == {"kept", "no_match"}


JOBS = [
    ("山田商店", "03-1111-1111", "佐藤"),
    ("山田商店", "03-1111-1111", "佐藤"),
    ("山田商店", "03-2222-2222", "鈴木"),
    ("田中屋", "", "高橋"),
    ("", "06-3333-3333", "伊藤"),
    ("木村", "06-3333-3333", ""),
    ("二人", "04-4444-4444", "甲"),
    ("二人", "04-4444-4444", "乙"),
    ("別名", "04-4444-4444", "甲"),
]
COMPANIES = [
    ("both", "山田商店", "０３－１１１１－１１１１", None),
    ("phone", "よその名", "03(2222)2222", ""),
    ("name", "田中屋", "09-0000-0000", "　"),
    ("phone only", None, "0633333333", None),
    ("ambiguous pair", "二人", "0444444444", None),
    ("pair before phone", "別名", "04-4444-4444", None),
    ("ambiguous phone", "無い", "04-4444-4444", None),
    ("ambiguous name", "山田商店", None, None),
    ("kept", "山田商店", "03-1111-1111", "既存"),
    ("none", "無い", "00", None),
    ("blank key", "", "", None),
]
EXPECTED = {
    "both": ("佐藤", "filled"),
    "phone": ("鈴木", "filled"),
    "name": ("高橋", "filled"),
    "phone only": ("伊藤", "filled"),
    "ambiguous pair": (None, "ambiguous"),
    "pair before phone": ("甲", "filled"),
    "ambiguous phone": (None, "ambiguous"),
    "ambiguous name": (None, "ambiguous"),
    "kept": ("既存", "kept"),
    "none": (None, "no_match"),
    "blank key": (None, "no_match"),
}
JOB_TIERS = [{"名称": AS_NAME, "TEL": AS_PHONE}, {"TEL": AS_PHONE}, {"名称": AS_NAME}]
TIERS = [{"name": AS_NAME, "tel": AS_PHONE}, {"tel": AS_PHONE}, {"name": AS_NAME}]


def test_recruiter_tiers(table, max_bytes):
    index = build_index(table("名称 TEL 担当者", JOBS), JOB_TIERS, "担当者")
    rows = table("case name tel contact", COMPANIES)
    out = fill_by_key(rows, "contact", TIERS, index, max_bytes=max_bytes)
    assert out.columns == ["case", "name", "tel", "contact", "fill_status"]
    got = {r["case"]: (r["contact"], r["fill_status"]) for r in out.collect()}
    assert {k: (v[0] if v[1] != "ambiguous" else None, v[1]) for k, v in got.items()} == EXPECTED


def test_index_counts_values(table):
    index = build_index(table("名称 TEL 担当者", JOBS), [{"名称": AS_NAME}], "担当者")
    assert rows_of(index.select("n_values", "value")) == [
        (1, "甲"), (1, "高橋"), (2, "乙"), (2, "佐藤"),
    ]


def test_identical_rows_stay(table, max_bytes):
    rows = table("postal address", [(None, "東京都渋谷区")] * 50 + [(None, "千葉県")] * 7 + [("1", "x")] * 3)
    out = fill_by_prefix(rows, "postal", "address", table("prefix code", POSTAL), max_bytes=max_bytes)
    assert out.count() == 60
    assert {tuple(r) for r in out.groupBy("fill_status").count().collect()} == {
        ("filled", 50), ("no_match", 7), ("kept", 3),
    }
