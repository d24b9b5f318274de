"""Addresses in different spellings, ranges of numbers, area lists and near names."""

import pytest
from conftest import rows_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meibo.functions.address import address_text, read_numerals
from meibo.functions.text import company_text
from meibo.operators.area import check_area_of_address
from meibo.operators.fill import (
    AS_COMPANY,
    AS_NAME,
    AS_PHONE,
    build_index,
    fill_by_key,
    fill_by_near_name,
    fill_by_prefix,
    near_index,
)
from meibo.sources.reference import number_ranges, read_area_list, read_postal_ref


def each(spark, function, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r["x"] for r in rows.select("i", function(F.col("c")).alias("x")).orderBy("i").collect()]


def test_numerals_are_read_where_they_count(spark):
    texts = {
        "三重県四日市市一丁目二十三番": "三重県四日市市1丁目23番",
        "北一条西十二丁目": "北1条西12丁目",
        "八王子市二十丁目百五番地": "八王子市20丁目105番地",
        "千代田区一〇丁目二三番": "千代田区10丁目23番",
        "十文字町": "十文字町",
        "百十番": "110番",
        "三番町六号": "3番町6号",
        "百二丁目": "102丁目",
        "plain 1-2": "plain 1-2",
        None: None,
        "": "",
    }
    assert each(spark, read_numerals, list(texts)) == list(texts.values())


def test_one_spelling_for_an_address(spark):
    same = [
        ["東京都千代田区霞が関一丁目2番3号", "東京都千代田区霞ヶ関１丁目２番３号", "東京都千代田区霞ケ関1丁目2番3"],
        ["桜町1-2-3", "桜町１－２－３", "桜町 1ー2ー3".replace(" ", "")],
        ["長岡市大字小国町", "長岡市小国町", "長岡市字小国町"],
        ["神戸市三ノ宮", "神戸市三の宮"],
        ["札幌市北一条西二丁目", "札幌市北1条西2丁目"],
    ]
    for group in same:
        assert len(set(each(spark, address_text, group))) == 1, group
    other = each(spark, address_text, ["桜町1丁目", "桜町11丁目", "桜町1番", None, " 　"])
    assert len(set(other[:3])) == 3 and other[3:] == [None, None]
    assert each(spark, address_text, ["Hot Anvil  SMALL 12"]) == ["hot anvil small 12"]


def test_remarks_are_read_as_ranges(spark):
    texts = {
        "１～５、７丁目": [("block", 1, 5), ("block", 7, 7)],
        "１丁目、３～５番地": [("block", 1, 1), ("lot", 3, 5)],
        "１００番地以上": [("lot", 100, None)],
        "９９番地以下": [("lot", None, 99)],
        "５００〜５９９": [("lot", 500, 599)],
        "その他": [("rest", None, None)],
        "次のビルを除く": [("rest", None, None)],
        "１階": [("part", None, None)],
        "甲、乙": [("part", None, None)] * 2,
        "": [(None, None, None)],
    }
    got = each(spark, number_ranges, list(texts))
    assert [[tuple(x) for x in g] for g in got] == list(texts.values())


REF = [
    ("桜町", "A", "block", 1, 9), ("桜町", "B", "block", 10, 27), ("桜町", "C", "rest", None, None),
    ("梅町", "D", "lot", 1, 499), ("梅町", "E", "lot", 500, None),
    ("松町", "F", "block", 1, 5), ("松町", "G", "block", 4, 8), ("松町", "H", "part", None, None),
    ("竹町", "I", None, None, None), ("竹町", "J", None, None, None),
    ("杉町", "K", "block", 1, 3),
    ("桜町二丁目", "Z", None, None, None),
]


def test_ranges_decide(spark, max_bytes):
    ref = spark.createDataFrame(REF, "prefix string, code string, kind string, low int, high int")
    want = {
        "桜町1丁目2番": ("A", "filled"),
        "桜町九丁目": ("A", "filled"),
        "桜町10-3": ("B", "filled"),
        "桜町２７丁目": ("B", "filled"),
        "桜町28丁目": ("C", "filled"),
        "桜町": (None, "ambiguous"),
        "桜町5番地": ("C", "filled"),
        "桜町二丁目5": ("Z", "filled"),
        "桜町2-5": ("Z", "filled"),
        "桜町2": ("Z", "filled"),
        "桜町 3": ("A", "filled"),
        "梅町499": ("D", "filled"),
        "梅町五百番地": ("E", "filled"),
        "梅町1丁目500番地": ("E", "filled"),
        "梅町99999999": ("E", "filled"),
        "梅町3-600": ("D", "filled"),
        "松町3": ("F", "filled"),
        "松町4丁目": (None, "ambiguous"),
        "松町6丁目": ("G", "filled"),
        "松町9丁目": (None, "ambiguous"),
        "竹町1丁目": (None, "ambiguous"),
        "杉町7丁目": ("K", "filled"),
        "柳町1": (None, "no_match"),
    }
    rows = spark.createDataFrame([(a, None, 7) for a in want], "address string, postal string, value int")
    got = fill_by_prefix(rows, "postal", "address", ref, max_bytes=max_bytes)
    assert got.columns == ["address", "postal", "value", "fill_status"]
    assert {r["address"]: (r["postal"], r["fill_status"]) for r in got.collect()} == want


def brute_pieces(ranges, n):
    return {v for low, high, v in ranges if low <= n <= high}


def test_every_number_meets_its_ranges(spark):
    import random

    dice = random.Random(3)
    ranges = [tuple(sorted((dice.randrange(1, 200), dice.randrange(1, 200)))) + (f"v{dice.randrange(6)}",) for _ in range(12)]
    ref = spark.createDataFrame([("町", v, "lot", a, b) for a, b, v in ranges] + [("町", "x", "part", None, None)], "prefix string, code string, kind string, low int, high int")
    rows = spark.createDataFrame([(n, f"町{n}番地", None) for n in range(1, 210)], "n int, address string, postal string")
    for r in fill_by_prefix(rows, "postal", "address", ref).collect():
        held = brute_pieces(ranges, r["n"])
        want = (held.pop(), "filled") if len(held) == 1 else (None, "ambiguous")
        assert (r["postal"], r["fill_status"]) == want, r["n"]


POSTAL = '13101,"100  ","{code}","ﾄｳｷﾖｳﾄ","ﾁﾖﾀﾞｸ","ﾏﾁ","東京都","千代田区","{town}",0,0,0,0,0,0'


def postal_file(tmp_path, towns):
    path = tmp_path / "postal.csv"
    path.write_text("\n".join(POSTAL.format(code=c, town=t) for c, t in towns) + "\n", encoding="utf-8")
    return str(path)


def test_postal_file_with_ranges(spark, tmp_path):
    path = postal_file(tmp_path, [("1000001", "大手町（１～３丁目）"), ("1000002", "大手町（その他）"), ("1000003", "丸の内")])
    ref = read_postal_ref(spark, path, ranges=True)
    assert rows_of(ref.where("prefix like '千代田区%'")) == sorted(
        [("千代田区大手町", "1000001", "block", 1, 3), ("千代田区大手町", "1000002", "rest", None, None), ("千代田区丸の内", "1000003", None, None, None)],
        key=repr,
    )
    rows = spark.createDataFrame([("東京都千代田区大手町二丁目3", ""), ("千代田区大手町9-1", None), ("千代田区丸ノ内1", " ")], "a string, p string")
    done = fill_by_prefix(rows, "p", "a", ref)
    assert [r["p"] for r in done.collect()] == ["1000001", "1000002", "1000003"]
    assert rows_of(read_postal_ref(spark, path).where("prefix = '千代田区大手町'")) == [("千代田区大手町", "1000001"), ("千代田区大手町", "1000002")]


@pytest.mark.parametrize("line", ["1,2,3", POSTAL.format(code="1000001", town="町") + ",16", ",".join(["code"] * 15)])
def test_rows_that_do_not_fit_stop_the_postal_scan(spark, tmp_path, line):
    path = tmp_path / "postal.csv"
    path.write_text(POSTAL.format(code="1000001", town="町") + "\n" + line + "\n", encoding="utf-8")
    with pytest.raises(PySparkException, match="does not fit|not a postal code"):
        read_postal_ref(spark, str(path)).collect()


AREAS = """番号区画コード,番号区画,市外局番,市内局番
1,"北海道札幌市、江別市(一部を除く。)",11,CDE
2,"北海道夕張市、空知郡(南幌町、長沼町に限る。)",123,DE
3,"東京都(特別区に限る。)",３,CDEF
4,"東京都府中市、調布市(入間町(二丁目に限る。)を除く。)、狛江市",42,CDE
5,"広島県府中市",847,DE
6,"東京都府中市",0423,DE
"""


def test_area_list_in_the_public_layout(spark, tmp_path):
    path = tmp_path / "areas.csv"
    path.write_text(AREAS, encoding="utf-8")
    ref = read_area_list(spark, str(path))
    got = {(r["code"], r["place"]) for r in ref.collect()}
    assert got == {
        (code, place)
        for code, prefecture, names in [
            ("011", "北海道", ["札幌市", "江別市"]),
            ("0123", "北海道", ["夕張市", "空知郡南幌町", "空知郡長沼町"]),
            ("03", "東京都", [""]),
            ("042", "東京都", ["府中市", "調布市", "狛江市"]),
            ("0847", "広島県", ["府中市"]),
            ("0423", "東京都", ["府中市"]),
        ]
        for name in names
        for place in (name, prefecture + name)
        if place
    }
    want = {
        ("011-222-3333", "北海道札幌市中央区北一条西2丁目"): "ok",
        ("0123-45-678", "札幌市中央区"): "mismatch",
        ("(0123)45-6789", "空知郡長沼町１丁目"): "ok",
        ("03-1234-5678", "東京都千代田区丸の内1-1"): "ok",
        ("03-1234-5678", "東京都調布市"): "mismatch",
        ("0423-11-1111", "東京都府中市宮西町"): "ok",
        ("042-311-1111", "東京都府中市宮西町"): "ok",
        ("0847-11-1111", "府中市元町"): "ok",
        ("0847-11-1111", "東京都府中市宮西町"): "mismatch",
        ("090-1111-2222", "札幌市"): "no_area",
        ("0999-1-2", "札幌市"): "unknown_code",
        ("011-222-3333", "どこか"): "unknown_place",
        ("011-222-3333", None): "unknown_place",
        (None, "札幌市"): None,
    }
    rows = spark.createDataFrame(list(want), "tel string, address string")
    for limit in (0, 1 << 20):
        done = check_area_of_address(rows, "tel", "address", ref, max_bytes=limit)
        assert {(r["tel"], r["address"]): r["verdict"] for r in done.collect()} == want


def test_company_names_without_their_form(spark):
    same = ["株式会社 山田商店", "山田商店株式会社", "(株)山田商店", "（株）山田商店", "㈱山田商店", "山田 商店", "山田商店㈲"]
    assert set(each(spark, company_text, same)) == {"山田商店"}
    latin = ["Acme Trading Co., Ltd.", "ACME TRADING", "acme trading co.,ltd", "Acme Trading, Inc.", "ＡＣＭＥ　Ｔｒａｄｉｎｇ"]
    assert set(each(spark, company_text, latin)) == {"acmetrading"}
    assert each(spark, company_text, ["株式会社", None, " ", "Cooper", "incline"]) == [None, None, None, "cooper", "incline"]


JOBS = [
    ("株式会社東西商事", "03-1", "佐藤"), ("北山製作所", "03-2", "鈴木"), ("北川製作所", "03-3", "高橋"),
    ("南海運輸(有)", "03-4", "田中"), ("南海運輸", "03-5", "伊藤"), ("中央印刷所", "03-6", "渡辺"), ("三角", "03-7", "山本"),
    ("aabbcc", "03-8", "x"),
]


def test_near_names(spark, max_bytes):
    jobs = spark.createDataFrame(JOBS, "`名称` string, TEL string, `担当者` string")
    want = {
        ("東西商事", None): ("佐藤", "filled_near"),  # another legal form only
        ("㈱東西商社", None): ("佐藤", "filled_near"),  # one character changed
        ("東西商", None): (None, "no_match"),  # too short to be looked up
        ("東西商事部", None): ("佐藤", "filled_near"),  # one more
        ("中央印刷", None): ("渡辺", "filled_near"),  # one less
        ("北村製作所", None): (None, "ambiguous"),  # two neighbours
        ("北山製作所", None): ("鈴木", "filled"),  # an exact name has no neighbours
        ("南海輸運", None): (None, "no_match"),  # two changes
        ("南海運送", None): (None, "ambiguous"),  # one neighbour with two contacts
        ("三山", None): (None, "no_match"),
        ("aabcc", None): ("x", "filled_near"),
        ("abbcc", None): ("x", "filled_near"),
        ("北山製作所x", "いる"): ("いる", "kept"),
        (None, None): (None, "no_match"),
    }
    rows = spark.createDataFrame(list(want), "name string, contact string")
    exact = build_index(jobs, [{"名称": AS_NAME}], "担当者")
    done = fill_by_key(rows, "contact", [{"name": AS_NAME}], exact, max_bytes=max_bytes)
    done = fill_by_near_name(done, "contact", "name", near_index(jobs, "名称", "担当者"), max_bytes=max_bytes)
    assert done.columns == ["name", "contact", "fill_status"]
    got = {r["name"]: (r["contact"], r["fill_status"]) for r in done.collect()}
    assert got == {name: answer for (name, _), answer in want.items()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


def test_neighbours_match_brute_force(spark):
    import random

    dice = random.Random(8)
    names = sorted({"".join(dice.choice("abc") for _ in range(dice.randrange(4, 7))) for _ in range(60)})
    asked = sorted({"".join(dice.choice("abc") for _ in range(dice.randrange(4, 8))) for _ in range(120)})
    jobs = spark.createDataFrame([(n, f"c{i % 7}") for i, n in enumerate(names)], "name string, contact string")
    rows = spark.createDataFrame([(a, None, "no_match") for a in asked], "name string, contact string, fill_status string")
    done = fill_by_near_name(rows, "contact", "name", near_index(jobs, "name", "contact", AS_COMPANY))
    contact = {n: f"c{i % 7}" for i, n in enumerate(names)}
    for r in done.collect():
        near = [r["name"]] if r["name"] in contact else [n for n in names if distance(r["name"], n) == 1]
        want = (None, "no_match") if not near else (contact[near[0]], "filled_near") if len(near) == 1 else (None, "ambiguous")
        assert (r["contact"], r["fill_status"]) == want, r["name"]


def test_phones_and_company_names_share_an_index(spark):
    jobs = spark.createDataFrame(JOBS, "`名称` string, TEL string, `担当者` string")
    tiers = [{"名称": AS_COMPANY, "TEL": AS_PHONE}, {"名称": AS_COMPANY}]
    rows = spark.createDataFrame([("南海運輸（有）", "03-5", ""), ("(有)南海運輸", None, "")], "n string, t string, c string")
    done = fill_by_key(rows, "c", [{"n": AS_COMPANY, "t": AS_PHONE}, {"n": AS_COMPANY}], build_index(jobs, tiers, "担当者"))
    assert [(r["c"], r["fill_status"]) for r in done.collect()] == [("伊藤", "filled"), ("", "ambiguous")]
