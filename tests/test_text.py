from pyspark.sql import functions as F

from meibo.functions import text as X


def value(spark, cell, fn):
    df = spark.createDataFrame([(cell,)], "c string")
    return df.select(fn(F.col("c")).alias("x")).first()[0]


def test_blank(spark):
    for cell in (None, "", " ", "　", " 　\t\n"):
        assert value(spark, cell, X.is_blank) is True
    for cell in ("0", " 店 ", "ー"):
        assert value(spark, cell, X.is_blank) is False


def test_trim_keeps_inner_space(spark):
    assert value(spark, "　渋谷 店　 ", X.trim_spaces) == "渋谷 店"
    assert value(spark, "　渋谷 　 店　 ", X.squeeze_spaces) == "渋谷 店"


def test_narrow(spark):
    assert value(spark, "ＡＢｃ１２３！～　カ", X.narrow_ascii) == "ABc123!~ カ"
    assert value(spark, "１２３ＡＢ", X.narrow_digits) == "123ＡＢ"
    assert value(spark, "plain", X.narrow_ascii) == "plain"


def test_hyphens_spare_the_long_vowel(spark):
    assert value(spark, "１−２‐３－４ スーパー", X.unify_hyphens) == "１-２-３-４ スーパー"


def test_digits(spark):
    assert value(spark, "（０３）１２３４－５６７８", X.digits) == "0312345678"
    assert value(spark, "03-1234-5678", X.digits) == "0312345678"
    assert value(spark, "なし", X.digits) is None
    assert value(spark, None, X.digits) is None


def test_match_text(spark):
    assert value(spark, "　東京都　１−２ ", X.match_text) == "東京都 1-2"
    assert value(spark, "　", X.match_text) is None


def test_hyphenate_postal(spark):
    assert value(spark, "１５００００１", X.hyphenate_postal) == "150-0001"
    assert value(spark, " 150-0001 ", X.hyphenate_postal) == "150-0001"
    assert value(spark, "150-000", X.hyphenate_postal) == "150-000"
    assert value(spark, "150-0001x", X.hyphenate_postal) == "150-0001x"
    assert value(spark, None, X.hyphenate_postal) is None


def test_controls(spark):
    assert value(spark, "﻿渋​谷\u0007", X.strip_controls) == "渋谷"


def test_half_width_kana(spark):
    assert value(spark, "ﾔﾏﾀﾞ商店ﾊﾟﾝ･ｺｰﾋｰ", X.widen_kana) == "ヤマダ商店パン・コーヒー"
    assert value(spark, "ヤマダ abc", X.widen_kana) == "ヤマダ abc"
    assert value(spark, None, X.widen_kana) is None


def test_spellings_for_matching(table):
    cells = [("ﾏｸﾄﾞﾅﾙﾄﾞ", "マクドナルド"), ("STAR　 Bucks", "star bucks"), ("a\u0001b", "ab"), ("Ａ－１", "a-1"), (" \u0001", None)]
    rows = table("c want", cells)
    assert all(r[0] == r[1] for r in rows.select(X.match_text(F.col("c")), "want").collect())


def test_phones(table):
    cells = [("+81-3-1234-5678", "0312345678"), ("＋８１ (0)3 1234", "031234"), ("03-1/06-2", "031"), ("tel. 03-1、06-2", "031"), ("なし", None)]
    rows = table("c want", cells)
    assert all(r[0] == r[1] for r in rows.select(X.digits(F.col("c")), "want").collect())


def test_a_spelling_names_its_cell_a_few_times(spark):
    """The plan of one match_text stays small, so chains of it do not multiply."""
    import re

    plan = spark.range(1).select(X.match_text(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    found = {f: len(re.findall(rf"\b{f}\(", plan)) for f in ("replace", "translate", "regexp_replace", "lower")}
    assert found["replace"] <= 1 and found["translate"] <= 4 and found["regexp_replace"] <= 1 and found["lower"] <= 2


def test_decomposed_katakana_are_composed(spark):
    texts = ["バス", "ﾊﾞｽ", "バス", "ﾊ゙ｽ", "ポスト", "ン゙"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "c string").select(X.match_text(F.col("c"))).collect()]
    assert got == ["バス"] * 4 + ["ポスト", "ン゙"]
