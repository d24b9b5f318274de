"""Exports that take little disk: packed files, staged rows that go, shuffle files that go."""

import os
import time

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from meibo.operators.staging import SHUFFLES_END, ending_shuffles, shared_dir, stage
from meibo.plans import catalogue as Q
from meibo.plans.delivery import DeliveryConfig, export, exported, run_delivery
from meibo.sources import csv as S


@pytest.fixture
def tables(spark, tmp_path):
    """A few order lines with their parts and suppliers; some lines come twice."""

    def written(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    kinds = ["ECONOMY", "LARGE", "SMALL", "PROMO", "STANDARD"]
    words = ["blue ring", "red rod", "large plate", "steel anvil"]
    written(
        "part",
        [(i, words[i % 4], f"Brand#{10 + i % 9}", kinds[i % 5], 1 + 7 * i % 50, 10.0 + i) for i in range(20)],
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    )
    written("supplier", [(i, f"S{i}", i % 25, 1.0) for i in range(10)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
    lines = [
        (i // 4, i % 20, i % 10, 1 + i % 7, float(1 + i % 50), 100.0 + i, i % 11 / 100, 0.0, "ANR"[i % 3], "O", None)
        for i in range(240)
    ]
    written(
        "lineitem",
        lines + lines[:9],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
        " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    )
    return str(tmp_path)


def folders(spark):
    root = shared_dir(spark).removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


ROWS = [(str(i), "二行\nの名" if i % 5 == 0 else f' "{i}" ', None if i % 3 else "") for i in range(300)]


def test_packed_files_are_small_bounded_and_read_alike(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PACKED_ROWS", 100)
    rows = table("no name note", ROWS * 2).coalesce(1)
    S.write_csv(rows, str(tmp_path / "plain"))
    S.write_csv(rows, str(tmp_path / "packed"), packed=True)
    plain, packed = ([p for p in (tmp_path / kind).iterdir() if p.name.startswith("part-")] for kind in ("plain", "packed"))
    assert {p.name[-7:] for p in packed} == {".csv.gz"} and len(packed) == 6 and len(plain) == 1
    assert 2 * sum(p.stat().st_size for p in packed) < plain[0].stat().st_size
    one, two = (S.read_csv(spark, str(tmp_path / kind), multi_line=True) for kind in ("plain", "packed"))
    assert rows_of(one) == rows_of(two) and two.count() == 600
    assert list(S.headers(spark, [str(tmp_path / "packed")]).values()) == [["no", "name", "note"]] * 6


def test_a_packed_export_is_the_same_export(spark, table, tmp_path):
    done = run_delivery(DeliveryConfig(rows=table("no name note", ROWS), key=["no"], branch_suffix="名"))
    export(done, str(tmp_path / "plain"), "2026-01-31")
    export(done, str(tmp_path / "packed"), "2026-01-31", packed=True)
    plain, packed = ({n: rows_of(df) for n, df in exported(spark, str(tmp_path / k), "2026-01-31").items()} for k in ("plain", "packed"))
    assert plain == packed and len(plain["log/excluded"]) == 60
    part = max((tmp_path / "packed" / "2026-01-31" / "result").glob("part-*.csv.gz"), key=lambda p: p.stat().st_size)
    part.write_bytes(part.read_bytes()[:-3])
    with pytest.raises(ValueError, match="rows of its manifest"):
        exported(spark, str(tmp_path / "packed"), "2026-01-31")


@pytest.mark.parametrize("name", ["delivery_export", "delivery_export_findings"])
def test_an_exporting_query_leaves_its_packed_export_alone(spark, tables, name):
    before = folders(spark)
    got = rows_of(Q.QUERIES[name](spark, tables))
    (left,) = folders(spark) - before
    assert left.startswith("export-")
    day = os.path.join(shared_dir(spark).removeprefix("file:"), left, "2026-01-01")
    parts = [f for top, _, files in os.walk(day) for f in files if f.startswith("part-") and "manifest" not in top]
    assert parts and all(f.endswith(".csv.gz") for f in parts)
    want = Q.QUERIES[name.replace("export", "job") if "findings" in name else "delivery_job"](spark, tables)
    assert got == rows_of(want) and got


def test_rows_of_a_delivery_are_staged_densely(spark, table):
    done = run_delivery(DeliveryConfig(rows=table("no name note", ROWS), key=["no"]))
    assert all(".zstd." in f or ".zst" in f for f in done.delivered.inputFiles())


def test_shuffle_files_go_when_their_query_ends(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    setting, before = spark.conf.get(SHUFFLES_END, None), files()
    dealt = spark.range(1000).repartition(7, F.col("id"))
    with ending_shuffles(spark):
        assert stage(dealt).count() == 1000
    assert spark.conf.get(SHUFFLES_END, None) == setting
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before


def test_lines_of_a_file_are_not_sent_through_python(spark, table, tmp_path, monkeypatch):
    """Spark goes on sending a file to a task that wants its first line only."""
    from pyspark.sql.classic.dataframe import DataFrame

    for i, packed in enumerate([False, True]):
        S.write_csv(table("x y", [("1", "2")] * 5000).repartition(3), str(tmp_path / f"in{i}"), packed=packed)
    (tmp_path / "in0" / "empty.csv").write_bytes(b"")
    (tmp_path / "in1" / "other.csv").write_bytes('﻿y,"a ""b"""\n1,2\n'.encode())
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda *_: pytest.fail("lines go through Python"))
    found = S.headers(spark, [str(tmp_path / "in0"), str(tmp_path / "in1")])
    assert sorted(map(tuple, found.values())) == [("x", "y")] * 6 + [("y", 'a "b"')]
    assert not any(path.endswith("empty.csv") for path in found)


def test_the_replay_deals_a_row_of_changes_and_packs_its_input(spark, tables):
    """The cells of a row are put together before they are dealt by key, not after."""
    before = folders(spark)
    replayed = Q.QUERIES["delivery_export_replay"](spark, tables)
    left = {name.split("-")[0]: name for name in folders(spark) - before}
    assert set(left) == {"export", "in"}
    source = os.path.join(shared_dir(spark).removeprefix("file:"), left["in"])
    assert all(f.endswith(".csv.gz") for f in os.listdir(source) if f.startswith("part-"))
    plan = replayed._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("partial_max") == 3 and "REPARTITION" not in plan
    kept = Q.QUERIES["delivery_job"](spark, tables).where("reason = 'delivered'")
    assert rows_of(replayed) == rows_of(kept.select(replayed.columns)) and replayed.count()
