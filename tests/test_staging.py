import os

import pytest

from meibo.operators.staging import discarding, new_path, shared_dir, stage


def folders(spark):
    root = shared_dir(spark).removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_a_block_leaves_only_what_was_named_outside(spark):
    outer = new_path(spark, "outer")
    before = folders(spark)
    with discarding(spark):
        first = stage(spark.range(3), "inner")
        with discarding(spark):
            stage(first, "deeper").write.parquet(outer)
        assert first.count() == 3
    assert folders(spark) - before == {os.path.basename(outer)}
    assert spark.read.parquet(outer).count() == 3
    with pytest.raises(OSError, match="lost"), discarding(spark):
        stage(spark.range(3), "inner")
        raise OSError("lost")
    assert folders(spark) - before == {os.path.basename(outer)}


def test_jobs_leave_no_staged_tables(spark, table, tmp_path):
    from meibo.plans.tools import exclude_chains, fill_postal_codes
    from meibo.sources.csv import read_csv, write_csv

    write_csv(table("n a p", [("x店", "東京都1", ""), ("chain y", "東京都2", ""), ("z", "", "")]), str(tmp_path / "in"))
    before = folders(spark)
    fill_postal_codes(spark, str(tmp_path / "in"), str(tmp_path / "out"), table("prefix code", [("東京都", "100")]), "p", "a")
    exclude_chains(spark, str(tmp_path / "in"), str(tmp_path / "split"), table("name", [("chain",)]), "n")
    assert folders(spark) == before
    assert read_csv(spark, str(tmp_path / "out")).where("p = '100'").count() == 2
    assert read_csv(spark, str(tmp_path / "split" / "kept")).count() == 1
