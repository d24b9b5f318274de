import pytest
from conftest import rows_of

from meibo.operators import kept_index as K
from meibo.operators.fill import AS_NAME, AS_PHONE, build_index, fill_by_key

TIERS = [{"name": AS_NAME, "tel": AS_PHONE}, {"tel": AS_PHONE}]
A = [("x", "1", "p"), ("x", "1", "p"), ("y", "2", "q"), (None, "3", "r"), ("z", None, "s")]
B = [("x", "1", "p"), ("y", "2", "other"), ("w", "4", "t"), ("v", "5", None)]


@pytest.fixture
def jobs(spark):
    return lambda rows: spark.createDataFrame(rows, "name string, tel string, contact string")


def rebuilt(jobs, *batches):
    return rows_of(build_index(jobs([r for b in batches for r in b]), TIERS, "contact"))


def test_batches_add_up_to_a_rebuild(spark, jobs, tmp_path):
    def opened():
        return K.KeptIndex(spark, str(tmp_path / "index"), TIERS, "contact", buckets=3)

    index = opened()
    assert index.table().count() == 0 and index.batches() == []
    assert index.add("a", jobs(A)) and not index.add("a", jobs(B))
    assert rows_of(index.table()) == rebuilt(jobs, A)
    index.compact()
    assert rows_of(opened().table()) == rebuilt(jobs, A)
    # A second batch of files updates the compacted index.
    assert opened().add("b", jobs(B))
    assert rows_of(opened().table()) == rebuilt(jobs, A, B)
    index.compact()
    index.compact()
    assert rows_of(opened().table()) == rebuilt(jobs, A, B) and index.batches() == ["a", "b"]
    # A batch is taken back after it was compacted.
    assert index.take_back("a") and not index.take_back("a") and not index.take_back("nothing")
    assert rows_of(index.table()) == rebuilt(jobs, B) and index.batches() == ["b"]
    index.compact()
    assert rows_of(opened().table()) == rebuilt(jobs, B)
    with pytest.raises(ValueError, match="not a name"):
        index.add("a/b", jobs(A))


def test_a_broken_batch_or_base_does_not_count(spark, jobs, tmp_path):
    index = K.KeptIndex(spark, str(tmp_path), TIERS, "contact", buckets=2)
    index.add("a", jobs(A))
    jobs(B).selectExpr("name as key", "contact as value", "1L as n").write.parquet(str(tmp_path / "deltas" / "b"))
    (tmp_path / "deltas" / "b" / "_SUCCESS").unlink()
    (tmp_path / "base" / "7" / "pairs").mkdir(parents=True)
    assert rows_of(index.table()) == rebuilt(jobs, A)
    index.compact()
    assert rows_of(index.table()) == rebuilt(jobs, A)
    assert index.add("b", jobs(B))
    index.compact()
    assert rows_of(index.table()) == rebuilt(jobs, A, B)


def test_a_fill_does_not_shuffle_the_kept_index(spark, jobs, tmp_path):
    index = K.KeptIndex(spark, str(tmp_path), TIERS, "contact", buckets=4)
    index.add("a", jobs([(f"n{i}", str(i), f"c{i % 9}") for i in range(400)]))
    index.compact()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(10).selectExpr("concat('1\u0001', id, '\u0001') as key")
        plan = rows.join(index.table(), "key")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = jobs([("n7", "7", None), ("other", "8", ""), ("n9", None, None)])
    done = fill_by_key(rows, "contact", TIERS, index.table())
    assert [(r["contact"], r["fill_status"]) for r in done.collect()] == [("c7", "filled"), ("c8", "filled"), (None, "no_match")]
