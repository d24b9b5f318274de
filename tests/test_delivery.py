import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from meibo.functions import checks as C
from meibo.functions import text as X
from meibo.operators.audit import auto_fix, check, fix_log, remember
from meibo.operators.rules import apply_rules
from meibo.plans.delivery import DeliveryConfig, export, judge, run_delivery
from meibo.sources.csv import read_csv

RULES = [
    ("A", "name", "exclude_suffix", "x"),
    ("A", "age", "min", "18"),
    ("A", "age", "min", "18"),
    ("B", "name", "required", None),
    ("B", "age", "max", "60"),
    ("B", "name", "exclude_contains", "bad"),
    ("C", "name", "exclude_prefix", "no"),
    ("C", "name", "exclude_value", "me"),
    ("C", "name", "max_length", "4"),
]
PEOPLE = [
    ("1", "A", "ax", "10", "exclude_suffix"),
    ("2", "A", "a", "10", "min"),
    ("3", "A", "a", "18", None),
    ("4", "A", "a", "none", "min"),  # no number at all breaks a bound
    ("5", "B", " 　", "99", "max"),
    ("6", "B", "", "20", "required"),
    ("7", "B", "xbadx", "20", "exclude_contains"),
    ("8", "B", "x", None, None),
    ("9", "C", "no one", "1", "exclude_prefix"),
    ("10", "C", "me", "1", "exclude_value"),
    ("11", "C", "longer", "1", "max_length"),
    ("12", "D", "no one", "1", None),
    ("13", None, "no one", "1", None),
]


def test_rules(table, max_bytes):
    rows = table("id customer name age want", PEOPLE)
    out = apply_rules(rows, "customer", table("customer column op arg", RULES), max_bytes=max_bytes)
    assert out.count() == len(PEOPLE)
    assert [(r["id"], r["reason"]) for r in out.collect() if r["reason"] != r["want"]] == []


def test_rules_compare_normalised_cells_and_numbers(table):
    rules = [("A", "age", "min", "１８"), ("A", "name", "exclude_suffix", "店"), ("B", "name", "exclude_value", "ﾏｸﾄﾞ")]
    people = [
        ("A", "x", "１０", "min"), ("A", "x", "20", None), ("A", "x", "old", "min"), ("A", "x", " ", None),
        ("A", "渋谷店　", "20", "exclude_suffix"), ("B", "マクド", None, "exclude_value"),
    ]
    rows = table("customer name age want", people)
    out = apply_rules(rows, "customer", table("customer column op arg", rules)).collect()
    assert len(out) == len(people) and all(r["reason"] == r["want"] for r in out)


@pytest.mark.parametrize("op, arg", [("exclude_contains", ""), ("exclude_prefix", "　"), ("exclude_suffix", None), ("min", "x"), ("max_length", "")])
def test_rules_that_cannot_be_meant_are_refused(table, op, arg):
    rows = table("customer name", [("A", "x")])
    with pytest.raises(Exception, match="a rule needs a"):
        apply_rules(rows, "customer", table("customer column op arg", [("A", "name", op, arg)])).collect()


def test_thousands_of_rules_are_one_join(table):
    rules = table("customer column op arg", [("A", "name", "exclude_contains", f"n{i}") for i in range(3000)])
    out = apply_rules(table("customer name", [("A", "xn2999"), ("A", "y")]), "customer", rules)
    assert rows_of(out) == sorted([("A", "xn2999", "exclude_contains"), ("A", "y", None)], key=repr)
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 1


def test_no_rules(table):
    rows = table("customer", [("A",)])
    assert rows_of(apply_rules(rows, "customer", table("customer column op arg", []))) == [("A", None)]


def test_unknown_op_and_column(table):
    rows = table("customer", [("A",)])
    for rule in [("A", "customer", "guess", "1"), ("A", "nowhere", "min", "1"), ("A", None, "min", "1")]:
        with pytest.raises(ValueError, match="unknown op or column"):
            apply_rules(rows, "customer", table("customer column op arg", [rule]))


def test_fixes_and_log(table):
    rows = table("id name tel", [("1", " a ", "０３"), ("2", "b", "03"), ("3", None, "x"), ("4", "-", "y")])
    fixes = {"name": [X.trim_spaces, X.null_if("-")], "tel": [X.narrow_digits, X.replace("x", "z")]}
    fixed = auto_fix(remember(rows, ["name", "tel"]), fixes)
    log = fix_log(fixed, ["id"], ["name", "tel"])
    assert rows_of(log) == sorted([
        ("1", "name", " a ", "a"), ("1", "tel", "０３", "03"), ("3", "tel", "x", "z"), ("4", "name", "-", None),
    ], key=repr)
    with pytest.raises(ValueError, match="nowhere"):
        auto_fix(rows, {"nowhere": [X.trim_spaces]})


def test_checks(table):
    rows = table("id tel n kind", [
        ("1", "03-1", "5", "a"), ("2", "", "x", "b"), ("3", "03\n", "99", None), ("4", "03", None, "a"),
    ])
    found = check(rows, ["id"], [
        C.required("tel"), C.matches("tel", "[0-9-]+"), C.in_range("n", 1, 10),
        C.max_length("tel", 3), C.one_of("kind", ["a"]),
    ])
    assert rows_of(found) == sorted([
        ("1", "tel", "length", "03-1"), ("2", "tel", "required", ""), ("2", "n", "range", "x"),
        ("2", "kind", "value", "b"), ("3", "tel", "pattern", "03\n"), ("3", "n", "range", "99"),
    ], key=repr)


COLUMNS = "customer name address postal tel area contact"
ROWS = [
    ("A", " 本屋　", "東京都渋谷区神南", None, "０３-1111", "東京", "佐藤"),
    ("A", "渋谷店", "東京都", "100", "03-2222", "東京", ""),
    ("A", "すきや大阪", "大阪府", "", "06-1", "大阪", None),
    ("A", "禁止店", "大阪府", "", "06-1", "大阪", None),
    ("B", "花屋", "東京都渋谷区", "　", "06-1", "東京", None),
    ("B", "花屋", "東京都渋谷区", "　", "06-1", "東京", None),
    (None, None, None, None, None, None, None),
]


def config(table, max_bytes):
    return DeliveryConfig(
        rows=table(COLUMNS, ROWS),
        fixes={"name": [X.trim_spaces], "tel": [X.narrow_digits]},
        rules=table("customer column op arg", [("A", "name", "exclude_prefix", "禁止")]),
        chains=table("name", [("すきや",)]),
        postal_ref=table("prefix code", [("東京都渋谷区", "150"), ("東京都渋谷区神南", "151")]),
        area_ref=table("code area", [("03", "東京"), ("06", "大阪")]),
        jobs=table("TEL", [("061",)]),
        checks=[C.required("postal")],
        max_bytes=max_bytes,
    )


def test_delivery(table, max_bytes):
    cfg = config(table, max_bytes)
    done = run_delivery(cfg)
    assert rows_of(done.delivered.select("name", "postal", "tel")) == sorted([
        ("本屋", "151", "03-1111"), ("花屋", "150", "06-1"), ("花屋", "150", "06-1"), (None, None, None),
    ], key=repr)
    assert rows_of(done.excluded.select("name", "postal", "reason")) == sorted([
        ("渋谷店", "100", "branch"), ("すきや大阪", "", "chain"), ("禁止店", "", "exclude_prefix"),
    ], key=repr)
    assert done.delivered.columns == ["row_id", *COLUMNS.split()]
    assert rows_of(done.log.drop("row_id")) == sorted([
        ("name", " 本屋　", "本屋"), ("postal", None, "151"), ("tel", "０３-1111", "03-1111"),
        ("postal", "　", "150"), ("postal", "　", "150"),
    ], key=repr)
    assert rows_of(done.findings.select("column_name", "check_name", "value", "seen_in_jobs")) == sorted([
        ("postal", "required", None, False),
        ("tel", "area_code_mismatch", "06-1", True), ("tel", "area_code_mismatch", "06-1", True),
    ], key=repr)


def test_replaying_the_log_on_the_input_gives_the_output(table):
    cfg = config(table, 1 << 20)
    done = run_delivery(cfg)
    cells = ROWS  # createDataFrame keeps the order within its slices, so row ids follow it
    ids = sorted(r["row_id"] for r in cfg.rows.select(F.monotonically_increasing_id().alias("row_id")).collect())
    by_id = {i: dict(zip(COLUMNS.split(), row, strict=True)) for i, row in zip(ids, cells, strict=True)}
    for change in done.log.collect():
        assert by_id[change["row_id"]][change["column_name"]] == change["before_value"]
        by_id[change["row_id"]][change["column_name"]] = change["after_value"]
    for row in done.excluded.collect():
        assert by_id.pop(row["row_id"]) == {c: row[c] for c in COLUMNS.split()}
    assert {i: tuple(r.values()) for i, r in by_id.items()} == {r[0]: tuple(r[1:]) for r in done.delivered.collect()}


def test_outputs_carry_the_key_that_the_caller_names(table):
    cfg = config(table, 1 << 20)
    rows = [(str(i), *row) for i, row in enumerate(ROWS)]
    cfg.rows, cfg.key = table(f"no {COLUMNS}", rows), ["no"]
    done = run_delivery(cfg)
    assert done.log.columns[0] == done.findings.columns[0] == done.excluded.columns[0] == done.delivered.columns[0] == "no"
    assert {r["no"] for r in done.excluded.collect()} == {"1", "2", "3"}
    cfg.key = ["name"]
    with pytest.raises(ValueError, match="no stable key"):
        run_delivery(cfg)


def test_steps_without_reference_data_are_left_out(table):
    done = run_delivery(DeliveryConfig(rows=table(COLUMNS, ROWS), branch_suffix=None))
    assert rows_of(done.delivered.drop("row_id")) == sorted(ROWS, key=repr)
    assert done.excluded.count() == done.log.count() == done.findings.count() == 0


def test_export(spark, table, tmp_path):
    done = run_delivery(config(table, 1 << 20))
    export(done, str(tmp_path), "2026-01-31")
    day = tmp_path / "2026-01-31"
    assert rows_of(read_csv(spark, str(day / "result")).select("postal")) == [("150",), ("150",), ("151",), (None,)]
    assert read_csv(spark, str(day / "log" / "excluded")).count() == 3
    assert read_csv(spark, str(day / "log" / "fixes")).count() == 5
    assert read_csv(spark, str(day / "log" / "findings")).count() == 3


def test_odd_column_names(table, max_bytes):
    """Headers with dots, spaces, brackets and backticks reach every operator."""
    columns = ["No.", "会社 (名)", "住.所", "郵`便", "T.EL", "地 域"]
    spark = table("x", []).sparkSession
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)
    rows = spark.createDataFrame([("1", " 本屋", "東京都", None, "03", "東京"), ("2", "y店", "x", "1", "03", "z")], schema)
    cfg = DeliveryConfig(
        rows=rows, fixes={"会社 (名)": [X.trim_spaces]}, customer="No.",
        rules=table("customer column op arg", [("9", "住.所", "required", "")]),
        name="会社 (名)", chains=table("name", [("z",)]), postal="郵`便", address="住.所",
        postal_ref=table("prefix code", [("東京", "1")]), tel="T.EL", area="地 域",
        area_ref=table("code area", [("03", "大阪")]), jobs=table("TEL", [("03",)]),
        checks=[C.max_length("住.所", 1)], max_bytes=max_bytes,
    )
    done = run_delivery(cfg)
    assert rows_of(done.delivered.drop("row_id")) == [("1", "本屋", "東京都", "1", "03", "東京")]
    assert rows_of(done.excluded.drop("row_id")) == [("2", "y店", "x", "1", "03", "z", "branch")]
    assert done.log.count() == 2 and done.findings.count() == 2


def test_small_references_leave_the_rows_where_they_are(table):
    """The job is one chain of map-side joins; its only exchanges are broadcasts of references."""
    plan = judge(config(table, 1 << 20))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    for shape in ("SortMergeJoin", "ShuffledHashJoin", "NestedLoop", "Cartesian", "SinglePartition"):
        assert shape not in plan
    # The distinct area codes are the one aggregate, below a broadcast.
    assert plan.count("Exchange hashpartitioning") <= 1


def test_names_of_added_columns_are_refused(table):
    with pytest.raises(ValueError, match="Reason"):
        run_delivery(DeliveryConfig(rows=table("name Reason", [("a", "b")])))


@pytest.mark.parametrize("max_bytes", [0, 2**26])
@pytest.mark.parametrize("op", ["exclude_value", "exclude_prefix", "exclude_suffix", "exclude_contains"])
def test_many_texts_of_a_customer_are_joined(table, op, max_bytes):
    texts = [f"T{i}Ｂ" if i % 2 else f"é{i}" for i in range(300)]
    rules = [("A", "name", op, t) for t in texts] + [("C", "name", op, "c1"), ("A", "tel", "required", ""), (None, "name", op, "x")]
    cells = ["t7b", "Ｔ７Ｂ", "é8", "t7", "t7b x", "x t7b", "x t9b x", "é", "x", "c1", " ", None, "t999b"]
    rows = table("customer name tel", [(c, x, t) for c in ("A", "B", "C", None) for x in cells for t in ("1", None)])
    test = {"exclude_value": str.__eq__, "exclude_prefix": str.startswith, "exclude_suffix": str.endswith, "exclude_contains": str.__contains__}[op]

    def want(customer, cell, tel):
        mine = {"A": [t.lower().replace("ｂ", "b") for t in texts], "C": ["c1"]}.get(customer, [])
        plain = (cell or "").strip().lower().replace("Ｔ７Ｂ".lower(), "t7b")
        if plain and any(test(plain, t) for t in mine):
            return op
        return "required" if customer == "A" and tel is None else None

    out = apply_rules(rows, "customer", table("customer column op arg", rules), max_bytes=max_bytes)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "array_contains" not in plan and "exists(" not in plan and "collect_set" not in plan
    got = [(r["customer"], r["name"], r["tel"], r["reason"]) for r in out.collect()]
    assert len(got) == 4 * len(cells) * 2
    assert [g for g in got if g[3] != want(*g[:3])] == []


def wide_config(table, **options):
    rows = table(f"{COLUMNS} extra1 extra2 key", [(*r, "e", "f", str(i)) for i, r in enumerate(ROWS)])
    return DeliveryConfig(
        rows=rows,
        fixes={"name": [X.squeeze_spaces], "tel": [X.narrow_digits, X.unify_hyphens]},
        rules=table("customer column op arg", [("A", "name", "exclude_prefix", "禁")]),
        chains=table("name", [("すきや",)]),
        postal_ref=table("prefix code", [("東京都渋谷区", "1500000"), ("大阪府", "5300000")]),
        area_ref=table("code area", [("03", "東京"), ("06", "大阪")]),
        jobs=table("TEL", [("03-1111",)]),
        **options,
    )


@pytest.mark.parametrize("unique", [True, False])
def test_large_tables_are_answered_by_narrow_rows(table, monkeypatch, unique):
    """Whatever the number of lookups, whole rows are joined once, and staged once where the key tells them apart."""
    from meibo.operators import lookup
    from meibo.plans import delivery as D

    wide = []

    def spy(module):
        real = module.stage

        def staged(df, label="stage"):
            if "extra1" in df.columns:
                wide.append(label)
            return real(df, label)

        monkeypatch.setattr(module, "stage", staged)

    for module in (D, lookup):
        spy(module)
    options = {"key": ["key"], "key_is_unique": True} if unique else {}
    small = [rows_of(x.drop("row_id")) for x in run_delivery(wide_config(table, **options))]
    assert wide == ["delivery"]
    large = [rows_of(x.drop("row_id")) for x in run_delivery(wide_config(table, max_bytes=0, **options))]
    assert wide[1:] == (["delivery"] if unique else ["delivery-rows", "delivery"])
    assert small == large


def test_phones_are_checked_against_the_address(table, max_bytes):
    cfg = wide_config(table, key=["key"], max_bytes=max_bytes)
    cfg.area_ref = table("code place", [("03", "東京都"), ("06", "大阪府")])
    found = run_delivery(cfg).findings
    assert {r["value"] for r in found.where("check_name = 'area_code_mismatch'").collect()} == {"06-1"}


def test_a_broken_export_is_repeated(spark, table, tmp_path, monkeypatch):
    from meibo.plans import delivery as D

    done = run_delivery(wide_config(table, key=["key"]))
    export(done, str(tmp_path / "whole"), "2026-01-31")
    want = {name: rows_of(df) for name, df in D.exported(spark, str(tmp_path / "whole"), "2026-01-31").items()}
    assert set(want) == {"result", "log/fixes", "log/excluded", "log/findings"}
    root = str(tmp_path / "out")

    def broken(*_):
        raise OSError("lost")

    for name in ("write_logs", "write_csv", "move"):
        with monkeypatch.context() as patch:
            patch.setattr(D, name, broken)
            with pytest.raises(OSError, match="lost"):
                export(done, root, "2026-01-31")
        assert not (tmp_path / "out" / "2026-01-31").exists()
    export(done, root, "2026-01-31")
    assert {name: rows_of(df) for name, df in D.exported(spark, root, "2026-01-31").items()} == want
    with pytest.raises(ValueError, match="is there already"):
        export(done, root, "2026-01-31")
    assert sorted(p.name for p in (tmp_path / "out" / "2026-01-31").iterdir() if not p.name.startswith(".")) == ["log", "manifest", "result"]
    part = next((tmp_path / "out" / "2026-01-31" / "result").glob("part-*"))
    part.with_name("part-of-another-run.csv").write_bytes(part.read_bytes() + b",".join([b"x"] * len(want["result"][0])) + b"\n")
    with pytest.raises(ValueError, match="rows of its manifest"):
        D.exported(spark, root, "2026-01-31")


def test_small_tables_cost_a_join_each(spark, table):
    """Few rules are compared where the rows lie, without a join."""
    cfg = wide_config(table)
    plan = judge(cfg)._jdf.queryExecution().sparkPlan().toString()
    assert "exists(" not in plan
    # Two lengths of prefixes, the codes, their areas, the phones.
    assert plan.count("BroadcastHashJoin") == 5


def test_an_export_is_checked_by_its_files(spark, table, tmp_path, monkeypatch):
    """Its rows are not read for that, and a file that lost its end is found."""
    from pyspark.sql.classic.dataframe import DataFrame

    from meibo.plans import delivery as D

    export(run_delivery(wide_config(table, key=["key"])), str(tmp_path), "2026-01-31")
    with monkeypatch.context() as patch:
        patch.setattr(DataFrame, "count", lambda self: pytest.fail("rows are counted"))
        D.exported(spark, str(tmp_path), "2026-01-31")
    part = max((tmp_path / "2026-01-31" / "result").glob("part-*"), key=lambda p: p.stat().st_size)
    part.write_bytes(part.read_bytes()[:-3])
    with pytest.raises(ValueError, match="rows of its manifest"):
        D.exported(spark, str(tmp_path), "2026-01-31")


@pytest.mark.parametrize("wide", [0, 30])
@pytest.mark.parametrize("long_list", [False, True])
def test_large_tables_leave_the_rows_staged_once(table, monkeypatch, wide, long_list):
    """No lookup writes the rows anew: it takes its keys from their one copy. Both for rows that take the answers
    as they are and for wide ones, with copies of a key and with a list of names too long for a pattern."""
    from meibo.operators import exclude, lookup, rules
    from meibo.plans import delivery as D

    def made(max_bytes):
        cfg = wide_config(table, max_bytes=max_bytes)
        cells = [(*r, "e", "f", str(i % 3)) for i, r in enumerate(ROWS * 3)]
        cfg.rows = table(f"{COLUMNS} extra1 extra2 key", cells)
        cfg.rows = cfg.rows.select("*", *[F.lit("w").alias(f"w{i}") for i in range(wide)])
        if long_list:
            cfg.chains = table("name", [("すきや",), *[(f"x{i}",) for i in range(1001)]])
        return cfg

    small = [rows_of(x) for x in run_delivery(made(2**26))]
    staged = []
    for module in (D, lookup, exclude, rules):
        real = module.stage

        def spy(df, label="stage", real=real):
            if "row_id" in df.columns:
                staged.append(label)
            return real(df, label)

        monkeypatch.setattr(module, "stage", spy)
    large = [rows_of(x) for x in run_delivery(made(0))]
    assert staged == ["delivery-rows", "delivery"]
    assert small == large and len(small[0]) == 12


def test_rows_that_the_steps_mostly_read_are_not_joined_to_themselves(table):
    cfg = wide_config(table, max_bytes=0)
    plan = judge(cfg)._jdf.queryExecution().analyzed().toString()
    assert plan.count("delivery-rows") <= 1 and "meibo:row_id" not in plan
