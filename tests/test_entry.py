import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)


def test_reference_queries_plan_and_have_stable_schemas(spark):
    for name, q in entry.queries().items():
        if not name.startswith("op") and name != "pipeline":
            assert q(spark, SF).columns, name
    for name in ("windowed_record", "merge_fixture_orientation", "match_history_rows", "day_ledger"):
        q = entry.queries()[name]
        assert q(spark, SF).schema == q(spark, SF).schema, name
