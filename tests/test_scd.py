import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillwise.operators.scd import scd1_upsert, scd2_merge, with_new_keys
from tillwise.schemas import OPEN_END

AS_OF = dt.date(2024, 3, 10)
OLD = dt.date(2020, 1, 1)
DIM = "key long, bk long, name string, city string, note string, valid_from date, valid_to date"
STAGE = "bk long, name string, city string, note string, date_add timestamp"


def merge(spark, stage, dim, as_of=AS_OF):
    return scd2_merge(
        spark.createDataFrame(stage, STAGE), spark.createDataFrame(dim, DIM), ["bk"], ["name", "city"], "key", as_of,
        carried=["note"], since="date_add",
    )


def test_all_transitions(spark):
    dim = [
        (1, 1, "same", None, "n", OLD, OPEN_END),
        (2, 2, "before", "x", "n", OLD, OPEN_END),
        (3, 3, "value", "x", "n", OLD, OPEN_END),
        (4, 4, None, "x", "n", OLD, OPEN_END),
        (5, 5, "gone", "x", "n", OLD, OPEN_END),
        (6, 6, "closed", "x", "n", OLD, dt.date(2021, 1, 1)),
        (7, 7, "carried", "x", "old note", OLD, OPEN_END),
    ]
    stage = [
        (1, "same", None, "n", None),
        (2, "after", "x", "n", None),
        (3, None, "x", "n", None),
        (4, "value", "x", "n", None),
        (6, "closed", "x", "n", None),
        (7, "carried", "x", "new note", None),
        (8, "new", "x", "n", dt.datetime(2022, 5, 6, 7, 8)),
        (9, "new", "x", "n", None),
    ]
    got = rows(merge(spark, stage, dim).select("bk", "key", "name", "valid_from", "valid_to", "note"), "bk", "valid_from")
    yesterday = dt.date(2024, 3, 9)
    first = dt.date(2000, 1, 1)
    assert got == [
        (1, 1, "same", OLD, OPEN_END, "n"),
        (2, 2, "before", OLD, yesterday, "n"),
        (2, None, "after", AS_OF, OPEN_END, "n"),
        (3, 3, "value", OLD, yesterday, "n"),
        (3, None, None, AS_OF, OPEN_END, "n"),
        (4, 4, None, OLD, yesterday, "n"),
        (4, None, "value", AS_OF, OPEN_END, "n"),
        (5, 5, "gone", OLD, OPEN_END, "n"),
        (6, None, "closed", first, OPEN_END, "n"),
        (6, 6, "closed", OLD, dt.date(2021, 1, 1), "n"),
        (7, 7, "carried", OLD, OPEN_END, "old note"),
        (8, None, "new", dt.date(2022, 5, 6), OPEN_END, "n"),
        (9, None, "new", first, OPEN_END, "n"),
    ]


def test_rerun_changes_nothing_and_two_changes_a_day_cross_over(spark):
    stage = [(1, "b", None, "n", None)]
    dim = [(1, 1, "a", None, "n", OLD, OPEN_END)]
    once = rows(with_new_keys(merge(spark, stage, dim), "key", 1), "key")
    twice = rows(merge(spark, stage, once), "key")
    assert once == twice
    again = rows(merge(spark, [(1, "c", None, "n", None)], once).select("name", "valid_from", "valid_to"), "name")
    assert again[1] == ("b", AS_OF, AS_OF - dt.timedelta(days=1))
    assert sum(valid_to == OPEN_END for *_, valid_to in again) == 1


def test_repeated_business_key_fails_the_load(spark):
    stage = [(1, "a", None, "n", None), (1, "b", None, "n", None)]
    with pytest.raises(Exception, match="not unique"):
        merge(spark, stage, []).collect()


def test_new_keys_are_unique_and_above_the_highest(spark):
    df = spark.range(1000).repartition(7).select(F.when(F.col("id") < 10, F.col("id")).alias("key"))
    keys = [k for (k,) in rows(with_new_keys(df, "key", 500))]
    assert len(set(keys)) == 1000 and sum(k > 500 for k in keys) == 990


def test_scd1_overwrites_in_place(spark):
    dim = spark.createDataFrame([(1, 10, "a", "g"), (2, 20, "b", "g"), (3, 30, "c", None)], "key long, bk long, name string, grp string")
    stage = spark.createDataFrame([(10, "a", "g"), (20, "bb", None), (40, "d", "h")], "bk long, name string, grp string")
    assert rows(scd1_upsert(stage, dim, ["bk"], ["name", "grp"], "key"), "bk") == [
        (1, 10, "a", "g"), (2, 20, "bb", None), (3, 30, "c", None), (None, 40, "d", "h")
    ]


def test_a_bucketed_dimension_stays_where_it_is(spark, tmp_path):
    from tillwise.plans import dimension_layout as layout
    from tillwise.plans.dimensions import ORDER_STATE
    from tillwise.schemas import OPEN_END, WAREHOUSE

    old = [(k + 100, k, f"state {k}", dt.date(2000, 1, 1), OPEN_END) for k in range(200)]
    dim = spark.createDataFrame(old, WAREHOUSE["dim_order_state"])
    stage = {"sg_order_state": spark.createDataFrame([(k, f"state {k}" if k % 9 else "new name") for k in range(50, 230)], "id_order_state long, name string")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        layout.save_current(dim, "states_in_buckets", ORDER_STATE, 6, str(tmp_path / "states"))
        assert layout.buckets_of(spark, "states_in_buckets") == 6
        got = layout.step(ORDER_STATE, stage.__getitem__, "states_in_buckets", dt.date(2024, 2, 1), spark)
        expected = ORDER_STATE.step(stage.__getitem__, dim, dt.date(2024, 2, 1))
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS states_in_buckets")
    # Only the stage rows are dealt.
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == 1


def test_versions_that_ended_before_a_period_are_not_opened(spark, tmp_path):
    from tillwise.plans import dimension_layout as layout
    from tillwise.plans.periods import period

    versions = [(k, dt.date(2000 + k % 20, 1, 1), dt.date(2001 + k % 20 + k % 3, 6, 30) if k % 4 else dt.date(9999, 12, 31)) for k in range(300)]
    table = spark.createDataFrame(versions, "customer_key long, valid_from date, valid_to date")
    layout.save_versions(table, str(tmp_path / "v"))
    kept = spark.read.parquet(str(tmp_path / "v"))
    for p in (period("year", "2010", as_of=dt.date(2024, 1, 1)), period("month", "2021-06", as_of=dt.date(2024, 1, 1))):
        got = layout.valid_in(kept, p)
        assert {r["customer_key"] for r in got.collect()} == {r["customer_key"] for r in table.filter(p.overlaps()).collect()}
        assert "PartitionFilters: [isnotnull(end_year" in got._jdf.queryExecution().executedPlan().toString()
