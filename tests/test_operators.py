import datetime as dt
import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillwise.operators.calendar import date_frame, time_frame
from tillwise.operators.facts import delete_where, incremental_append, rejected
from tillwise.operators import joins
from tillwise.operators.joins import attach, dealt_left_join, fanout_left_join, hot_keys, key_hash
from tillwise.operators.listing import filtered, last_page, page_count, page_rows
from tillwise.operators.lookup import calendar_keys, lookup_key
from tillwise.operators.median import exact_median
from tillwise.operators.ordering import number_rows
from tillwise.operators.reconcile import reconcile
from tillwise.operators.trend import linear_trend
from tillwise.schemas import WAREHOUSE
from tillwise.sources.csv_export import csv_page, export_csv


def test_calendar_frames(spark):
    days = date_frame(spark)
    assert days.schema.names == WAREHOUSE["dim_date"].names
    assert days.count() == 11323
    assert rows(days.filter("date = DATE '2021-01-03'")) == [
        (7674, dt.date(2021, 1, 3), 2021, 1, 1, "January", 3, 7, "Sunday", 53, True)
    ]
    hours = rows(time_frame(spark), "time_key")
    assert len(hours) == 24 and hours[0] == (1, "00:00:00", 0) and hours[-1] == (24, "23:00:00", 23)


def _money(spark, values):
    return spark.createDataFrame([(None if v is None else Decimal(str(v)),) for v in values], "v decimal(20,6)")


@pytest.mark.parametrize(
    "values",
    [
        [], [None], [5], [1, 2], [3, 1, 2], [-1.5, 2.25, None], [7] * 1000 + [1, 9],
        [0.000001, 0.000002], ["-0.000001", "99999999999999.999999"], ["-99999999999999.5", -3, 4.5],
    ],
)
def test_exact_median_small(spark, values):
    got = exact_median(_money(spark, values), "v", "m").first()[0]
    known = [Decimal(str(v)) for v in values if v is not None]
    assert got == (statistics.median(known) if known else None)


def test_exact_median_against_brute_force(spark):
    draw = random.Random(7)
    values = [round(draw.choice([-1, 1]) * draw.lognormvariate(5, 3), 6) for _ in range(2001)] + [12.5] * 1500
    got = exact_median(_money(spark, values), "v", "m").first()[0]
    assert got == statistics.median(Decimal(str(v)) for v in values)


def test_exact_median_scans_once(spark, tmp_path):
    path = str(tmp_path / "values")
    _money(spark, [1, 2, 3, 4]).write.parquet(path)
    median = exact_median(spark.read.parquet(path), "v", "m")
    assert median.collect()[0][0] == Decimal("2.5")
    final = median._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1


def test_linear_trend(spark):
    assert linear_trend(spark.createDataFrame([], "p string, y double"), "p", "y").collect() == []
    assert rows(linear_trend(spark.createDataFrame([("a", 5.0)], "p string, y double"), "p", "y")) == [("a", 5.0, 5.0)]
    line = linear_trend(spark.createDataFrame([("b", 3.0), ("a", 1.0), ("c", 8.0)], "p string, y double"), "p", "y")
    assert [(p, round(v, 6)) for p, _, v in rows(line, "p")] == [("a", 0.5), ("b", 4.0), ("c", 7.5)]


def test_attach_matches_plain_left_join_with_hot_and_missing_keys(spark):
    draw = random.Random(3)
    keys = [1] * 900 + [None] * 300 + [draw.randint(2, 400) for _ in range(700)] + [77777] * 200
    left = spark.createDataFrame([(k, i % 50) for i, k in enumerate(keys)], "k long, x long")
    right = spark.createDataFrame([(k, f"v{k}", None if k == 5 else k * 2) for k in range(300)], "k long, a string, b long")
    got = attach(left, right, ["k"])
    assert rows(got, "k", "x", "a", "b") == rows(left.join(right, "k", "left").select("k", "x", "a", "b"), "k", "x", "a", "b")
    by_hash = dict(rows(left.select(key_hash(["k"]), "k").distinct()))
    assert {by_hash[h] for (h,) in rows(hot_keys(left, ["k"], 0.05))} == {1, 77777}
    assert rows(hot_keys(left.limit(0), ["k"])) == []


def test_attach_on_two_columns(spark):
    left = spark.createDataFrame([(1, 1), (1, 2), (1, None), (2, 1)], "a long, b long")
    right = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "a long, b long, v string")
    assert sorted(rows(attach(left, right, ["a", "b"])), key=str) == sorted(
        [(1, 1, "x"), (1, 2, None), (1, None, None), (2, 1, "y")], key=str
    )


def test_fanout_left_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    right = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "k long, w int")
    expected = rows(left.join(right, "k", "left").select("k", "v", "w"), "v", "w")
    assert rows(fanout_left_join(left, right, ["k"]), "v", "w") == expected


def test_dealt_left_join_shares_the_rows_to_be_made(spark, monkeypatch):
    """The same rows as the fan-out join, and no task makes most of them, though few are read and one key has most."""
    lefts = [("hot" if i < 40 else f"k{i % 5}", i) for i in range(60)] + [(None, 70), ("alone", 71), ("hot", 3)]
    rights = [("hot" if i < 50 else f"k{i % 6}", i if i % 9 else None) for i in range(80)] + [(None, 5), ("hot", 3), ("other", 4)]
    left, right = spark.createDataFrame(lefts, "k string, v int"), spark.createDataFrame(rights, "k string, w int")
    want = rows(fanout_left_join(left, right, ["k"]), "k", "v", "w")
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    made = dealt_left_join(left, right, ["k"], (left.select("k"), right.select("k")))
    assert made.columns == ["k", "v", "w"] and rows(made, "k", "v", "w") == want
    tasks = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) < len(want) / 3 and len(tasks) > 5


def test_lookup_prefers_current_then_highest_key(spark):
    dim = spark.sql(
        "SELECT * FROM VALUES (1, 10, DATE '2020-01-01'), (2, 10, DATE '9999-12-31'), (9, 10, DATE '2021-01-01'), "
        "(3, 20, DATE '2020-01-01'), (4, 20, DATE '2021-01-01') AS t(key, bk, valid_to)"
    )
    df = spark.createDataFrame([(10,), (20,), (30,), (None,)], "id long")
    current = dict(rows(lookup_key(df, dim, {"id": "bk"}, "key", "sk")))
    assert current == {10: 2, 20: None, 30: None, None: None}
    any_version = dict(rows(lookup_key(df, dim, {"id": "bk"}, "key", "sk", current_only=False)))
    assert any_version == {10: 2, 20: 4, 30: None, None: None}


def test_calendar_keys_use_utc_and_zero(spark):
    df = spark.sql(
        "SELECT TIMESTAMP '2000-01-02 23:59:00' AS t UNION ALL SELECT NULL UNION ALL "
        "SELECT TIMESTAMP '1999-12-31 05:00:00' UNION ALL SELECT TIMESTAMP '2000-01-03 00:30:00+02:00'"
    )
    got = rows(calendar_keys(df, "t", date_frame(spark), time_frame(spark)).select("date_sk", "time_sk", "date_month"))
    assert sorted(got) == [(0, 0, 0), (0, 6, 0), (2, 23, 200001), (2, 24, 200001)]


def test_incremental_append_keeps_repeats(spark):
    stage = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    fact = spark.createDataFrame([(2,)], "k long")
    assert rows(incremental_append(stage, fact, ["k"])) == [(1, "a"), (1, "a")]


def test_incremental_append_with_hot_and_missing_keys(spark):
    keys = [1] * 700 + [2] * 500 + [None] * 20 + list(range(10, 3000))
    stage = spark.createDataFrame([(k, 5, f"v{i % 9}") for i, k in enumerate(keys)], "a long, b long, v string")
    fact = spark.createDataFrame([(k, 5) for k in [2] * 300 + list(range(0, 3000, 3))], "a long, b long")
    expected = stage.join(fact, ["a", "b"], "left_anti").select("a", "b", "v")
    got = incremental_append(stage, fact, ["a", "b"])
    assert rows(got, "a", "b", "v") == rows(expected, "a", "b", "v")


def test_rejected_and_delete(spark):
    df = spark.createDataFrame([(1, 5, 6), (2, None, 6), (3, 5, None)], "id long, a long, b long")
    assert rows(rejected(df, ["a", "b"]).select("id", "missing_key"), "id") == [(2, "a"), (3, "b")]
    assert rows(delete_where(df, F.col("a") == 5).select("id")) == [(2,)]


def test_reconcile_reports_each_kind(spark):
    source = spark.createDataFrame(
        [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (4, "d", None), (4, "d", None), (6, None, 1.0)],
        "id long, name string, v double",
    )
    fact = spark.createDataFrame(
        [(1, "a", 1.0), (2, "x", None), (4, "d", None), (5, "e", 5.0), (5, "e", 5.0), (6, None, 1.0)],
        "id long, name string, v double",
    )
    got = rows(reconcile(source, fact, ["id"], ["name", "v"]), "id", "field")
    assert got == [
        (2, "different", "name", "b", "x", 1),
        (2, "different", "v", "2.0", None, 1),
        (3, "missing", None, None, None, 1),
        (4, "missing", None, None, None, 1),
        (5, "unexpected", None, None, None, 2),
    ]


def test_reconcile_since_high_water_mark(spark):
    source = spark.createDataFrame([(2, "b")], "id long, name string")
    fact = spark.createDataFrame([(10, 1, "old"), (11, 2, "b")], "key long, id long, name string")
    assert rows(reconcile(source, fact, ["id"], ["name"], since=("key", 10))) == []


def test_listing(spark):
    df = spark.createDataFrame(
        [(i, i % 3, None if i == 4 else f"job{i % 2}") for i in range(1, 12)], "id long, user_id long, name string"
    )
    page = page_rows(df, page=2, page_size=4)
    assert [r[0] for r in rows(page)] == [7, 6, 5, 4]
    assert rows(page_rows(df, "name", "desc", 1, 1))[0][0] == 4
    assert rows(page_rows(df, "name", "asc", 3, 5))[-1][0] == 4
    assert rows(page_count(df, 4)) == [(11, 3)]
    assert filtered(df, [("name", "like", "b1"), ("id", "<=", 5)]).count() == 3
    assert filtered(df, [("name", "like", "o_1")]).count() == 6
    assert filtered(df, [("id", ">", 9)], user_id=1).count() == 1
    assert [last_page(n, 10) for n in (0, 1, 10, 11)] == [0, 1, 1, 2]
    for bad in ([("nope", "=", 1)], [("id", "!=", 1)]):
        with pytest.raises(ValueError):
            filtered(df, bad)
    with pytest.raises(ValueError):
        page_rows(df, page=0)


def test_number_rows_and_csv_pages(spark, tmp_path):
    data = [(i, f"n,{i}", None if i % 7 == 0 else i * 1.5) for i in range(103)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "id long, name string, v double").repartition(5)
    numbered = rows(number_rows(df, [F.desc("id")], "n").select("n", "id"), "n")
    assert numbered == [(n + 1, 102 - n) for n in range(103)]
    order = [F.desc("id")]
    export = export_csv(df, str(tmp_path / "out"), order, block_rows=10)
    assert (export.total_rows, export.columns) == (103, ["id", "name", "v"])
    for page in (1, 3, 8, 15):
        got, last = csv_page(spark, export, order, page, 7)
        first = 102 - (page - 1) * 7
        assert last == 15
        assert rows(got) == [
            (i, f"n,{i}", None if i % 7 == 0 else i * 1.5) for i in range(first, max(first - 7, -1), -1)
        ]


def test_csv_export_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "id long")
    export = export_csv(df, str(tmp_path / "none"), [F.asc("id")])
    got, last = csv_page(spark, export, [F.asc("id")])
    assert (export.total_rows, last, rows(got)) == (0, 0, [])
