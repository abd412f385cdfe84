"""State kept beside the facts: bitmaps of ids, carts per day, maintained sums, loads of what is new, checksums."""

import datetime as dt
import random
import re
import shutil
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillwise.operators import checksums
from tillwise.operators.calendar import date_frame, time_frame
from tillwise.operators.id_bitmaps import count_ids, id_bitmaps, merged, not_in
from tillwise.operators.reconcile import reconcile
from tillwise.plans import cart_days, fact_loads, increments, maintained, reconciliation, reports
from tillwise.plans.periods import period
from tillwise.plans.warehouse import Warehouse
from tillwise.registry.inputs import CALENDAR_END, CALENDAR_START

AS_OF = dt.date(2024, 2, 1)
EDGES = [0, 1, -1, 32767, 32768, 32769, 65536, 65537, -32767, -32768, -32769, 1 << 40, -(1 << 40), 8, 7, 9]


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# Bitmaps of ids


def test_ids_out_of_order_and_repeated(spark):
    rng = random.Random(3)
    loaded = EDGES + [rng.randint(-(10**6), 10**6) for _ in range(3000)]
    loaded += loaded[:500] + [None, None]
    rng.shuffle(loaded)
    asked = EDGES + [rng.randint(-(10**6), 10**6) for _ in range(3000)] + loaded[:300] + [2, 2, None, None]
    known = id_bitmaps(spark.createDataFrame([(i,) for i in loaded], "id long").repartition(5), "id")
    got = not_in(spark.createDataFrame([(i, k) for k, i in enumerate(asked)], "id long, id_bits int"), "id", known)
    assert got.columns == ["id", "id_bits"]
    expected = Counter((i, k) for k, i in enumerate(asked) if i is None or i not in set(loaded))
    assert Counter(rows(got)) == expected
    assert rows(count_ids(known.unionByName(known), "n")) == [(len(set(loaded) - {None}),)]


def test_no_ids(spark):
    nothing = id_bitmaps(spark.createDataFrame([], "id long"), "id")
    assert rows(count_ids(nothing, "n")) == [(0,)]
    assert rows(not_in(spark.createDataFrame([(1,), (None,)], "id long"), "id", nothing), "id") == [(None,), (1,)]


def test_bitmaps_of_parts_merge(spark):
    ids = spark.range(1, 100_001).withColumn("part", F.col("id") % 7)
    whole, parts = id_bitmaps(ids, "id"), merged(id_bitmaps(ids, "id", "part"))
    assert rows(parts, "id_bucket") == rows(whole, "id_bucket") and whole.count() == 4


def test_known_rows_are_found_without_shuffling_the_fact(spark):
    stage = {"sg_order_history": spark.createDataFrame([(i, 1, 2, dt.datetime(2024, 1, 1)) for i in (5, 3, 3, 70_000)], "id_order_history long, id_order long, id_order_state long, date_add timestamp")}
    fact = spark.range(0, 50_000).select(F.col("id").alias("orderhistoryid_bk"), F.lit(1).alias("orderid_bk"), F.lit(2).alias("orderstateid_bk")).filter("orderhistoryid_bk <> 3")
    states = spark.createDataFrame([], "orderstate_key long, orderstateid_bk long, valid_to date")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = fact_loads.order_history_rows(stage.__getitem__, fact, states, date_frame(spark), time_frame(spark))
        plan = plan_of(new)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["orderhistoryid_bk"] for r in new.collect()) == [3, 3, 70_000]
    dealt = set(re.findall(r"hashpartitioning\((\w+)", plan))
    assert "orderhistoryid_bk" not in dealt and dealt & {"_groupingexpression", "id_bucket", "_bucket"}


# Carts per day


@pytest.fixture(scope="module")
def calendar(spark):
    return date_frame(spark, CALENDAR_START, CALENDAR_END), time_frame(spark)


def warehouse(calendar, **tables):
    generated = {"dim_date": calendar[0], "dim_time": calendar[1]}
    return Warehouse({**generated, **tables}.__getitem__, CALENDAR_START)


def day_key(day):
    return (day - CALENDAR_START).days + 1


def test_carts_of_any_period(spark, calendar):
    rng = random.Random(8)
    first = day_key(dt.date(2023, 11, 1))
    lines = [(rng.choice([1, 2, 3, 32768, 32769, None, rng.randint(1, 10**6)]), first + rng.randint(0, 150)) for _ in range(3000)]
    fact = spark.createDataFrame(lines, "cartid_bk long, date_sk long")
    dw = warehouse(calendar, fact_cart_line=fact)
    half = [cart_days.cart_days(fact.filter(F.col("date_sk") % 2 == k)) for k in (0, 1)]
    state = half[0].unionByName(half[1]).unionByName(half[0])
    for p in (
        period("year", "2024", as_of=AS_OF), period("quarter", "2023-4", as_of=AS_OF), period("month", "2024-02", as_of=AS_OF),
        period("range", start="2023-12-24", end="2024-01-06", as_of=AS_OF), period(as_of=AS_OF), period("year", "1999", as_of=AS_OF),
    ):
        assert rows(cart_days.carts_count(state, dw, p)) == rows(reports.carts_count(dw, p))


# Maintained sums


class Changing:
    """Rows of the three facts, changed at random; every withdrawal names a row that is there."""

    SCHEMAS = {
        "orders": "orderid_bk long, date_sk long, time_sk long, paid_tax_incl decimal(20,6), carrier string",
        "history": "orderid_bk long, date_sk long, orderstateid_bk long",
        "lines": "orderid_bk long, product_sk long, amount_tax_incl decimal(20,6)",
    }

    def __init__(self, spark, seed):
        self.spark, self.rng, self.rows = spark, random.Random(seed), {name: [] for name in self.SCHEMAS}

    def _row(self, name):
        rng, order = self.rng, self.rng.randint(1, 60)
        day = day_key(dt.date(2024, 1, 1)) + rng.randint(-40, 90)
        return {
            "orders": (order, day, rng.randint(1, 24), Decimal(rng.randint(0, 9999)) / 100, rng.choice(["A", "B", None])),
            "history": (order, day, rng.choice([2, 2, 18])),
            "lines": (order, rng.randint(1, 9), Decimal(rng.randint(0, 9999)) / 100),
        }[name]

    def batch(self, added, withdrawn):
        frames = []
        for name, schema in self.SCHEMAS.items():
            new = [self._row(name) for _ in range(added)]
            pool = self.rows[name] + new  # also rows that came in the same batch
            gone = self.rng.sample(pool, min(withdrawn, len(pool)))
            self.rows[name] = list((Counter(pool) - Counter(gone)).elements())
            frames.append(maintained.weighted(*[self.spark.createDataFrame(r, schema) for r in (new, gone)]))
        return maintained.Facts(*frames)

    def facts(self):
        return {name: self.spark.createDataFrame(self.rows[name], schema) for name, schema in self.SCHEMAS.items()}


def test_sums_follow_batches_with_withdrawals(spark, calendar):
    shop = Changing(spark, 5)
    first = shop.batch(120, 0)
    views = maintained.loaded(first)
    facts = first
    products = spark.createDataFrame([(k, f"M{k % 4}", f"G{k % 3}" if k % 3 else None) for k in range(1, 10)], "product_key long, manufacturer string, market_group string")
    for number in range(4):
        now = shop.facts()
        dw = warehouse(calendar, dim_product=products, fact_order=now["orders"], fact_order_history=now["history"], fact_order_line=now["lines"])
        views = {v: spark.createDataFrame(df.collect(), df.schema) for v, df in views.items()}
        year, month = period("year", "2024", as_of=AS_OF), period("month", "2024-01", as_of=AS_OF)
        for name in ("orders_count", "orders_paid", "period_revenue", "period_revenue_trend", "orders_heatmap", "carrier_revenue", "top_manufacturers", "market_group_revenue", "market_group_share"):
            p = (year, month)[number % 2]
            assert rows(getattr(maintained, name)(views, dw, p)) == rows(getattr(reports, name)(dw, p)), (number, name)
        assert rows(maintained.heatmap_matrix(views, dw, year)) == rows(reports.heatmap_matrix(dw, year))
        assert all(df.filter(F.col(maintained.VIEWS[v][1][0]) == 0).isEmpty() for v, df in views.items())
        batch = shop.batch(30, 40)
        views, facts = maintained.applied(views, maintained.changes(facts, batch)), facts.plus(batch)


def test_views_of_one_figure_alone(spark, calendar):
    """A figure needs no other views than its own, and none is made."""
    shop = Changing(spark, 7)
    first, batch = shop.batch(60, 0), shop.batch(20, 30)
    every = maintained.applied(maintained.loaded(first), maintained.changes(first, batch))
    for view in maintained.VIEWS:
        alone = maintained.loaded(first, [view])
        alone = maintained.applied(alone, maintained.changes(first, batch, [view]))
        assert list(alone) == [view]
        assert Counter(rows(alone[view])) == Counter(rows(every[view]))


def test_withdrawing_everything_leaves_nothing(spark):
    shop = Changing(spark, 6)
    first = shop.batch(40, 0)
    views = maintained.loaded(first)
    last = shop.batch(0, 40)
    assert all(df.isEmpty() for df in maintained.applied(views, maintained.changes(first, last)).values())


# Loads of what is new


class Stop(Exception):
    pass


@pytest.fixture(scope="module")
def shop(spark, calendar):
    def stage(orders):
        tables = {
            "sg_orders": spark.createDataFrame(
                [(o, o + 7, 1, 5 if o % 2 else None, dt.datetime(2024, 1, 1 + o % 20, o % 24), Decimal(o), Decimal(o), Decimal(1), "C" if o % 3 else "", "P") for o in orders],
                "id_order long, id_cart long, id_customer long, id_address_delivery long, date_add timestamp, total_paid_tax_incl decimal(20,6), total_paid_tax_excl decimal(20,6), conversion_rate decimal(20,6), carrier string, payment string",
            ),
            "sg_order_detail": spark.createDataFrame(
                [(o, o * 10 + k, 3, 0, k, Decimal(1), Decimal(2), Decimal(3), Decimal(4), Decimal(20)) for o in orders for k in (2, 1)],
                "id_order long, id_order_detail long, product_id long, product_attribute_id long, product_quantity int, unit_price_tax_excl decimal(20,6), unit_price_tax_incl decimal(20,6), total_price_tax_excl decimal(20,6), total_price_tax_incl decimal(20,6), tax_rate decimal(20,6)",
            ),
        }
        return tables.__getitem__

    open_end = dt.date(9999, 12, 31)
    product = spark.createDataFrame([(30, 3, 0, open_end)], "product_key long, productid_bk long, productattributeid_bk long, valid_to date")
    customer = spark.createDataFrame([(10, 1, open_end)], "customer_key long, customerid_bk long, valid_to date")
    address = spark.createDataFrame([(50, 5, open_end)], "address_key long, addressid_bk long, valid_to date")
    return stage, [product, customer, address, *calendar]


def content(tables):
    return [rows(tables.fact(n).drop(k), *[c for c in tables.fact(n).columns if c != k]) for n, k in (("fact_order_line", "orderline_key"), ("fact_order", "order_key"))]


def load(tables, stage, dims):
    return increments.load_order_lines(tables, stage, *dims), increments.load_orders(tables)


def test_a_load_reads_only_what_is_new(spark, shop, tmp_path):
    stage, dims = shop
    tables = increments.Increments(spark, str(tmp_path))
    assert load(tables, stage(range(1, 6)), dims) == (10, 5)
    lines, last = increments.new_lines(tables)
    assert (lines.count(), last, lines.inputFiles()) == (0, 1, [])
    assert load(tables, stage(range(1, 6)), dims) == (0, 0)
    assert load(tables, stage([9, 2, 7, 1]), dims) == (4, 2)
    assert load(tables, stage(range(1, 6)), dims) == (0, 0)
    lines, orders = tables.fact("fact_order_line"), tables.fact("fact_order")
    assert (lines.count(), orders.count()) == (14, 7)
    assert lines.select("orderline_key").distinct().count() == 14 and orders.select("order_key").distinct().count() == 7
    increments.load_order_lines(tables, stage([50]), *dims)
    fresh, last = increments.new_lines(tables)
    assert {f"load={last}" in f for f in fresh.inputFiles()} == {True} and fresh.count() == 2


def test_stage_rows_meet_few_known_ids_without_a_shuffle(spark, tmp_path, monkeypatch):
    tables = increments.Increments(spark, str(tmp_path))
    assert tables.ids("fact_order") is None
    for load, ids in enumerate(([1, 40_000], [2, 3, 40_001]), 1):
        made = spark.createDataFrame([(i,) for i in ids], "orderid_bk long")
        tables.write("fact_order_ids", load, id_bitmaps(made, "orderid_bk"))
        tables.finish("fact_order", load)
    stage = spark.createDataFrame([(i,) for i in (1, 2, 4, 4, 40_001, 70_000, None)], "orderid_bk long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, plans = [], []
        for most in (increments.BROADCAST_BITMAPS, 1):
            monkeypatch.setattr(increments, "BROADCAST_BITMAPS", most)
            new = not_in(stage, "orderid_bk", tables.ids("fact_order"))
            plans.append(new._jdf.queryExecution().executedPlan().toString())
            found.append(rows(new, "orderid_bk"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == [[(None,), (4,), (4,), (70_000,)]] * 2
    assert ["BroadcastHashJoin" in p for p in plans] == [True, False]


def test_a_load_can_stop_anywhere(spark, shop, tmp_path):
    """Stopped behind each step and started again, the tables come out as if nothing had happened."""
    stage, dims = shop
    calm = increments.Increments(spark, str(tmp_path / "calm"))
    for orders in (range(1, 4), range(1, 6)):
        load(calm, stage(orders), dims)
    expected = content(calm)
    before = str(tmp_path / "before")
    load(increments.Increments(spark, before), stage(range(1, 4)), dims)
    for number, step in enumerate(["fact_order_line written", "fact_order_line_ids written", "fact_order_line marked", "fact_order written"]):
        copy = tmp_path / f"stop{number}"
        shutil.copytree(before, copy)

        def stop(done):
            if done == step:
                raise Stop

        # What was written but not marked may have come from other rows than those of the next attempt.
        orders = [*range(1, 6), 99] if number < 2 else range(1, 6)
        with pytest.raises(Stop):
            load(increments.Increments(spark, str(copy), stop), stage(orders), dims)
        tables = increments.Increments(spark, str(copy))
        load(tables, stage(range(1, 6)), dims)
        assert content(tables) == expected, step


def test_cart_days_follow_the_loads(spark, calendar, tmp_path):
    tables = increments.Increments(spark, str(tmp_path))
    schema = tables.fact("fact_cart_line").schema
    day = day_key(dt.date(2024, 1, 3))
    for number, carts in enumerate(([1, 2, 2], [2, 40_000], [5])):
        made = spark.createDataFrame([(k, c, 1, 1, day + k, 1, 1, 1, 0, 1, 202401) for k, c in enumerate(carts)], schema)
        tables.write("fact_cart_line", number + 1, made, "date_month")
        tables.finish("fact_cart_line", number + 1)
        if number != 1:
            increments.load_cart_days(tables)
            increments.load_cart_days(tables)
    assert tables.upto("cart_days")[0] == 2
    count = cart_days.carts_count(increments.read_cart_days(tables), warehouse(calendar), period("year", "2024", as_of=AS_OF))
    assert rows(count) == [(4,)]


# Checksums


def changed(spark, n, seed, share):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        kind = rng.random()
        if kind < share / 3:
            continue
        out.append((k, k % 9, "x" if kind < share else f"t{k % 50}", 1))
        if kind > 1 - share / 3:
            out.append(out[-1])
    return spark.createDataFrame(out, "id long, a int, b string, extra int")


@pytest.mark.parametrize("share", [0.0, 0.0002, 0.02, 1.0])
def test_narrowing_gives_the_same_mismatches(spark, share):
    source = spark.range(0, 40_000).select("id", (F.col("id") % 9).cast("int").alias("a"), F.concat(F.lit("t"), F.col("id") % 50).alias("b"))
    source = source.unionByName(spark.createDataFrame([(None, 1, "n"), (-(10**9), 2, None), (10**9, None, "z")], "id long, a int, b string"))
    actual = changed(spark, 40_000, 7, share).unionByName(spark.createDataFrame([(10**9, None, "z", 1)], "id long, a int, b string, extra int"))
    got = checksums.reconcile_ranges(source, actual, ["id"], ["a", "b"])
    expected = reconcile(source, actual, ["id"], ["a", "b"])
    assert sorted(rows(got), key=str) == sorted(rows(expected), key=str)
    if share == 0.0002:
        ranges = checksums.differing_ranges(source, actual.select(source.columns), "id")
        assert sum(last - first + 1 for first, last in ranges.intervals if -(10**8) < first < 10**8) < 10**8 and ranges.keyless


def test_equal_tables_are_read_once(spark, tmp_path):
    spark.range(0, 200_000).withColumn("v", F.col("id") * 2).repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    same = checksums.differing_ranges(a, a, "id")
    assert same == checksums.Ranges((), False)
    assert checksums.reconcile_ranges(a, a, ["id"], ["v"]).count() == 0
    b = a.withColumn("v", F.when(F.col("id") == 123_456, 0).otherwise(F.col("v")))
    found = checksums.differing_ranges(a, b, "id")
    (interval,) = found.intervals
    assert interval[0] <= 123_456 <= interval[1] and interval[1] - interval[0] < checksums.SHORT and not found.keyless
    assert "GreaterThanOrEqual(id" in a.filter(found.holds("id"))._jdf.queryExecution().executedPlan().toString()


def test_scattered_ranges_stay_cheap_to_filter(spark):
    a = spark.range(0, 4_000_000).select((F.col("id") - 2_000_000).alias("id"), F.col("id").alias("v"))
    wrong = [k for k in range(-1_999_000, 1_990_000, 17_001)]
    b = a.withColumn("v", F.when(F.col("id").isin(wrong), -1).otherwise(F.col("v")))
    found = checksums.differing_ranges(a, b, "id")
    held = {r[0] for r in a.filter(found.holds("id")).select("id").collect()}
    assert held >= set(wrong) and len(held) <= len(wrong) * checksums.SHORT
    assert len(found.intervals) <= 16
    assert checksums.reconcile_ranges(a, b, ["id"], ["v"]).count() == len(wrong)


def test_tables_that_differ_all_over_are_summed_up_once(spark, monkeypatch):
    levels, sums = [], checksums.range_sums
    monkeypatch.setattr(checksums, "range_sums", lambda df, *args: levels.append(args[2]) or sums(df, *args))
    a = spark.range(0, 8_000_000).withColumn("v", F.col("id"))
    found = checksums.differing_ranges(a, a.withColumn("v", F.when(F.col("id") % 239 == 0, -1).otherwise(F.col("v"))), "id")
    assert found == checksums.Ranges(((0, 7_999_999),), True) and len(levels) == 2


def test_close_ranges_are_joined():
    assert checksums._joined([0, 10, 20, 50], 10) == ((0, 29), (50, 59))
    assert checksums._joined(list(range(0, 1000, 2)), 1, most=3)[0][0] == 0 and len(checksums._joined(list(range(0, 1000, 2)), 1, most=3)) == 3
    assert checksums._joined([], 10) == ()


def test_meanings_of_surrogates(spark, calendar):
    fact = spark.createDataFrame([(1, 30, 99, 3, 14), (2, None, 30, 0, 0)], "orderid_bk long, product_sk long, customer_sk long, date_sk long, time_sk long")
    dw = warehouse(
        calendar,
        dim_product=spark.createDataFrame([(30, 3, 7)], "product_key long, productid_bk long, productattributeid_bk long"),
        dim_customer=spark.createDataFrame([(30, 8)], "customer_key long, customerid_bk long"),
    )
    got = reconciliation.with_meanings(dw, fact).select("orderid_bk", "productid_bk", "productattributeid_bk", "customerid_bk", "day", "hour")
    assert rows(got, "orderid_bk") == [(1, 3, 7, None, dt.date(1990, 1, 3), 13), (2, None, None, 8, None, None)]
