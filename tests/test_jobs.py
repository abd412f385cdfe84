"""Round trip through the jobs: raw shop tables, stage, warehouse, reports."""

import datetime as dt
import json
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillwise.plans import reports
from tillwise.plans.audit import ReportCatalog, RunLog
from tillwise.plans.catalog import build_report
from tillwise.plans.jobs import check_warehouse, compact, delete_rows, run_report, run_stage, run_warehouse, stage_tables
from tillwise.plans.menus import ANY, NOT_SPECIFIED, product_values
from tillwise.plans.periods import period
from tillwise.plans.warehouse import read_warehouse
from tillwise.schemas import OPEN_END, WAREHOUSE, schema
from tillwise.sources.csv_export import csv_page, export_csv
from tillwise.sources.store import Store

DAY1, DAY2 = dt.date(2024, 5, 20), dt.date(2024, 5, 21)
PRODUCT, VARIANT, CUSTOMER, ADDRESS = 102435, 151227, 288988, 825820
MOMENT = "2024-05-02 13:45:10"


def D(text):
    return Decimal(text)


class Shop:
    """Raw shop tables with one order; every missing column is NULL."""

    def __init__(self, spark):
        self.spark = spark
        self.tables = {
            "ps_address": [dict(id_address=ADDRESS, id_customer=CUSTOMER, id_country=1, id_state=2, city="Žilina",
                                postcode="01001", date_add="0000-00-00 00:00:00", active=1)],
            "ps_country": [dict(id_country=1, name="Slovensko", active=1)],
            "ps_state": [dict(id_state=2, name="")],
            "ps_customer": [dict(id_customer=CUSTOMER, id_gender=1, id_default_group=3, hashed_login="abc",
                                 birthday="1990-02-28", active=1, date_add="2021-01-02 03:04:05")],
            "ps_gender": [dict(id_gender=1, name="Pán"), dict(id_gender=9, name="[neuvádzam]")],
            "ps_group": [dict(id_group=3, name="Zákazník"), dict(id_group=4, name="Prázdna")],
            "ps_customer_group": [dict(id_customer=5, id_group=3)],
            "ps_customer_company": [dict(id_customer_company=1, id_customer=CUSTOMER, name="Acme s.r.o.")],
            "ps_product": [dict(id_product=PRODUCT, name="Obuv", id_manufacturer=7, id_category_default=8, active=1,
                                price=D("141.658333"), group="Beh", subgroup="", gender=None)],
            "ps_product_attribute": [dict(id_product=PRODUCT, id_product_attribute=VARIANT)],
            "ps_manufacturer": [dict(id_manufacturer=7, name="Nike")],
            "ps_category": [dict(id_category=8, name="Topánky")],
            "ps_attribute": [dict(id_attribute=44, id_attribute_group=5, name="44")],
            "ps_attribute_group": [dict(id_attribute_group=5, name="Veľkosť")],
            "ps_product_attribute_combination": [dict(id_attribute=44, id_product_attribute=VARIANT)],
            "ps_order_state": [dict(id_order_state=2, name="Platba prijatá"), dict(id_order_state=18, name="Čaká")],
            "ps_carrier": [dict(id_carrier=6, name="Packeta")],
            "ps_cart": [dict(id_cart=1, id_carrier=6, id_customer=CUSTOMER, date_add=MOMENT)],
            "ps_cart_product": [dict(id_cart=1, id_product=PRODUCT, id_product_attribute=VARIANT, quantity=1,
                                     date_add=MOMENT)],
            "ps_orders": [dict(id_order=1, id_customer=CUSTOMER, id_cart=1, id_address_delivery=ADDRESS,
                               payment="CardPay", conversion_rate=D("1"), total_paid_tax_incl=D("112.49"),
                               total_paid_tax_excl=D("93.74"), date_add=MOMENT, reference="R1")],
            "ps_order_carrier": [dict(id_order=1, id_carrier=6)],
            "ps_order_detail": [dict(id_order_detail=11, id_order=1, product_id=PRODUCT, product_attribute_id=VARIANT,
                                     product_quantity=1, unit_price_tax_excl=D("104.158333"),
                                     unit_price_tax_incl=D("124.99"), total_price_tax_excl=D("104.158333"),
                                     total_price_tax_incl=D("124.99"))],
            "ps_order_detail_tax": [dict(id_order_detail=11, id_tax=20)],
            "ps_tax": [dict(id_tax=20, rate=D("20"), name="DPH SK 20%")],
            "ps_order_history": [
                dict(id_order_history=100, id_order=1, id_order_state=18, date_add=MOMENT),
                dict(id_order_history=101, id_order=1, id_order_state=2, date_add=MOMENT),
            ],
            "ps_order_payment": [dict(id_order_payment=1, order_reference="R1"), dict(id_order_payment=2, order_reference="??")],
        }

    def __call__(self, name):
        from tillwise.sources.extract import SPECS

        kinds = {"id": "long", "int": "int", "text": "string", "money": "decimal(20,6)", "flag": "int",
                 "moment": "string", "day": "string", "hashed": "string", "id_or_0": "long",
                 "rate_or_0": "decimal(20,6)"}
        columns = {}
        for spec in SPECS.values():
            if spec.source == name:
                columns = {c: kinds[k] for c, k in spec.columns.items()}
        columns |= {
            "ps_product_attribute": {"id_product": "long", "id_product_attribute": "long"},
            "ps_carrier": {"id_carrier": "long", "name": "string"},
            "ps_order_carrier": {"id_order": "long", "id_carrier": "long"},
            "ps_order_detail_tax": {"id_order_detail": "long", "id_tax": "long"},
            "ps_tax": {"id_tax": "long", "rate": "decimal(20,6)", "name": "string"},
            "ps_orders": {"reference": "string"},
            "ps_cart": {"id_carrier": "long"},
            "ps_order_payment": {"order_reference": "string"},
        }.get(name, {})
        if name == "ps_product":
            columns.pop("id_product_attribute")
        data = [tuple(row.get(c) for c in columns) for row in self.tables.get(name, [])]
        return self.spark.createDataFrame(data, ", ".join(f"`{c}` {t}" for c, t in columns.items()))


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("warehouse")))
    shop = Shop(spark)
    assert run_stage(store, shop) == 25
    assert run_warehouse(store, DAY1) == 12
    return store, shop


def facts(store):
    dw = read_warehouse(store)
    return {
        name: rows(getattr(dw, name).drop(*[k for k in WAREHOUSE[name].names[:1]], "date_month"))
        for name in ("fact_cart_line", "fact_order_line", "fact_order_history", "fact_order")
    }


def test_stage_is_cleansed(loaded):
    stage = stage_tables(loaded[0])
    assert rows(stage("sg_address").select("date_add", "active", "deleted")) == [(None, True, None)]
    assert len(stage("sg_customer_company").first()["name"]) == 64
    assert rows(stage("sg_order_payment").select("id_order_payment", "id_order"), "id_order_payment") == [(1, 1), (2, 0)]
    assert rows(stage("sg_order_detail").select("tax_rate", "tax_name")) == [(D("20.000000"), "DPH SK 20%")]
    assert rows(stage("sg_orders").select("carrier")) == [("Packeta",)]


def test_dimensions(loaded):
    dw = read_warehouse(loaded[0])
    assert rows(dw.dim_customer.drop("customer_key")) == [
        (CUSTOMER, "abc", "Zákazník", dt.date(1990, 2, 28), "Pán", True, True, dt.date(2021, 1, 2), OPEN_END)
    ]
    assert rows(dw.dim_address.drop("address_key")) == [
        (ADDRESS, CUSTOMER, "Slovensko", None, "Žilina", "01001", dt.date(2000, 1, 1), OPEN_END)
    ]
    assert rows(dw.dim_product.select("productattributeid_bk", "manufacturer", "market_group", "market_subgroup")) == [
        (VARIANT, "Nike", "Beh", None)
    ]
    assert rows(dw.dim_attribute.drop("attribute_key")) == [(44, "44", "Veľkosť")]
    assert rows(dw.bridge_product_attribute.select("productattributeid_bk", "attributeid_bk")) == [(VARIANT, 44)]
    assert (dw.dim_date.count(), dw.dim_time.count()) == (11323, 24)


def test_facts_of_one_order(loaded):
    dw = read_warehouse(loaded[0])
    day = dw.dim_date.filter("date = DATE '2024-05-02'").first()["date_key"]
    hour = dw.dim_time.filter("hour = 13").first()["time_key"]
    product, customer = dw.dim_product.first()["product_key"], dw.dim_customer.first()["customer_key"]
    address = dw.dim_address.first()["address_key"]
    got = facts(loaded[0])
    assert got["fact_cart_line"] == [(1, product, customer, day, hour, 1, PRODUCT, VARIANT, CUSTOMER)]
    assert got["fact_order_line"] == [
        (1, 11, 1, product, customer, address, day, hour, 1, D("104.158333"), D("124.990000"), D("104.158333"),
         D("124.990000"), D("93.740000"), D("112.490000"), D("20.000000"), D("1.000000"), "Packeta", "CardPay")
    ]
    states = {r["orderstateid_bk"]: r["orderstate_key"] for r in dw.dim_order_state.collect()}
    assert sorted(got["fact_order_history"]) == [
        (100, states[18], 1, 18, day, hour), (101, states[2], 1, 2, day, hour)
    ]
    assert got["fact_order"] == [
        (1, customer, address, day, hour, D("93.740000"), D("112.490000"), D("20.000000"), D("1.000000"), "CardPay",
         "Packeta")
    ]


def test_warehouse_agrees_with_stage(loaded):
    for name, mismatches in check_warehouse(stage_tables(loaded[0]), read_warehouse(loaded[0])).items():
        assert rows(mismatches) == [], name


def test_reports_on_the_loaded_warehouse(loaded):
    dw = read_warehouse(loaded[0])
    may = period("month", "2024-5", as_of=DAY1)
    assert rows(reports.period_revenue(dw, may)) == [("2024-05-02", D("112.490000"))]
    assert rows(reports.summary(dw, may)) == [(1, 112.49, 1, 1, 100.0, 100.0)]
    assert rows(reports.summary(dw, period("month", "2024-6", as_of=DAY1))) == [(0, 0.0, 0, 0, 0.0, 0.0)]
    assert rows(reports.market_group_share(dw, may)) == [("Beh", D("125"), 1.0)]
    assert rows(reports.gender_distribution_dashboard(dw, may)) == [("Muž", 1)]
    assert rows(reports.age_distribution(dw, may, DAY1)) == [("30", D("112.49"))]
    matrix = reports.heatmap_matrix(dw, may)
    assert [r["Thursday"] for r in matrix.collect()] == [None, 1.0, None, None]
    assert [r["Monday"] for r in matrix.collect()] == [None] * 4
    assert rows(product_values(dw, "market_subgroup", may)) == [(ANY,), (NOT_SPECIFIED,)]
    chosen = {"market_group": "Beh", "market_subgroup": NOT_SPECIFIED}
    assert rows(build_report("product_group_revenue", dw, may, DAY1, chosen)) == [("2024-05-02", D("112.49"))]
    assert rows(build_report("product_group_revenue", dw, may, DAY1, {"market_group": "Iné"})) == []
    with pytest.raises(ValueError):
        build_report("product_group_revenue", dw, may, DAY1, {"market_gender": ANY})


def test_period_reaches_the_fact_scan(loaded):
    dw = read_warehouse(loaded[0])
    plan = reports.orders_count(dw, period("month", "2024-5", as_of=DAY1))._jdf.queryExecution().executedPlan().toString()
    assert "date_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(date_sk" in plan


def test_report_catalog(loaded, tmp_path):
    store, _ = loaded
    year = period("year", "2024", as_of=DAY1)
    report_id, export = run_report(store, "gender_distribution", year, DAY1, user_id=4)
    assert export is None
    catalog = ReportCatalog(store)
    kept = [json.loads(r["row"]) for r in catalog.rows(report_id).collect()]
    assert kept == [{"gender": "Pán", "customers_count": 1}]
    table_id, export = run_report(
        store, "top_customers_above_median_csv", year, DAY1, user_id=4, export_dir=str(tmp_path)
    )
    assert export.columns == ["customer_id", "total_spent", "order_count"] and export.total_rows == 0
    states = {r["id"]: r for r in catalog.reports().collect()}
    assert {states[i]["status"] for i in (report_id, table_id)} == {"SUCCESS"}
    assert json.loads(states[table_id]["parameters"])["report_type"] == "top_customers_above_median_csv"
    assert csv_page(store.spark, export, [F.asc("customer_id")])[1] == 0


def test_loading_again_adds_nothing_then_changes_make_versions(spark, loaded):
    store, shop = loaded
    before = facts(store)
    keys = rows(read_warehouse(store).dim_customer.select("customer_key"))
    run_warehouse(store, DAY1)
    assert facts(store) == before
    assert rows(read_warehouse(store).dim_customer.select("customer_key")) == keys

    shop.tables["ps_product"][0] |= {"price": D("99"), "gender": "Muži"}
    shop.tables["ps_customer"][0] |= {"hashed_login": "def"}
    shop.tables["ps_order_detail"].append(
        shop.tables["ps_order_detail"][0] | {"id_order_detail": 12, "id_order": 2}
    )
    shop.tables["ps_order_detail"].append(
        shop.tables["ps_order_detail"][0] | {"id_order_detail": 13, "id_order": 2, "product_id": 1}
    )
    shop.tables["ps_orders"].append(shop.tables["ps_orders"][0] | {"id_order": 2, "id_address_delivery": None})
    run_stage(store, shop)
    run_warehouse(store, DAY2)
    dw = read_warehouse(store)
    versions = rows(dw.dim_product.select("price", "market_gender", "valid_from", "valid_to"), "valid_from")
    assert versions == [
        (D("141.658333"), None, dt.date(2000, 1, 1), DAY1), (D("99.000000"), "Muži", DAY2, OPEN_END)
    ]
    assert dw.dim_customer.count() == 2 and dw.dim_address.count() == 1
    # Old lines are recognised although their product and customer have new versions; the unknown product is dropped.
    after = facts(store)
    assert after["fact_cart_line"] == before["fact_cart_line"]
    assert sorted(r[1] for r in after["fact_order_line"]) == [11, 12]
    newest = dw.dim_product.filter(F.col("valid_to") == OPEN_END).first()["product_key"]
    assert [r[3] for r in after["fact_order_line"] if r[1] == 12] == [newest]
    assert sorted((r[0], r[2]) for r in after["fact_order"] if r[0] == 2) == [(2, None)]
    # Every product version keeps its attributes.
    assert dw.bridge_product_attribute.count() == 2
    for name, key in (("fact_order_line", "orderline_key"), ("fact_order", "order_key"), ("dim_product", "product_key")):
        table = getattr(dw, name)
        assert table.select(key).distinct().count() == table.count()


def test_audit_records_success_and_failure(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    clock = iter(dt.datetime(2024, 1, 1, h) for h in range(24))

    def broken(name):
        raise RuntimeError("database gone")

    with pytest.raises(RuntimeError):
        run_stage(store, broken, lambda: next(clock), targets=["sg_state"])
    log = RunLog(store)
    running = log.start("dwh_incremental", next(clock), task_id="t1")
    assert rows(log.runs().filter("is_active").select("id")) == [(running,)]
    log.revoke("t1", next(clock))
    got = rows(log.runs().select("job_name", "status", "message", "started_at", "ended_at"), "job_name")
    hour = lambda h: dt.datetime(2024, 1, 1, h)
    assert got == [
        ("dwh_incremental", "REVOKED", None, hour(2), hour(3)),
        ("stage_reload", "FAILED", "database gone", hour(0), hour(1)),
    ]


def test_store_hides_uncommitted_runs_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    layout = schema("id:long name:text")
    assert rows(store.replaced("t", layout)) == [] and store.highest_key("t", "id") == 0
    store.write("t", spark.createDataFrame([(1, "a"), (2, "b")], layout))
    torn = tmp_path / "t" / "run=000002"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"torn")
    assert store.runs("t") == [1]
    assert rows(store.appended("t", layout), "id") == [(1, "a"), (2, "b")]
    delete_rows(store, "t", layout, F.col("id") == 1)
    assert store.runs("t") == [1, 2]
    assert rows(store.replaced("t", layout)) == [(2, "b")]
    store.write("t", spark.createDataFrame([], layout))
    assert store.highest_key("t", "id") == 2
    assert rows(store.appended("t", layout, since_run=1)) == [(2, "b")]


def test_parallel_and_stale_writers_lose_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    layout = schema("id:long")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: store.write("t", spark.createDataFrame([(i,)], layout)), range(4)))
    monkeypatch.setattr(Store, "_next", lambda self, table: 1)  # a listing older than all commits
    store.write("t", spark.createDataFrame([(4,)], layout))
    assert rows(store.appended("t", layout), "id") == [(i,) for i in range(5)]


def test_delete_from_facts_rewrites_their_runs_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    layout = WAREHOUSE["fact_order_history"]
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in layout.fields if f.name != "orderhistory_key"]
    for low in (0, 10):
        facts = spark.range(low, low + 10).select(F.col("id").alias("orderhistory_key"), *empty, F.lit(202405).alias("date_month"))
        store.write("fact_order_history", facts.select(*layout.names, "date_month"), "date_month")
    first = store._committed("fact_order_history")[0]
    delete_rows(store, "fact_order_history", layout, F.col("orderhistory_key") > 14)
    left = store.appended("fact_order_history", layout, "date_month").select("orderhistory_key")
    assert rows(left, "orderhistory_key") == [(i,) for i in range(15)]
    assert store._committed("fact_order_history")[0] == first and store.highest_key("fact_order_history", "orderhistory_key") == 14
    compact(store)
    assert len(store.runs("fact_order_history")) == 1
    assert rows(store.appended("fact_order_history", layout, "date_month").select("orderhistory_key"), "orderhistory_key") == [(i,) for i in range(15)]
    with pytest.raises(ValueError, match="versions"):
        delete_rows(store, "dim_product", WAREHOUSE["dim_product"], F.lit(True))


def test_calendar_grows_with_the_data(spark, tmp_path):
    shop = Shop(spark)
    store = Store(spark, str(tmp_path))
    for table in ("ps_orders", "ps_order_history"):
        for row in shop.tables[table]:
            row["date_add"] = "2031-03-04 05:06:07"
    run_stage(store, shop)
    run_warehouse(store, DAY1)
    dw = read_warehouse(store)
    assert dw.dim_date.agg(F.max("date")).first()[0] == dt.date(2031, 12, 31)
    assert reports.orders_count(dw, period("year", "2031", as_of=DAY1)).first()[0] == 1


def test_revoked_runs_keep_message_and_count(spark, tmp_path):
    shop = Shop(spark)
    store = Store(spark, str(tmp_path))
    run_stage(store, shop, targets=["sg_state"], task_id="t9")
    log = RunLog(store)
    log.revoke("t9", dt.datetime(2030, 1, 1))
    got = rows(log.runs().select("status", "message", "tables_processed", "ended_at"))
    assert got == [("REVOKED", "stage_reload finished", 1, dt.datetime(2030, 1, 1))]


def test_export_keeps_texts(spark, tmp_path):
    texts = ["plain", "", None, " pad ", "\t", 'say "x", y', "two\nlines", "two\r\nlines", "a,b;c\\", '"', "\\N", "null", "#", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    made = export_csv(df, str(tmp_path / "export"), [F.asc("id")])
    page, last = csv_page(spark, made, [F.asc("id")], page=1, page_size=50)
    assert [(r["id"], r["name"]) for r in page.collect()] == list(enumerate(texts)) and last == 1 and made.total_rows == len(texts)


def test_expire_keeps_history(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    layout = schema("key:long bk:long valid_from:date valid_to:date")
    old = dt.date(2020, 1, 1)
    for run in range(1, 5):
        store.write_versions("d", spark.createDataFrame([(run, 1, old, OPEN_END), (run - 1, 1, old, old)], layout))
        store.write("t", spark.createDataFrame([(run, run, old, old)], layout))
    versions = rows(store.versions("d", layout), "key", "valid_to")
    store.expire("d", versioned=True)
    store.expire("t")
    assert rows(store.versions("d", layout), "key", "valid_to") == versions and len(versions) == 5
    assert rows(store.current("d", layout).select("key")) == [(4,)]
    assert store.runs("t") == [3, 4] and store.runs("d") == [1, 2, 3, 4]
    assert store.highest_key("d", "key") == 4


def test_payments_are_compared_before_the_fan_out(spark):
    """Only payments under several references are compared behind the join; exact repeats go either way."""
    from tillwise.sources.extract import SPECS

    paid = [(1, "R1"), (1, "R1"), (2, "R1"), (3, "R1"), (3, "R2"), (4, None), (4, "??"), (5, None), (5, None), (6, "R2"), (6, None)]
    payments = [dict(id_order_payment=i, id_currency=1, order_reference=r) for i, r in paid]
    orders = [dict(id_order=o, reference=r) for o, r in [(7, "R1"), (7, "R1"), (8, "R1"), (7, "R2"), (None, "R2"), (9, None)]]
    shop = Shop(spark)
    shop.tables = shop.tables | {"ps_order_payment": payments, "ps_orders": orders}
    made = SPECS["sg_order_payment"].apply(shop)
    found = Counter(tuple(r) for r in made.select("id_order_payment", "id_order").collect())
    assert found == Counter([(1, 7), (1, 8), (2, 7), (2, 8), (3, 7), (3, 8), (3, 0), (4, 0), (5, 0), (6, 7), (6, 0)])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_wide_rows_are_compared_behind_the_shuffle(spark):
    """Repeated lines go, a line taxed twice stays twice, and no scan holds lines or orders to compare them."""
    from tillwise.sources.extract import SPECS

    shop = Shop(spark)
    line, order = shop.tables["ps_order_detail"][0], shop.tables["ps_orders"][0]
    shop.tables = shop.tables | {
        "ps_order_detail": [line, line, line | {"id_order_detail": 12}, line | {"id_order_detail": 12, "product_quantity": 2}],
        "ps_order_detail_tax": [dict(id_order_detail=11, id_tax=20), dict(id_order_detail=11, id_tax=20), dict(id_order_detail=11, id_tax=21)],
        "ps_orders": [order, order],
    }
    lines, orders = (SPECS[t].apply(shop) for t in ("sg_order_detail", "sg_orders"))
    assert rows(lines.select("id_order_detail", "tax_rate"), "id_order_detail", "tax_rate") == [(11, D("0")), (11, D("20")), (12, D("0")), (12, D("0"))]
    assert rows(orders.select("id_order", "carrier")) == [(1, "Packeta")]
    for made in (lines, orders):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        wide = plan[plan.index("Aggregate") :]
        assert "RepartitionByExpression" in wide.splitlines()[1]
