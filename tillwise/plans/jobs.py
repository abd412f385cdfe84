"""The jobs: stage reload, warehouse load, report build, deletion and reconciliation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.operators.calendar import LAST_DAY, date_frame, time_frame
from tillwise.operators.facts import delete_where
from tillwise.operators.scd import with_new_keys
from tillwise.plans import dimensions, fact_loads, reconciliation
from tillwise.plans.audit import ETL_EVENTS, FAILED, REPORT_EVENTS, REPORT_ROWS, SUCCESS, ReportCatalog, RunLog
from tillwise.plans.catalog import REPORTS, build_report, check_choices
from tillwise.plans.periods import Period
from tillwise.plans.warehouse import PARTITIONED_FACTS, VERSIONED, Warehouse, read_warehouse
from tillwise.schemas import PARTITION_COLUMN, WAREHOUSE
from tillwise.session import configure
from tillwise.sources.csv_export import Export, export_csv
from tillwise.sources.extract import SPECS
from tillwise.sources.readers import TableReader
from tillwise.sources.store import Store

STAGE_PREFIX = "stage"
APPENDED = {
    "bridge_product_attribute": WAREHOUSE["bridge_product_attribute"],
    RunLog.table: ETL_EVENTS,
    ReportCatalog.table: REPORT_EVENTS,
    ReportCatalog.rows_table: REPORT_ROWS,
}

Clock = Callable[[], dt.datetime]


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _audited(
    log: RunLog, job_name: str, steps: Iterable[tuple[str, Callable[[], bool]]], clock: Clock, task_id: str | None
) -> int:
    """Run the steps in order, count those that loaded a table, and record the outcome. A failure is raised."""
    run_id = log.start(job_name, clock(), task_id)
    loaded = 0
    try:
        for _, step in steps:
            loaded += step()
    except Exception as error:
        log.finish(run_id, FAILED, clock(), str(error), loaded)
        raise
    log.finish(run_id, SUCCESS, clock(), f"{job_name} finished", loaded)
    return loaded


def run_stage(
    store: Store, read: TableReader, clock: Clock = _now, targets: Iterable[str] = SPECS, task_id: str | None = None
) -> int:
    """Full reload of the stage tables; each becomes visible as a whole."""
    configure(store.spark)

    def reload(target: str) -> Callable[[], bool]:
        def step() -> bool:
            table = f"{STAGE_PREFIX}/{target}"
            store.write(table, SPECS[target].apply(read))
            store.expire(table)
            return True

        return step

    return _audited(RunLog(store), "stage_reload", [(t, reload(t)) for t in targets], clock, task_id)


def stage_tables(store: Store) -> TableReader:
    return lambda target: store.replaced(f"{STAGE_PREFIX}/{target}", SPECS[target].schema)


def _load_calendar(store: Store, table: str, rows: Callable[[], DataFrame]) -> bool:
    if store.runs(table):
        return False
    store.write(table, rows().coalesce(1))
    return True


def _load_dates(store: Store, stage: TableReader, as_of: dt.date) -> bool:
    """The calendar, up to the end of the last year that ``as_of`` or the newest stage row reaches into.

    Keys number the days from the first one, so a longer calendar keeps the keys of the shorter one.
    """
    moments = [stage(t).select("date_add") for t in ("sg_cart_product", "sg_cart", "sg_orders", "sg_order_history")]
    newest = reduce(DataFrame.unionByName, moments).agg(F.max(F.to_date("date_add"))).first()[0]
    last = max(LAST_DAY, dt.date(max(as_of, newest or as_of).year, 12, 31))
    known = store.replaced("dim_date", WAREHOUSE["dim_date"]).agg(F.max("date")).first()[0]
    if known is not None and known >= last:
        return False
    store.write("dim_date", date_frame(store.spark, end=last).coalesce(1))
    return True


def _load_dimension(store: Store, dimension: dimensions.Dimension, stage: TableReader, as_of: dt.date) -> bool:
    schema = WAREHOUSE[dimension.name]
    rows = dimension.step(stage, store.current(dimension.name, schema), as_of).hint("rebalance")
    keyed = with_new_keys(rows, dimension.key, store.highest_key(dimension.name, dimension.key))
    store.write_versions(dimension.name, keyed)
    store.expire(dimension.name, versioned=True)
    return True


def _load_attributes(store: Store, stage: TableReader) -> bool:
    schema = WAREHOUSE["dim_attribute"]
    rows = dimensions.attributes_merged(stage, store.replaced("dim_attribute", schema)).hint("rebalance")
    keyed = with_new_keys(rows, "attribute_key", store.highest_key("dim_attribute", "attribute_key"))
    store.write("dim_attribute", keyed)
    store.expire("dim_attribute")
    return True


def _append_fact(store: Store, fact: str, key: str, rows: DataFrame) -> bool:
    """Append new fact rows, laid out by month.

    The rebalance puts a month together and lets AQE split a large one, so neither a huge month nor a thousand small
    files per task can arise; rows are ordered by day inside each file for row-group pruning.
    """
    placed = rows.hint("rebalance", PARTITION_COLUMN).sortWithinPartitions(PARTITION_COLUMN, "date_sk")
    keyed = with_new_keys(placed, key, store.highest_key(fact, key))
    store.write(fact, keyed.select(*WAREHOUSE[fact].names, PARTITION_COLUMN), PARTITION_COLUMN)
    return True


def run_warehouse(store: Store, as_of: dt.date, clock: Clock = _now, task_id: str | None = None) -> int:
    """Incremental load of the warehouse from stage. Running it again with the same stage changes nothing."""
    spark = configure(store.spark)
    stage = stage_tables(store)

    def versions(name: str) -> DataFrame:
        return store.versions(name, WAREHOUSE[name])

    def current(name: str) -> DataFrame:
        return store.current(name, WAREHOUSE[name])

    def plain(name: str) -> DataFrame:
        return store.replaced(name, WAREHOUSE[name])

    def fact(name: str) -> DataFrame:
        return store.appended(name, WAREHOUSE[name], PARTITION_COLUMN)

    def bridge() -> bool:
        known = store.appended("bridge_product_attribute", WAREHOUSE["bridge_product_attribute"])
        store.write(
            "bridge_product_attribute",
            fact_loads.bridge_rows(stage, versions("dim_product"), plain("dim_attribute"), known),
        )
        return True

    def cart_lines() -> bool:
        rows = fact_loads.cart_line_rows(
            stage, fact("fact_cart_line"), current("dim_product"), current("dim_customer"), plain("dim_date"),
            plain("dim_time"),
        )
        return _append_fact(store, "fact_cart_line", "cartline_key", rows)

    def order_lines() -> bool:
        rows = fact_loads.order_line_rows(
            stage, fact("fact_order_line"), current("dim_product"), current("dim_customer"), versions("dim_address"),
            plain("dim_date"), plain("dim_time"),
        )
        return _append_fact(store, "fact_order_line", "orderline_key", rows)

    def order_history() -> bool:
        rows = fact_loads.order_history_rows(
            stage, fact("fact_order_history"), versions("dim_order_state"), plain("dim_date"), plain("dim_time")
        )
        return _append_fact(store, "fact_order_history", "orderhistory_key", rows)

    def orders() -> bool:
        rows = fact_loads.order_rows(fact("fact_order_line"), fact("fact_order"))
        return _append_fact(store, "fact_order", "order_key", rows)

    def dimension(which: dimensions.Dimension) -> Callable[[], bool]:
        return lambda: _load_dimension(store, which, stage, as_of)

    steps = [
        ("dim_date", lambda: _load_dates(store, stage, as_of)),
        ("dim_time", lambda: _load_calendar(store, "dim_time", lambda: time_frame(spark))),
        ("dim_customer", dimension(dimensions.CUSTOMER)),
        ("dim_address", dimension(dimensions.ADDRESS)),
        ("dim_attribute", lambda: _load_attributes(store, stage)),
        ("dim_product", dimension(dimensions.PRODUCT)),
        ("bridge_product_attribute", bridge),
        ("dim_order_state", dimension(dimensions.ORDER_STATE)),
        ("fact_cart_line", cart_lines),
        ("fact_order_line", order_lines),
        ("fact_order_history", order_history),
        ("fact_order", orders),
    ]
    return _audited(RunLog(store), "dwh_incremental", steps, clock, task_id)


def delete_rows(store: Store, table: str, schema, condition: Column) -> None:
    """Delete rows of a table.

    Of a replaced table the next run holds the remaining rows. Of a fact, the bridge or an event table the runs that hold
    such rows are rewritten. A versioned dimension is refused: its rows are the history that facts point at.
    """
    if table in VERSIONED:
        raise ValueError(f"{table} keeps versions; close a version instead of deleting it")
    if table in PARTITIONED_FACTS:
        store.rewrite(table, schema, PARTITION_COLUMN, condition)
    elif table in APPENDED:
        store.rewrite(table, schema, condition=condition)
    else:
        store.write(table, delete_where(store.replaced(table, schema), condition))


def compact(store: Store) -> None:
    """Merge the small runs of facts, bridge and event tables; their contents stay the same."""
    for fact in PARTITIONED_FACTS:
        store.rewrite(fact, WAREHOUSE[fact], PARTITION_COLUMN)
    for table, layout in APPENDED.items():
        store.rewrite(table, layout)


def run_report(
    store: Store,
    name: str,
    period: Period,
    as_of: dt.date,
    user_id: int,
    choices: dict[str, str] | None = None,
    export_dir: str | None = None,
    clock: Clock = _now,
    task_id: str | None = None,
) -> tuple[str, Export | None]:
    """Build a report and put it into the catalog: a table report as CSV, a diagram report as JSON rows."""
    configure(store.spark)
    report = REPORTS[name]
    check_choices(name, choices)
    catalog = ReportCatalog(store)
    parameters = {
        "user_id": user_id,
        "report_type": name,
        "report_title": report.title,
        "report_data_type": report.data_type,
        "report_diagram_type": report.diagram_type,
        "filters": {
            "start": period.start.isoformat(),
            "end": period.end.isoformat(),
            "report_subfilters": [
                {column: {"title": report.choices[column], "value": value}} for column, value in (choices or {}).items()
            ],
        },
    }
    report_id = catalog.start(user_id, name, parameters, clock(), task_id)
    export = None
    try:
        rows = build_report(name, read_warehouse(store), period, as_of, choices)
        if report.data_type == "table":
            path = f"{(export_dir or store.root + '/exports').rstrip('/')}/{name}_{report_id}"
            export = export_csv(rows, path, report.order())
            result = {"filepath": export.path, "columns": export.columns, "total_rows": export.total_rows}
        else:
            catalog.keep_rows(report_id, rows)
            result = {"rows": ReportCatalog.rows_table, "columns": rows.columns}
    except Exception as error:
        catalog.finish(report_id, FAILED, clock(), str(error))
        raise
    catalog.finish(report_id, SUCCESS, clock(), "report built", result)
    return report_id, export


def check_warehouse(stage: TableReader, dw: Warehouse) -> dict[str, DataFrame]:
    """Mismatches between stage and the four facts, surrogate keys by what they stand for; no row means a clean load."""
    lines = reconciliation.expected_order_lines(stage, dw)
    expected = {
        "fact_cart_line": reconciliation.expected_cart_lines(stage, dw),
        "fact_order_line": lines,
        "fact_order_history": reconciliation.expected_history(stage, dw),
        "fact_order": reconciliation.expected_orders(lines),
    }
    return {
        name: reconciliation.findings(name, rows, reconciliation.with_meanings(dw, getattr(dw, name)))
        for name, rows in expected.items()
    }
