"""Run audit and report catalog, kept as append-only events."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.schemas import schema
from tillwise.sources.store import Store

# The states of a run.
RUNNING, SUCCESS, FAILED, REVOKED = "RUNNING", "SUCCESS", "FAILED", "REVOKED"

ETL_EVENTS = schema("id:text job_name:text status:text at:moment message:text tables_processed:int task_id:text")
REPORT_EVENTS = schema(
    "id:text user_id:long report_type:text status:text at:moment message:text parameters:text result:text task_id:text"
)
REPORT_ROWS = schema("report_id:text position:long row:text")


def run_state(events: DataFrame) -> DataFrame:
    """One row per run from its events: when it started, its latest state, and when it reached it.

    An event without a message, count or result leaves those of earlier events as they are.
    """
    order = F.struct(F.col("at"), F.when(F.col("status") == RUNNING, 0).otherwise(1))
    latest = {
        name: F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias(name)
        for name in events.columns
        if name not in ("id", "at", "job_name", "user_id", "report_type", "task_id", "parameters")
    }
    fixed = [
        F.max(name).alias(name)
        for name in ("job_name", "user_id", "report_type", "task_id", "parameters")
        if name in events.columns
    ]
    return events.groupBy("id").agg(
        *fixed,
        F.min("at").alias("started_at"),
        F.max(F.when(F.col("status") != RUNNING, F.col("at"))).alias("ended_at"),
        *latest.values(),
    )


class RunLog:
    """Audit of the load jobs."""

    table = "etl_log"

    def __init__(self, store: Store):
        self.store = store

    def _append(self, **event: Any) -> None:
        row = tuple(event.get(name) for name in ETL_EVENTS.names)
        self.store.write(self.table, self.store.spark.createDataFrame([row], ETL_EVENTS).coalesce(1))

    def start(self, job_name: str, at: dt.datetime, task_id: str | None = None) -> str:
        run_id = str(uuid.uuid4())
        self._append(id=run_id, job_name=job_name, status=RUNNING, at=at, task_id=task_id)
        return run_id

    def finish(
        self, run_id: str, status: str, at: dt.datetime, message: str | None = None, tables_processed: int | None = None
    ) -> None:
        self._append(id=run_id, status=status, at=at, message=message, tables_processed=tables_processed)

    def revoke(self, task_id: str, at: dt.datetime) -> None:
        """Mark the runs of a task as revoked."""
        for run in self.runs().filter(F.col("task_id") == task_id).select("id").toLocalIterator():
            self._append(id=run["id"], status=REVOKED, at=at)

    def events(self) -> DataFrame:
        return self.store.appended(self.table, ETL_EVENTS)

    def runs(self) -> DataFrame:
        return run_state(self.events()).withColumn("is_active", F.col("status") == RUNNING)


class ReportCatalog:
    """Catalog of built reports; diagram results are kept as JSON rows."""

    table = "report"
    rows_table = "report_rows"

    def __init__(self, store: Store):
        self.store = store

    def _append(self, **event: Any) -> None:
        for name in ("parameters", "result"):
            if event.get(name) is not None:
                event[name] = json.dumps(event[name], ensure_ascii=False)
        row = tuple(event.get(name) for name in REPORT_EVENTS.names)
        self.store.write(self.table, self.store.spark.createDataFrame([row], REPORT_EVENTS).coalesce(1))

    def start(self, user_id: int, report_type: str, parameters: dict, at: dt.datetime, task_id: str | None = None) -> str:
        report_id = str(uuid.uuid4())
        self._append(
            id=report_id, user_id=user_id, report_type=report_type, status=RUNNING, at=at, parameters=parameters,
            task_id=task_id,
        )
        return report_id

    def finish(
        self, report_id: str, status: str, at: dt.datetime, message: str | None = None, result: dict | None = None
    ) -> None:
        self._append(id=report_id, status=status, at=at, message=message, result=result or {})

    def keep_rows(self, report_id: str, rows: DataFrame) -> None:
        self.store.write(self.rows_table, json_rows(rows, report_id))

    def rows(self, report_id: str) -> DataFrame:
        stored = self.store.appended(self.rows_table, REPORT_ROWS)
        return stored.filter(F.col("report_id") == report_id).orderBy("position")

    def reports(self) -> DataFrame:
        return run_state(self.store.appended(self.table, REPORT_EVENTS))


def json_rows(rows: DataFrame, report_id: str) -> DataFrame:
    """A result as JSON text, one row each, in result order."""
    return rows.select(
        F.lit(report_id).alias("report_id"),
        F.monotonically_increasing_id().alias("position"),
        F.to_json(F.struct("*")).alias("row"),
    )
