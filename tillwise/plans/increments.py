"""Fact loads that read only what is new since their last load.

A load writes its rows, and bitmaps of their ids, to the folders ``load=<n>`` of plain month-partitioned Parquet tables, each
overwritten as a whole, and then its mark: a row of the ``marks`` table with the number, the highest key, and how far each
table it reads was read. Only marked loads are ever read. So every step can be repeated: what was not marked is computed from
the same inputs and overwritten under the same number, what was marked is not new any more.

* ``load_order_lines``: order lines of stage not loaded yet, recognised by bitmaps, never by reading the fact.
* ``load_orders``: orders of the line loads since the last one; a run without new lines opens no line file.
* ``load_cart_days``: the bitmaps of carts per day for the cart lines of the loads since.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.operators.id_bitmaps import BITS, BUCKET, id_bitmaps, merged
from tillwise.operators.scd import with_new_keys
from tillwise.plans import fact_loads
from tillwise.plans.cart_days import cart_days
from tillwise.schemas import PARTITION_COLUMN, WAREHOUSE
from tillwise.session import configure
from tillwise.sources.readers import TableReader

MARKS = "table string, load long, highest_key long, source string, read_upto long"
_KEYS = {"fact_cart_line": "cartline_key", "fact_order_line": "orderline_key", "fact_order_history": "orderhistory_key", "fact_order": "order_key"}
_IDS = f"{BUCKET} long, {BITS} binary"
#: Bitmaps of known ids that meet stage rows where these are read: 128 MB at most. More of them meet the rows in a shuffle.
BROADCAST_BITMAPS = 32_768


class Increments:
    """The tables under one folder. ``after`` is called behind each step, for tests."""

    def __init__(self, spark: SparkSession, root: str, after: Callable[[str], None] = lambda step: None):
        self.spark, self.root, self.after = configure(spark), root.rstrip("/"), after
        self.spark.createDataFrame([], MARKS).write.mode("ignore").parquet(f"{self.root}/marks")

    def _marks(self) -> DataFrame:
        return self.spark.read.schema(MARKS).parquet(f"{self.root}/marks")

    def upto(self, table: str) -> tuple[int, int]:
        """Number of the last finished load and the highest key given out so far."""
        row = self._marks().filter(F.col("table") == table).agg(F.max("load"), F.max("highest_key")).first()
        return row[0] or 0, row[1] or 0

    def read_upto(self, table: str, source: str) -> int:
        """Up to which load of ``source`` the loads of ``table`` have read."""
        found = self._marks().filter((F.col("table") == table) & (F.col("source") == source))
        return found.agg(F.max("read_upto")).first()[0] or 0

    def finish(self, table: str, load: int, highest_key: int = 0, **read: int) -> None:
        rows = [(table, load, highest_key, source, upto) for source, upto in (read or {"": 0}).items()]
        self.spark.createDataFrame(rows, MARKS).coalesce(1).write.mode("append").parquet(f"{self.root}/marks")
        self.after(f"{table} marked")

    def write(self, table: str, load: int, rows: DataFrame, *by: str) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{table}/load={load}")
        self.after(f"{table} written")

    def loads(self, table: str, schema, first: int, last: int) -> DataFrame:
        """Rows of the loads ``first`` to ``last``. No other folder is opened or even listed."""
        if last < first:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{table}/load={n}" for n in range(first, last + 1)]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def fact(self, name: str, first: int = 1, last: int | None = None) -> DataFrame:
        """Rows of a fact, of all finished loads or of some of them."""
        schema = T.StructType([*WAREHOUSE[name].fields, T.StructField(PARTITION_COLUMN, T.IntegerType())])
        return self.loads(name, schema, first, self.upto(name)[0] if last is None else last)

    def ids(self, name: str) -> DataFrame | None:
        """Bitmaps of all ids loaded into a fact, sent to every task unless they are too many; None before the first load."""
        last = self.upto(name)[0]
        if not last:
            return None
        made = self.loads(f"{name}_ids", _IDS, 1, last)
        few = made.select(BUCKET).distinct().limit(BROADCAST_BITMAPS + 1).count() <= BROADCAST_BITMAPS
        return F.broadcast(merged(made)) if few else merged(made)

    def append(self, name: str, rows: DataFrame, **read: int) -> int:
        """One load of a fact: rows with new keys, the bitmaps of their ids, the mark. Returns the number of rows."""
        last, highest = self.upto(name)
        placed = rows.hint("rebalance", PARTITION_COLUMN).sortWithinPartitions(PARTITION_COLUMN, "date_sk")
        keyed = with_new_keys(placed, _KEYS[name], highest).select(*WAREHOUSE[name].names, PARTITION_COLUMN)
        self.write(name, last + 1, keyed, PARTITION_COLUMN)
        made = self.fact(name, last + 1, last + 1)
        self.write(f"{name}_ids", last + 1, id_bitmaps(made, fact_loads.ROW_IDS[name]))
        count, top = made.agg(F.count(F.lit(1)), F.max(_KEYS[name])).first()
        self.finish(name, last + 1, top or highest, **read)
        return count


def load_order_lines(
    tables: Increments, stage: TableReader, dim_product: DataFrame, dim_customer: DataFrame, dim_address: DataFrame,
    dim_date: DataFrame, dim_time: DataFrame,
) -> int:
    """Append the order lines of stage that are not loaded yet."""
    rows = fact_loads.order_line_rows(
        stage, None, dim_product, dim_customer, dim_address, dim_date, dim_time, loaded=tables.ids("fact_order_line")
    )
    return tables.append("fact_order_line", rows)


def load_order_history(
    tables: Increments, stage: TableReader, dim_order_state: DataFrame, dim_date: DataFrame, dim_time: DataFrame
) -> int:
    """Append the history rows of stage that are not loaded yet."""
    rows = fact_loads.order_history_rows(
        stage, None, dim_order_state, dim_date, dim_time, loaded=tables.ids("fact_order_history")
    )
    return tables.append("fact_order_history", rows)


def new_lines(tables: Increments) -> tuple[DataFrame, int]:
    """Order lines of the loads that no load of orders has read, and the number of the last of them."""
    last = tables.upto("fact_order_line")[0]
    return tables.fact("fact_order_line", tables.read_upto("fact_order", "fact_order_line") + 1, last), last


def load_orders(tables: Increments) -> int:
    """Append the orders of new lines; an order that is loaded stays as it is."""
    lines, last = new_lines(tables)
    if last == tables.read_upto("fact_order", "fact_order_line"):
        return 0
    rows = fact_loads.order_rows(lines, None, loaded=tables.ids("fact_order"))
    return tables.append("fact_order", rows, fact_order_line=last)


def load_cart_days(tables: Increments) -> None:
    """Bring the bitmaps of carts per day up to the cart lines loaded."""
    last, seen = tables.upto("fact_cart_line")[0], tables.read_upto("cart_days", "fact_cart_line")
    if last == seen:
        return
    number = tables.upto("cart_days")[0] + 1
    tables.write("cart_days", number, cart_days(tables.fact("fact_cart_line", seen + 1, last)), PARTITION_COLUMN)
    tables.finish("cart_days", number, fact_cart_line=last)


def read_cart_days(tables: Increments) -> DataFrame:
    return tables.loads("cart_days", f"date_sk long, {_IDS}, {PARTITION_COLUMN} int", 1, tables.upto("cart_days")[0])
