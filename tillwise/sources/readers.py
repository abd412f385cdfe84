"""Table readers: parquet folders and JDBC databases."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from tillwise.sources.extract import SPECS

FETCH_ROWS = 10_000
#: Ids of tables that only joined extractions read.
JOINED_IDS = {"ps_product_attribute": "id_product_attribute", "ps_order_carrier": "id_order", "ps_order_detail_tax": "id_order_detail"}
#: Ids looked at to find the bounds of the parts that a table is read in.
SAMPLED_IDS = 20_000

TableReader = Callable[[str], DataFrame]


def parquet_tables(spark: SparkSession, folder: str) -> TableReader:
    return lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def jdbc_options(
    url: str,
    table: str,
    split: tuple[str, int, int, int] | None = None,
    fetch_rows: int = FETCH_ROWS,
    **more: str,
) -> dict[str, str]:
    """Options of one JDBC read; ``split`` = (numeric column, lowest, highest, partitions) reads in parallel."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_rows)}
    if url.startswith("jdbc:mysql:"):  # dates of zeros come as NULL instead of failing the read
        options["zeroDateTimeBehavior"] = "CONVERT_TO_NULL"
    options |= more
    if split:
        column, low, high, partitions = split
        options |= {
            "partitionColumn": column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(partitions),
        }
    return options


def even_predicates(column: str, sample: Iterable[int | None], partitions: int) -> list[str]:
    """Conditions that cut a table into parts of about the same number of rows, from a sample of its ids.

    Every id, sampled or not, and NULL, meets exactly one of them. Bounds are quantiles of the sample, so that gaps and
    crowded stretches of ids don't matter; an id repeated beyond the size of a part stays in one part.
    """
    ids = sorted(i for i in sample if i is not None)
    bounds = sorted({ids[k * len(ids) // partitions] for k in range(1, partitions)} - {ids[0]}) if ids else []
    if not bounds:
        return ["1 = 1"]
    inner = [f"{column} >= {low} AND {column} < {high}" for low, high in zip(bounds, bounds[1:])]
    return [f"{column} < {bounds[0]} OR {column} IS NULL", *inner, f"{column} >= {bounds[-1]}"]


def split_columns(split_by: dict[str, str] | None = None) -> dict[str, str]:
    """The id column each table is read by: that of ``split_by``, else the first id of its extraction."""
    first = {spec.source: next((c for c, kind in spec.columns.items() if kind == "id"), None) for spec in SPECS.values()}
    return {table: column for table, column in first.items() if column} | JOINED_IDS | (split_by or {})


def sample_query(table: str, column: str, low: int, high: int, sampled: int = SAMPLED_IDS) -> str:
    """A subquery with at most about ``sampled`` ids of a table, spread over its id range by a residue of the id."""
    step = max(1, (high - low + 1) // sampled)
    return f"(SELECT {column} AS id FROM {table} WHERE MOD({column}, {step}) = {low % step if step > 1 else 0}) sample"


def jdbc_tables(
    spark: SparkSession,
    url: str,
    split_by: dict[str, str] | None = None,
    partitions: int = 32,
    **more: str,
) -> TableReader:
    """Reader over a live database. Every table with an id is read in parallel, in parts of about the same size.

    The bounds come from a sample of at most some ``SAMPLED_IDS`` ids. Column pruning and simple filters are pushed into the
    database by Spark itself.
    """
    columns = split_columns(split_by)

    def load(table: str) -> DataFrame:
        return spark.read.format("jdbc").options(**jdbc_options(url, table, **more)).load()

    def read(name: str) -> DataFrame:
        column = columns.get(name)
        if column is None:
            return load(name)
        ends = load(f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {name}) ends").first()
        if ends["low"] is None:
            return load(name)
        sample = load(sample_query(name, column, int(ends["low"]), int(ends["high"]))).limit(2 * SAMPLED_IDS).collect()
        predicates = even_predicates(column, [r["id"] for r in sample], partitions)
        options = jdbc_options(url, name, **more)
        properties = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
        return spark.read.jdbc(url, name, predicates=predicates, properties=properties)

    return read
