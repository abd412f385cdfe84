"""Tables as folders of committed runs.

Every load writes its rows to a folder of its own, ``<table>/run=<n>-<unique name>``; nothing is ever overwritten. Spark's
``_SUCCESS`` marker is the commit point: a run without it is invisible to readers, so a load that lost its driver or
executors can simply be started again. The number only gives the order; writers that start together may share one, and
all their runs count. Three shapes share the layout:

* replaced tables (stage, calendar, type-1 dimension): the newest run is the table;
* appended tables (facts, bridge): all runs together are the table;
* versioned dimensions: each run holds ``open=true`` (all current rows) and ``open=false`` (rows closed by that run).
  Closed rows are never rewritten; a reader takes the newest current part and the closed part of every run.

A run may also take the place of others (``rewrite``): their names are stored beside the table before the run is
committed, so readers see either the old runs or the new one. Tables of small events are kept short that way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.schemas import OPEN_END


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _glob(self, pattern: str) -> list[str]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(path)
        return sorted(status.getPath().toString() for status in found) if found is not None else []

    def _committed(self, table: str) -> list[tuple[int, str]]:
        """Number and path of the committed runs that no other run has replaced, oldest first."""
        markers = self._glob(f"{self.root}/{table}/run=*/_SUCCESS")
        paths = [marker.removesuffix("/_SUCCESS") for marker in markers]
        names = {path.rsplit("/run=", 1)[1]: path for path in paths}
        lists = [f"{self.root}/{table}/_replaced/{name}" for name in names if name.endswith("-rewrite")]
        gone = {row["value"] for row in self.spark.read.text(lists).collect()} if lists else set()
        return sorted((int(name.split("-")[0]), path) for name, path in names.items() if name not in gone)

    def runs(self, table: str) -> list[int]:
        """Numbers of the committed runs, oldest first."""
        return [number for number, _ in self._committed(table)]

    def _delete(self, path: str) -> None:
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)

    def _next(self, table: str) -> int:
        """A number above those of all committed runs."""
        markers = self._glob(f"{self.root}/{table}/run=*/_SUCCESS")
        return max((int(marker.rsplit("/run=", 1)[1].split("-")[0]) for marker in markers), default=0) + 1

    def _commit(self, df: DataFrame, path: str, partition_by: str | None) -> None:
        writer = df.write.mode("error").option("partitionOverwriteMode", "static")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)

    def write(self, table: str, df: DataFrame, partition_by: str | None = None) -> int:
        """Commit ``df`` as a new run of ``table`` and return its number."""
        number = self._next(table)
        self._commit(df, f"{self.root}/{table}/run={number:06d}-{uuid.uuid4().hex}", partition_by)
        return number

    def rewrite(
        self, table: str, schema: T.StructType, partition_by: str | None = None, condition: Column | None = None
    ) -> None:
        """Replace runs of an appended table by one run with their rows, less those that meet ``condition``.

        Without a condition all runs become one; with one, only the runs that hold such rows. Runs that other writers
        commit meanwhile stay as they are.
        """
        if partition_by:
            schema = T.StructType(schema.fields + [T.StructField(partition_by, T.IntegerType())])
        paths = [path for _, path in self._committed(table)]
        if condition is not None and paths:
            run = F.regexp_extract(F.input_file_name(), "/run=([^/]+)/", 1)
            hit = self._read(table, schema, paths).filter(condition).select(run.alias("run")).distinct()
            names = {row["run"] for row in hit.collect()}
            paths = [path for path in paths if path.rsplit("/run=", 1)[1] in names]
        if not paths:
            return
        rows = self._read(table, schema, paths).select(*_names(schema))
        if condition is not None:
            rows = rows.filter(~F.coalesce(condition, F.lit(False)))
        if partition_by:
            rows = rows.hint("rebalance", partition_by)
        replaced = [(path.rsplit("/run=", 1)[1],) for path in paths]
        # In the place of the newest run it replaces: the order of the runs, and so of their keys, stays.
        number = max(int(name.split("-")[0]) for name, in replaced)
        name = f"{number:06d}-{uuid.uuid4().hex}-rewrite"
        self.spark.createDataFrame(replaced, "value string").coalesce(1).write.text(f"{self.root}/{table}/_replaced/{name}")
        self._commit(rows, f"{self.root}/{table}/run={name}", partition_by)

    def _read(self, table: str, schema: T.StructType, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def replaced(self, table: str, schema: T.StructType) -> DataFrame:
        return self._read(table, schema, [path for _, path in self._committed(table)[-1:]]).select(*_names(schema))

    def appended(
        self, table: str, schema: T.StructType, partition_by: str | None = None, since_run: int = 0
    ) -> DataFrame:
        """All rows, or those of the runs after ``since_run``. The partition column stays on the result."""
        columns = _names(schema)
        if partition_by:
            schema = T.StructType(schema.fields + [T.StructField(partition_by, T.IntegerType())])
            columns = columns + [partition_by]
        paths = [path for number, path in self._committed(table) if number > since_run]
        return self._read(table, schema, paths).select(*columns)

    def current(self, table: str, schema: T.StructType) -> DataFrame:
        """Open rows of a versioned dimension; closed rows are not even listed."""
        runs = self._committed(table)
        paths = self._glob(f"{runs[-1][1]}/open=true") if runs else []
        return self._read(table, schema, paths).select(*_names(schema))

    def versions(self, table: str, schema: T.StructType) -> DataFrame:
        """Open and closed rows of a versioned dimension."""
        runs = self._committed(table)
        paths = self._glob(f"{runs[-1][1]}/open=true") if runs else []
        for _, path in runs:
            paths += self._glob(f"{path}/open=false")
        return self._read(table, schema, paths).select(*_names(schema))

    def write_versions(self, table: str, rows: DataFrame) -> int:
        return self.write(table, rows.withColumn("open", F.col("valid_to") == F.lit(OPEN_END)), "open")

    def expire(self, table: str, keep: int = 2, versioned: bool = False) -> None:
        """Drop what newer runs have replaced, keeping the last ``keep`` runs for readers still at work.

        Of a versioned dimension only the old current parts go; the rows closed by each run are its history.
        """
        for _, path in self._committed(table)[:-keep]:
            self._delete(f"{path}/open=true" if versioned else path)

    def highest_key(self, table: str, key: str) -> int:
        """Largest surrogate key handed out so far.

        Keys grow with the runs, so only the newest run that has rows needs a look, and of it only one column.
        """
        for _, path in reversed(self._committed(table)):
            files = self.spark.read.schema(T.StructType([T.StructField(key, T.LongType())]))
            highest = files.parquet(path).agg(F.max(key)).first()[0]
            if highest is not None:
                return highest
        return 0


def _names(schema: T.StructType) -> list[str]:
    return [f"`{name}`" for name in schema.names]
