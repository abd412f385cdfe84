"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.session import configure, shared_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings, whose Python workers find this package where the driver found it."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH")]))
    return configure(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    It cuts the lineage and fixes the rows: a lost executor rereads the files, and row ids made before the write stay.
    The shuffle files of the write go with its end. Otherwise they stay until the driver happens to collect its garbage,
    and those of many steps add up on disk.
    """
    spark = df.sparkSession
    path, usual = scratch_path(spark, label), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if usual is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, usual)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the filter of ``with_ids``: 2**20 numbers of 64 bits, whatever the number of ids.
FILTER_BITS = 1 << 26


def with_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` (NULL included) is in the column of that name of ``ids``.

    Wide rows should not travel to find out that they aren't wanted. So the hashes of the ids, as a bitmap of bounded
    size, are broadcast first; the few rows that pass are then joined with the ids themselves.
    """

    def places() -> tuple[Column, Column]:
        bucket = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
        return F.shiftright(bucket, 6), (bucket % 64).cast("int")

    word, bit = places()
    bits = ids.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__bit"))
    bitmap = bits.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    word, bit = places()
    passed = df.join(F.broadcast(bitmap), word == F.col("__word")).filter(F.getbit("__bits", bit) == 1).select(df.columns)
    # Not a semi join: the optimizer would do that first, and then all wide rows travel.
    wanted = ids.select(F.col(column).alias("__id")).distinct()
    return passed.join(wanted, F.col(column).eqNullSafe(F.col("__id"))).select(df.columns)


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with its columns numbered, for functions that pass whole rows through: any name is possible in ``df``."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files behind tables that ``stored`` wrote, once nothing reads them any more."""
    root = shared_dir(spark).rstrip("/").rsplit(":", 1)[-1].lstrip("/")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()}:
        if root in folder:  # never a table of the user
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
