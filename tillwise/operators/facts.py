"""Insert-only fact loading."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incremental_append(stage: DataFrame, fact: DataFrame, keys: list[str]) -> DataFrame:
    """Stage rows whose key is not in the fact yet. Repeats inside the batch are kept.

    Known keys are made distinct first, so copies in the fact are combined map-side. The anti join is a plain one: where
    a key holds many stage rows, AQE splits its partition by the map tasks that wrote it.
    """
    known = fact.select(*keys).distinct()
    return stage.join(known, keys, "left_anti").select(*stage.columns)


def resolved(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))


def rejected(df: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that a load drops because a dimension key is missing, with the name of the first missing one."""
    missing = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(k)) for k in keys])
    return df.filter(reduce(or_, [F.col(k).isNull() for k in keys])).withColumn("missing_key", missing)


def delete_where(df: DataFrame, condition) -> DataFrame:
    """Rows that remain after deleting those meeting ``condition`` (NULL counts as not met)."""
    return df.filter(~F.coalesce(condition, F.lit(False)))
