"""Field-by-field comparison of a source with the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(
    source: DataFrame, fact: DataFrame, key: list[str], fields: list[str], since: tuple[str, int] | None = None
) -> DataFrame:
    """Mismatches between two tables holding the same business keys and fields.

    Columns: the key, ``status`` (missing / unexpected / different), ``field``, ``expected``, ``actual``, ``rows``.
    ``since`` = (surrogate column, last key) compares only fact rows above a high-water mark.

    Equal rows cancel out in one aggregation that is combined map-side, so repeated rows and hot keys stay cheap and
    only real mismatches reach the second step. A key with exactly one leftover row on each side is reported field by
    field, any other leftover by its number of rows.
    """
    if since:
        fact = fact.filter(F.col(since[0]) > since[1])
    types = {f.name: f.dataType for f in source.schema.fields}
    columns = [*key, *fields]
    actual = fact.select(*[F.col(c).cast(types[c]).alias(c) for c in columns])
    both = source.select(*columns, F.lit(1).alias("_sign")).unionByName(actual.withColumn("_sign", F.lit(-1)))
    leftover = both.groupBy(*columns).agg(F.sum("_sign").alias("_net")).filter(F.col("_net") != 0)

    texts = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    sided = leftover.select(
        *key,
        F.greatest("_net", F.lit(0)).alias("_missing"),
        F.greatest(-F.col("_net"), F.lit(0)).alias("_unexpected"),
        F.when(F.col("_net") > 0, texts).alias("_expected"),
        F.when(F.col("_net") < 0, texts).alias("_actual"),
    )
    per_key = sided.groupBy(*key).agg(
        F.sum("_missing").alias("_missing"),
        F.sum("_unexpected").alias("_unexpected"),
        F.max("_expected").alias("_expected"),
        F.max("_actual").alias("_actual"),
    )

    def finding(status: str, rows, field=None, expected=None, actual=None):
        return F.struct(
            F.lit(status).alias("status"),
            F.lit(field).cast("string").alias("field"),
            (expected if expected is not None else F.lit(None)).cast("string").alias("expected"),
            (actual if actual is not None else F.lit(None)).cast("string").alias("actual"),
            rows.cast("long").alias("rows"),
        )

    differing = F.array(
        *[
            F.when(
                ~F.col(f"_expected.{f}").eqNullSafe(F.col(f"_actual.{f}")),
                finding("different", F.lit(1), f, F.col(f"_expected.{f}"), F.col(f"_actual.{f}")),
            )
            for f in fields
        ]
    )
    one_each = (F.col("_missing") == 1) & (F.col("_unexpected") == 1)
    counts = F.array(
        F.when(F.col("_missing") > 0, finding("missing", F.col("_missing"))),
        F.when(F.col("_unexpected") > 0, finding("unexpected", F.col("_unexpected"))),
    )
    findings = F.filter(F.when(one_each, differing).otherwise(counts), lambda f: f.isNotNull())
    return per_key.select(*key, F.explode(findings).alias("_f")).select(*key, "_f.*")


def high_water_mark(df: DataFrame, key: str) -> DataFrame:
    """Largest key, 0 for an empty table, as one row."""
    return df.agg(F.coalesce(F.max(key), F.lit(0)).alias("last_key"))
