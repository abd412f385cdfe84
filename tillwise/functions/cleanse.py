"""Cleansing rules for raw shop columns.

Each rule takes a column and its source type and returns the cleansed column. Casts stay strict: apart from the
planted "no value" markers a malformed value fails the load instead of turning into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.schemas import MONEY

# Markers the shop database and the dimension loads treat as "no value".
ZERO_TIMESTAMP = "0000-00-00 00:00:00"
ZERO_DATE = "0000-00-00"
GENDER_NOT_STATED = "[neuvádzam]"
UNKNOWN = "Unknown"
# Display labels of the gender report.
GENDER_LABELS = {"Pán": "Muž", "Pani": "Žena"}
NOT_STATED = "Neuvedené"


def _without(column: Column, source: T.DataType, marker: str) -> Column:
    return F.nullif(column, F.lit(marker)) if isinstance(source, T.StringType) else column


def zero_timestamp(column: Column, source: T.DataType) -> Column:
    return _without(column, source, ZERO_TIMESTAMP).cast("timestamp")


def zero_date(column: Column, source: T.DataType) -> Column:
    return _without(column, source, ZERO_DATE).cast("date")


def hashed(column: Column, source: T.DataType) -> Column:
    return F.sha2(column.cast("string"), 256)


# kind -> (target type, rule); a kind without a rule is a plain cast to the target type.
KINDS = {
    "id": (T.LongType(), None),
    "int": (T.IntegerType(), None),
    "text": (T.StringType(), None),
    "money": (MONEY, None),
    "flag": (T.BooleanType(), None),
    "moment": (T.TimestampType(), zero_timestamp),
    "day": (T.DateType(), zero_date),
    "hashed": (T.StringType(), hashed),
    "id_or_0": (T.LongType(), lambda c, _: F.coalesce(c.cast("long"), F.lit(0).cast("long"))),
    "rate_or_0": (MONEY, lambda c, _: F.coalesce(c.cast(MONEY), F.lit(0).cast(MONEY))),
}


def cleanse(df: DataFrame, columns: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` to ``columns`` (name -> kind), applying the rule of each kind, and the columns of ``keep`` as they are."""
    source = {field.name: field.dataType for field in df.schema.fields}
    projected = []
    for name, kind in columns.items():
        target, rule = KINDS[kind]
        column = F.col(f"`{name}`")
        cleansed = rule(column, source[name]) if rule else column.cast(target)
        projected.append(cleansed.alias(name))
    return df.select(*projected, *[F.col(f"`{name}`") for name in keep])


def stage_schema(columns: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, KINDS[kind][0]) for name, kind in columns.items()])


def blank_to_null(column: Column | str) -> Column:
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(""))


def blank_to_unknown(column: Column | str) -> Column:
    return F.coalesce(blank_to_null(column), F.lit(UNKNOWN))


def stated_gender(column: Column | str) -> Column:
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(GENDER_NOT_STATED))


def labelled(column: Column, labels: dict[str, str] | None = None, missing: str = NOT_STATED) -> Column:
    """Relabel known values, keep others, and name the NULL group."""
    out = column
    for value, label in (labels or {}).items():
        out = F.when(column == value, F.lit(label)).otherwise(out)
    return F.coalesce(out, F.lit(missing))


def row_hash(*columns: str) -> Column:
    """MD5 over the ``-``-joined text of the columns, NULL written as ``None``.

    For exchanging fingerprints with other tools only: the loads compare typed columns, because joined text is
    ambiguous.
    """
    return F.md5(F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]))


def number_or_zero(column: Column) -> Column:
    return F.coalesce(column.try_cast("double"), F.lit(0.0))
