import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillwise.functions.cleanse import blank_to_null, blank_to_unknown, cleanse, labelled, row_hash, stated_gender
from tillwise.functions.dates import DAY_PART_ORDER, age_decade, day_part, full_years, position_in


def test_cleansing_kinds(spark):
    raw = spark.createDataFrame(
        [
            ("2024-05-01 10:20:30", "1990-02-28", 1, "Acme s.r.o.", None, None),
            ("0000-00-00 00:00:00", "0000-00-00", 0, None, 7, 20.5),
            (None, None, None, "x", 3, 1.0),
        ],
        "added string, born string, flag int, company string, id_order long, rate double",
    )
    kinds = {"added": "moment", "born": "day", "flag": "flag", "company": "hashed", "id_order": "id_or_0",
             "rate": "rate_or_0"}
    out = cleanse(raw, kinds)
    assert [f.dataType.simpleString() for f in out.schema] == [
        "timestamp", "date", "boolean", "string", "bigint", "decimal(20,6)"
    ]
    got = out.withColumn("rate", F.col("rate").cast("double")).collect()
    sha = hashlib.sha256("Acme s.r.o.".encode()).hexdigest()
    assert tuple(got[0]) == (dt.datetime(2024, 5, 1, 10, 20, 30), dt.date(1990, 2, 28), True, sha, 0, 0.0)
    assert tuple(got[1]) == (None, None, False, None, 7, 20.5)
    assert tuple(got[2])[:3] == (None, None, None)


def test_cleansing_accepts_typed_sources_and_rejects_malformed_text(spark):
    typed = spark.sql("SELECT TIMESTAMP '2024-01-02 03:04:05' AS added, DATE '2024-01-02' AS born")
    assert rows(cleanse(typed, {"added": "moment", "born": "day"})) == [
        (dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 1, 2))
    ]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cleanse(spark.sql("SELECT 'yesterday' AS added"), {"added": "moment"}).collect()


def test_text_rules(spark):
    df = spark.createDataFrame([("",), (None,), ("Pán",), ("[neuvádzam]",)], "v string")
    got = df.select(
        blank_to_null("v"), blank_to_unknown("v"), stated_gender("v"), labelled(F.col("v"), {"Pán": "Muž"})
    )
    assert rows(got) == [
        (None, "Unknown", "", ""),
        (None, "Unknown", None, "Neuvedené"),
        ("Pán", "Pán", "Pán", "Muž"),
        ("[neuvádzam]", "[neuvádzam]", None, "[neuvádzam]"),
    ]


def test_row_hash_writes_missing_values_out(spark):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    assert rows(df.select(row_hash("a", "b"))) == [(hashlib.md5(b"1-None").hexdigest(),)]


def test_age_counts_completed_years(spark):
    df = spark.sql("SELECT DATE '2000-02-29' AS b, DATE '2021-02-28' AS t UNION ALL SELECT DATE '2000-02-29', DATE '2021-03-01'")
    got = rows(df.select(full_years(F.col("b"), F.col("t")), age_decade(F.col("b"), F.col("t"))), F.col("t"))
    assert got == [(20, 20), (21, 20)]


def test_day_parts(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("h"))
    got = dict(rows(df.groupBy(day_part(F.col("h")).alias("p")).agg(F.concat_ws(",", F.sort_array(F.collect_list("h"))))))
    assert got["Night"] == "0,1,2,3,4,5"
    assert got["Morning"].startswith("6,") and got["Morning"].endswith(",11")
    assert got["Evening"].endswith(",23")
    assert rows(spark.range(1).select(position_in(F.lit("Evening"), DAY_PART_ORDER))) == [(3,)]
