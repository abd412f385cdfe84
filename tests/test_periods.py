import datetime as dt

import pytest

from tillwise.plans.periods import DAY_LABEL, MONTH_LABEL, Period, period

AS_OF = dt.date(2024, 8, 15)


def d(text):
    return dt.date.fromisoformat(text)


@pytest.mark.parametrize(
    "args, start, end, label",
    [
        (("month", "2024-2"), "2024-02-01", "2024-02-29", DAY_LABEL),
        (("month", "x-y"), "2024-08-01", "2024-08-31", DAY_LABEL),
        (("quarter", "2023-4"), "2023-10-01", "2023-12-31", MONTH_LABEL),
        (("quarter", "soon"), "2024-07-01", "2024-09-30", MONTH_LABEL),
        (("year", "2022"), "2022-01-01", "2022-12-31", MONTH_LABEL),
        (("year", "now"), "2024-01-01", "2024-12-31", MONTH_LABEL),
        ((None, None), "2024-01-01", "2024-12-31", MONTH_LABEL),
        (("range", None, "2024-01-05", "2024-02-06"), "2024-01-05", "2024-02-06", DAY_LABEL),
        (("range", None, "bad", "2024-02-06"), "2024-08-15", "2024-08-15", DAY_LABEL),
        (("other", "2021"), "2021-01-01", "2021-12-31", MONTH_LABEL),
    ],
)
def test_period_kinds(args, start, end, label):
    assert period(*args, as_of=AS_OF) == Period(d(start), d(end), label)


def test_range_needs_both_bounds():
    with pytest.raises(ValueError):
        period("range", start="2024-01-01", as_of=AS_OF)


def test_overlap(spark):
    df = spark.sql(
        "SELECT DATE '2024-01-31' AS valid_from, DATE '9999-12-31' AS valid_to UNION ALL "
        "SELECT DATE '2024-03-01', DATE '9999-12-31' UNION ALL SELECT DATE '2020-01-01', DATE '2024-01-31'"
    )
    assert df.filter(period("month", "2024-2", as_of=AS_OF).overlaps()).count() == 1
    assert period("quarter", "2024-1", as_of=AS_OF).months == (202401, 202403)


@pytest.mark.parametrize("request_", [("quarter", "2024-5"), ("month", "2024-13"), ("year", "0"), ("range", None, "2024-02-02", "2024-01-01")])
def test_numbers_that_name_no_period_are_refused(request_):
    with pytest.raises(ValueError, match="there is no|before its start"):
        period(*request_, as_of=dt.date(2024, 1, 1))
