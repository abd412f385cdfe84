"""Catalog of the reports a user can ask for."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.plans import reports
from tillwise.plans.periods import Period
from tillwise.plans.warehouse import Warehouse


@dataclass(frozen=True)
class Report:
    title: str
    data_type: str
    diagram_type: str
    build: Callable[[Warehouse, Period, dt.date, dict[str, str]], DataFrame]
    choices: dict[str, str] = field(default_factory=dict)
    order: Callable[[], list[Column]] = list


def _group_revenue(dw: Warehouse, period: Period, as_of: dt.date, choices: dict[str, str]) -> DataFrame:
    return reports.product_choice_revenue(dw, period, choices)


# Report names, titles and choice titles as users know them.
REPORTS: dict[str, Report] = {
    "gender_distribution": Report(
        "Rozdelenie zákazníkov podľa pohlavia", "diagram", "bar",
        lambda dw, period, as_of, choices: reports.gender_distribution(dw, period),
    ),
    "age_distribution": Report(
        "Priemerná suma objednávky podľa veku zákazníkov", "diagram", "pie",
        lambda dw, period, as_of, choices: reports.age_distribution(dw, period, as_of),
    ),
    "product_group_revenue": Report(
        "Príjmy z marketingových kampaní", "diagram", "bar", _group_revenue,
        {"market_group": "Marketingová kampaň", "market_subgroup": "Marketingová podkampaň"},
    ),
    "product_gender_revenue": Report(
        "Príjmy podľa rodovej kategórie tovaru", "diagram", "bar", _group_revenue,
        {"market_gender": "Rodová kategória"},
    ),
    "top_customers_above_median_csv": Report(
        "Top zákazníci nad mediánom", "table", "bar",
        lambda dw, period, as_of, choices: reports.customers_above_median(dw, period),
        order=lambda: [F.desc_nulls_first("total_spent"), F.asc("customer_id")],
    ),
}


def check_choices(name: str, choices: dict[str, str] | None) -> None:
    unknown = set(choices or {}) - set(REPORTS[name].choices)
    if unknown:
        raise ValueError(f"{name} has no choices {sorted(unknown)}")


def build_report(
    name: str, dw: Warehouse, period: Period, as_of: dt.date, choices: dict[str, str] | None = None
) -> DataFrame:
    check_choices(name, choices)
    return REPORTS[name].build(dw, period, as_of, choices or {})
