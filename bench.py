"""Seconds per headline query, one JSON line.

Every query runs once to warm up the JVM and is then timed from building the plan to writing all result rows to
Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from tillwise.registry.queries import queries
from tillwise.session import local_session

HEADLINE = [
    "summary",
    "period_revenue",
    "period_revenue_trend",
    "orders_heatmap",
    "heatmap_matrix",
    "carrier_revenue",
    "top_manufacturers",
    "market_group_share",
    "gender_distribution",
    "age_distribution",
    "product_group_revenue",
    "customers_above_median",
    "menu_months",
    "dim_customer_load",
    "dim_product_load",
    "bridge_load",
    "fact_cart_line_load",
    "fact_order_line_load",
    "fact_order_history_load",
    "fact_order_load",
    "reconcile_orders",
    "extract_sg_customer",
    "extract_sg_orders",
    "extract_sg_order_detail",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tillwise-bench")
    registered = queries()

    def run(name: str) -> float:
        started = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
