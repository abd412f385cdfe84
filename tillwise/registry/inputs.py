"""Star schema, stage and raw shop tables derived from the driver tables.

Each input is one SELECT in the SQL that Spark and DuckDB share, so that both sides of a comparison start from the same
rows. Scenario columns (blank values, changed rows, unknown keys) are planted with CASE over the key; every input keeps
all rows of its table.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from tillwise.sources.extract import SPECS

CALENDAR_START = dt.date(1990, 1, 1)
CALENDAR_END = dt.date(2030, 12, 31)

_SPARK_DAY = "datediff(CAST({0} AS DATE), DATE '1990-01-01') + 1"
_DUCKDB_DAY = "(CAST({0} AS DATE) - DATE '1990-01-01') + 1"

TABLES = "region nation customer supplier part orders lineitem events".split()

# Money is computed in whole cents and hundredths, which is exact and much faster than casting doubles to decimals.
_CENTS = "CAST(ROUND({0} * 100) AS BIGINT)"
_NET = f"{_CENTS.format('l_extendedprice')} * (100 - {_CENTS.format('l_discount')})"
_UNTAXED = f"CAST(CAST({_NET} AS DECIMAL(20,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(20,6))"
_TAXED = (
    f"CAST(CAST({_NET} * (100 + {_CENTS.format('l_tax')}) AS DECIMAL(20,0)) * CAST(0.000001 AS DECIMAL(7,6)) "
    "AS DECIMAL(20,6))"
)
_PRICE = f"CAST(CAST({_CENTS.format('o_totalprice')} AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(20,6))"
_OPEN = "DATE '9999-12-31'"



def _batches(select: str, *changes: tuple[int, int]) -> str:
    """The same rows in several batches, added (1) or withdrawn (0) by each."""
    return "".join(f"UNION ALL {select.format(batch=batch, added=added)} " for batch, added in changes)


INPUTS: dict[str, str] = {
    # Texts that are hard to keep in a CSV file
    "part_texts": """
        SELECT p_partkey AS part_id,
               CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' || p_name || ' '
                    WHEN 3 THEN p_name || chr(10) || 'second "line"' WHEN 4 THEN '"' || p_name || '"'
                    WHEN 5 THEN p_name || ', x; y' ELSE p_name END AS name
        FROM {part}""",
    # Star schema
    "dim_product": f"""
        SELECT p_partkey AS product_key, p_partkey AS productid_bk, p_partkey % 7 AS productattributeid_bk,
               p_name AS productname, p_brand AS manufacturer, p_type AS defaultcategory,
               CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_type END AS market_group,
               CASE WHEN p_size % 6 = 0 THEN NULL ELSE 'size ' || CAST(p_size % 6 AS STRING) END AS market_subgroup,
               CASE p_partkey % 4 WHEN 1 THEN 'Men' WHEN 2 THEN 'Women' WHEN 3 THEN 'Unisex' END AS market_gender,
               CAST(p_retailprice AS DECIMAL(20,6)) AS price, p_size > 3 AS active,
               DATE '1990-01-01' + CAST(p_partkey * 13 % 3000 AS INT) AS valid_from,
               CASE WHEN p_partkey % 5 = 0 THEN DATE '1996-01-01' + CAST(p_partkey * 13 % 3000 AS INT)
                    ELSE {_OPEN} END AS valid_to
        FROM {{part}}""",
    "dim_customer": f"""
        SELECT c_custkey AS customer_key, c_custkey AS customerid_bk,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'Pán' WHEN 'AUTOMOBILE' THEN 'Pani' WHEN 'MACHINERY' THEN NULL
                    ELSE c_mktsegment END AS gender,
               DATE '1940-01-01' + CAST(c_custkey * 17 % 25000 AS INT) AS birthdate, c_acctbal >= 0 AS active,
               DATE '1990-01-01' + CAST(c_custkey * 11 % 4000 AS INT) AS valid_from,
               CASE WHEN c_custkey % 6 = 0 THEN DATE '1994-01-01' + CAST(c_custkey * 11 % 4000 AS INT)
                    ELSE {_OPEN} END AS valid_to
        FROM {{customer}}""",
    "fact_order": f"""
        SELECT o_orderkey AS orderid_bk, o_custkey AS customer_sk, o_custkey AS address_sk,
               CAST({{order_day}} AS BIGINT) AS date_sk, o_orderkey % 24 + 1 AS time_sk,
               {_PRICE} AS paid_tax_incl, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS carrier
        FROM {{orders}}""",
    "fact_order_history": """
        SELECT o_orderkey * 2 AS orderhistoryid_bk, o_orderkey AS orderid_bk,
               CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 18 END AS orderstateid_bk,
               CAST({order_day} + 1 AS BIGINT) AS date_sk, o_orderkey % 24 + 1 AS time_sk
        FROM {orders}
        UNION ALL
        SELECT o_orderkey * 2 + 1 AS orderhistoryid_bk, o_orderkey AS orderid_bk,
               CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 3 END AS orderstateid_bk,
               CAST({order_day} + 1 AS BIGINT) AS date_sk, o_orderkey % 24 + 1 AS time_sk
        FROM {orders}""",
    "fact_order_line": f"""
        SELECT l_orderkey AS orderid_bk, l_orderkey * 10 + l_linenumber AS orderdetailid_bk, l_partkey AS product_sk,
               CAST({{ship_day}} AS BIGINT) AS date_sk, CAST(l_quantity AS INT) AS quantity,
               {_UNTAXED} AS amount, {_TAXED} AS amount_tax_incl
        FROM {{lineitem}}""",
    "fact_cart_line": """
        SELECT user_id * 100 + dayofmonth(ts) AS cartid_bk, event_id % 100 AS product_sk, user_id AS customer_sk,
               CAST({event_day} AS BIGINT) AS date_sk, CAST(hour(ts) + 1 AS BIGINT) AS time_sk, 1 AS quantity
        FROM {events}""",
    # Stage and existing dimension rows for the dimension loads
    "sg_country": """
        SELECT CAST(n_nationkey AS BIGINT) AS id_country, CASE WHEN n_nationkey % 8 = 3 THEN '' ELSE n_name END AS name
        FROM {nation}""",
    "sg_state": "SELECT CAST(r_regionkey AS BIGINT) AS id_state, r_name AS name FROM {region}",
    "sg_address": """
        SELECT c_custkey AS id_address, c_custkey % 1000 AS id_customer, CAST(c_nationkey AS BIGINT) AS id_country,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey % 4 AS BIGINT) END AS id_state,
               CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'City ' || CAST(c_custkey % 40 AS STRING) END AS city,
               LPAD(CAST(c_custkey % 90000 AS STRING), 5, '0') AS postcode,
               CASE WHEN c_custkey % 4 = 0 THEN NULL
                    ELSE CAST(DATE '2015-01-01' + CAST(c_custkey % 900 AS INT) AS TIMESTAMP) END AS date_add
        FROM {customer}""",
    "dim_address_before": f"""
        SELECT c_custkey + 100 AS address_key,
               CASE WHEN c_custkey % 13 = 0 THEN -c_custkey - 1 ELSE c_custkey END AS addressid_bk,
               c_custkey % 999 AS customerid_bk,
               CASE WHEN c_nationkey % 8 = 3 THEN NULL ELSE 'NATION_' || CAST(c_nationkey AS STRING) END AS country,
               CASE WHEN c_custkey % 5 = 0 THEN NULL
                    ELSE CASE c_nationkey % 4 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA'
                         ELSE 'EUROPE' END END AS state,
               CASE WHEN c_custkey % 10 = 0 THEN 'Old town' WHEN c_custkey % 9 = 0 THEN NULL
                    ELSE 'City ' || CAST(c_custkey % 40 AS STRING) END AS city,
               CASE WHEN c_custkey % 97 = 0 THEN NULL
                    ELSE LPAD(CAST(c_custkey % 90000 AS STRING), 5, '0') END AS zipcode,
               DATE '2000-01-01' AS valid_from,
               CASE WHEN c_custkey % 17 = 0 THEN DATE '2021-06-30' ELSE {_OPEN} END AS valid_to
        FROM {{customer}}""",
    "sg_group": "SELECT CAST(n_nationkey AS BIGINT) AS id_group, n_name AS name FROM {nation}",
    "sg_customer_group": """
        SELECT c_custkey AS id_customer, CAST(c_nationkey * 2 AS BIGINT) AS id_group FROM {customer}""",
    "sg_gender": """
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS id_gender,
               CASE r_regionkey WHEN 0 THEN 'Pán' WHEN 1 THEN 'Pani' WHEN 2 THEN '[neuvádzam]' ELSE r_name END AS name
        FROM {region}""",
    "sg_customer_company": "SELECT c_custkey * 3 AS id_customer FROM {customer}",
    "sg_customer": """
        SELECT c_custkey AS id_customer, 'login ' || CAST(c_custkey AS STRING) AS hashed_login,
               CAST(c_nationkey AS BIGINT) AS id_default_group,
               DATE '1940-01-01' + CAST(c_custkey * 17 % 25000 AS INT) AS birthday,
               CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'MACHINERY' THEN 3 END
                    AS BIGINT) AS id_gender,
               c_acctbal >= 0 AS active,
               CASE WHEN c_custkey % 4 = 0 THEN NULL
                    ELSE CAST(DATE '2015-01-01' + CAST(c_custkey % 900 AS INT) AS TIMESTAMP) END AS date_add
        FROM {customer}""",
    "dim_customer_before": f"""
        SELECT c_custkey + 100 AS customer_key,
               CASE WHEN c_custkey % 13 = 0 THEN -c_custkey - 1 ELSE c_custkey END AS customerid_bk,
               CASE WHEN c_custkey % 10 = 0 THEN 'old login' ELSE 'login ' || CAST(c_custkey AS STRING) END
                   AS hashedemail,
               CASE WHEN c_nationkey % 2 = 0 THEN 'NATION_' || CAST(c_nationkey AS STRING) END AS defaultgroup,
               CASE WHEN c_custkey % 97 = 0 THEN NULL
                    ELSE DATE '1940-01-01' + CAST(c_custkey * 17 % 25000 AS INT) END AS birthdate,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'Pán' WHEN 'AUTOMOBILE' THEN 'Pani' END AS gender,
               c_custkey % 3 = 0 AS businessaccount, c_acctbal >= 0 AS active, DATE '2000-01-01' AS valid_from,
               CASE WHEN c_custkey % 17 = 0 THEN DATE '2021-06-30' ELSE {_OPEN} END AS valid_to
        FROM {{customer}}""",
    "sg_manufacturer": """
        SELECT CAST(n_nationkey AS BIGINT) AS id_manufacturer,
               CASE WHEN n_nationkey % 8 = 0 THEN '' ELSE n_name END AS name
        FROM {nation}""",
    "sg_category": """
        SELECT CAST(r_regionkey AS BIGINT) AS id_category, 'Category ' || CAST(r_regionkey AS STRING) AS name
        FROM {region}""",
    "sg_product": """
        SELECT p_partkey AS id_product, NULLIF(p_partkey % 7, 0) AS id_product_attribute,
               CAST(p_size AS BIGINT) AS id_manufacturer, p_partkey % 10 AS id_category_default, p_name AS name,
               p_type AS "group", CASE WHEN p_size % 6 = 0 THEN '' ELSE 'size ' || CAST(p_size % 6 AS STRING) END
                   AS subgroup,
               CASE p_partkey % 4 WHEN 1 THEN 'Men' WHEN 2 THEN 'Women' WHEN 3 THEN '' END AS gender,
               CAST(p_retailprice AS DECIMAL(20,6)) AS price, p_size > 3 AS active,
               CASE WHEN p_partkey % 4 = 0 THEN NULL
                    ELSE CAST(DATE '2015-01-01' + CAST(p_partkey % 900 AS INT) AS TIMESTAMP) END AS date_add
        FROM {part}""",
    "dim_product_before": f"""
        SELECT p_partkey + 100 AS product_key,
               CASE WHEN p_partkey % 13 = 0 THEN -p_partkey - 1 ELSE p_partkey END AS productid_bk,
               p_partkey % 7 AS productattributeid_bk, p_name AS productname,
               CASE WHEN p_size < 25 AND p_size % 8 <> 0 THEN 'NATION_' || CAST(p_size AS STRING) END AS manufacturer,
               CASE WHEN p_partkey % 10 < 5 THEN 'Category ' || CAST(p_partkey % 10 AS STRING) END AS defaultcategory,
               CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_type END AS market_group,
               CASE WHEN p_size % 6 = 0 THEN NULL ELSE 'size ' || CAST(p_size % 6 AS STRING) END AS market_subgroup,
               CASE p_partkey % 4 WHEN 1 THEN 'Men' WHEN 2 THEN 'Women' END AS market_gender,
               CASE WHEN p_partkey % 10 = 0 THEN CAST(1.5 AS DECIMAL(20,6))
                    ELSE CAST(p_retailprice AS DECIMAL(20,6)) END AS price,
               p_size > 3 AS active, DATE '2000-01-01' AS valid_from,
               CASE WHEN p_partkey % 17 = 0 THEN DATE '2021-06-30' ELSE {_OPEN} END AS valid_to
        FROM {{part}}""",
    "sg_order_state": """
        SELECT CAST(n_nationkey AS BIGINT) AS id_order_state, 'State ' || n_name AS name FROM {nation}""",
    "dim_order_state_before": f"""
        SELECT CAST(n_nationkey + 100 AS BIGINT) AS orderstate_key,
               CAST(CASE WHEN n_nationkey % 7 = 0 THEN -n_nationkey - 1 ELSE n_nationkey END AS BIGINT)
                   AS orderstateid_bk,
               CASE WHEN n_nationkey % 5 = 0 THEN 'Old state' ELSE 'State ' || n_name END AS current_state,
               DATE '2000-01-01' AS valid_from,
               CASE WHEN n_nationkey % 11 = 0 THEN DATE '2021-06-30' ELSE {_OPEN} END AS valid_to
        FROM {{nation}}""",
    "sg_attribute_group": """
        SELECT CAST(n_nationkey AS BIGINT) AS id_attribute_group,
               CASE WHEN n_nationkey % 8 = 0 THEN '' ELSE n_name END AS name
        FROM {nation}""",
    "sg_attribute": """
        SELECT p_partkey AS id_attribute, p_partkey % 30 AS id_attribute_group,
               CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 12 = 0 THEN NULL ELSE p_name END AS name
        FROM {part}""",
    "dim_attribute_before": """
        SELECT p_partkey + 100 AS attribute_key,
               CASE WHEN p_partkey % 13 = 0 THEN -p_partkey - 1 ELSE p_partkey END AS attributeid_bk,
               CASE WHEN p_partkey % 10 = 0 THEN 'old name' ELSE p_name END AS attribute_name,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS attribute_group
        FROM {part}""",
    # Stage and existing rows for the bridge and fact loads
    "sg_product_attribute_combination": """
        SELECT l_partkey AS id_product_attribute, l_suppkey AS id_attribute FROM {lineitem}""",
    "product_versions": """
        SELECT p_partkey AS product_key, p_partkey % 1000 AS productattributeid_bk FROM {part}""",
    "attributes_loaded": "SELECT s_suppkey + 500 AS attribute_key, s_suppkey AS attributeid_bk FROM {supplier}",
    "bridge_before": """
        SELECT l_partkey AS product_sk, CASE WHEN l_orderkey % 3 = 0 THEN l_suppkey + 500 ELSE -1 END AS attribute_sk
        FROM {lineitem}""",
    "sg_cart": """
        SELECT CASE WHEN event_id % 31 = 0 THEN -event_id - 1 ELSE event_id END AS id_cart, user_id AS id_customer,
               CAST(ts AS TIMESTAMP) AS date_add
        FROM {events}""",
    "sg_cart_product": """
        SELECT event_id AS id_cart, event_id % 300 AS id_product, event_id % 300 % 7 AS id_product_attribute,
               CAST(event_id % 3 + 1 AS INT) AS quantity
        FROM {events}""",
    "cart_lines_before": """
        SELECT CASE WHEN event_id % 3 = 0 THEN event_id ELSE -event_id - 1 END AS cartid_bk,
               event_id % 300 AS productid_bk, event_id % 300 % 7 AS productattributeid_bk, user_id AS customerid_bk
        FROM {events}""",
    "address_versions": f"""
        SELECT c_custkey * 2 AS address_key, c_custkey AS addressid_bk, DATE '2010-01-01' AS valid_to FROM {{customer}}
        UNION ALL
        SELECT c_custkey * 2 + 1 AS address_key, c_custkey AS addressid_bk,
               CASE WHEN c_custkey % 3 = 0 THEN DATE '2015-01-01' ELSE {_OPEN} END AS valid_to
        FROM {{customer}}""",
    "sg_orders": f"""
        SELECT o_orderkey AS id_order, o_orderkey + 7 AS id_cart, o_custkey AS id_customer,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS id_address_delivery,
               CAST(o_orderdate AS TIMESTAMP) AS date_add, {_PRICE} AS total_paid_tax_incl,
               {_PRICE} AS total_paid_tax_excl, CAST(1 AS DECIMAL(20,6)) AS conversion_rate,
               CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS carrier,
               o_orderstatus AS payment
        FROM {{orders}}""",
    "sg_order_detail": f"""
        SELECT l_orderkey AS id_order, l_orderkey * 10 + l_linenumber AS id_order_detail, l_partkey AS product_id,
               l_partkey % 7 AS product_attribute_id, CAST(l_quantity AS INT) AS product_quantity,
               CAST(l_extendedprice AS DECIMAL(20,6)) AS unit_price_tax_excl, {_TAXED} AS unit_price_tax_incl,
               {_UNTAXED} AS total_price_tax_excl, {_TAXED} AS total_price_tax_incl,
               CAST(l_tax AS DECIMAL(20,6)) AS tax_rate
        FROM {{lineitem}}""",
    "order_lines_before": """
        SELECT l_orderkey AS orderid_bk,
               CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey * 10 + l_linenumber ELSE -1 END AS orderdetailid_bk
        FROM {lineitem}""",
    "sg_order_history": """
        SELECT o_orderkey + 1 AS id_order_history, o_orderkey AS id_order, o_orderkey % 40 AS id_order_state,
               CAST(o_orderdate AS TIMESTAMP) AS date_add
        FROM {orders}""",
    "history_before": """
        SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 ELSE -1 END AS orderhistoryid_bk,
               o_orderkey AS orderid_bk, o_orderkey % 40 AS orderstateid_bk
        FROM {orders}""",
    "order_lines_loaded": f"""
        SELECT l_orderkey AS orderid_bk, l_orderkey % 150 AS customer_sk,
               CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_orderkey % 90 END AS address_sk,
               l_orderkey % 1000 AS date_sk, l_linenumber % 2 + 1 AS time_sk, {_UNTAXED} AS paid,
               {_TAXED} AS paid_tax_incl, CAST(l_tax AS DECIMAL(20,6)) AS taxrate,
               CAST(1 AS DECIMAL(20,6)) AS conversion_rate, l_linestatus AS paymenttype,
               NULLIF(l_returnflag, 'N') AS carrier
        FROM {{lineitem}}""",
    "orders_before": """
        SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE -o_orderkey - 1 END AS orderid_bk FROM {orders}""",
    # Reconciliation, run log and report catalog
    "orders_expected": f"""
        SELECT o_orderkey AS orderid_bk, o_custkey AS customerid_bk, {_PRICE} AS paid, o_orderpriority AS carrier
        FROM {{orders}}""",
    "orders_actual": f"""
        SELECT CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS orderid_bk,
               o_custkey AS customerid_bk,
               CASE WHEN o_orderkey % 101 = 0 THEN CAST({_PRICE} + 1 AS DECIMAL(20,6)) ELSE {_PRICE} END AS paid,
               CASE WHEN o_orderkey % 103 = 0 THEN NULL ELSE o_orderpriority END AS carrier
        FROM {{orders}}""",
    # Facts with wrong surrogate keys planted, one kind after the other
    "lines_checked": """
        SELECT l_orderkey AS orderid_bk, l_orderkey * 10 + l_linenumber AS orderdetailid_bk,
               CASE WHEN l_orderkey % 239 = 0 THEN l_partkey % 100 + 1 ELSE l_partkey END AS product_sk,
               CAST(l_quantity AS INT) AS quantity
        FROM {lineitem}""",
    "orders_checked": """
        SELECT o_orderkey AS orderid_bk,
               CASE WHEN o_orderkey % 211 = 0 THEN o_custkey % 50 + 1 ELSE o_custkey END AS customer_sk,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 223 = 0 THEN o_custkey % 50 * 2 + 3
                    ELSE o_custkey * 2 + 1 END AS address_sk,
               CAST({order_day} + CASE WHEN o_orderkey % 227 = 0 THEN 1 ELSE 0 END AS BIGINT) AS date_sk,
               CAST(CASE WHEN o_orderkey % 229 = 0 THEN 5 ELSE 1 END AS BIGINT) AS time_sk
        FROM {orders}""",
    "history_checked": """
        SELECT o_orderkey + 1 AS orderhistoryid_bk, o_orderkey AS orderid_bk, o_orderkey % 40 AS orderstateid_bk,
               CASE WHEN o_orderkey % 233 = 0 THEN 101
                    WHEN o_orderkey % 40 < 25 AND o_orderkey % 40 % 7 <> 0 THEN o_orderkey % 40 + 100 END AS orderstate_sk,
               CAST({order_day} AS BIGINT) AS date_sk, CAST(1 AS BIGINT) AS time_sk
        FROM {orders}""",
    # A first load of the facts and what later batches add and withdraw; batch 0 is the first load, and the rest cancels out
    "order_changes": f"""
        SELECT CAST(o_orderkey % 3 AS INT) AS batch, 1 AS added, o_orderkey AS orderid_bk, CAST({{order_day}} AS BIGINT) AS date_sk,
               o_orderkey % 24 + 1 AS time_sk, {_PRICE} AS paid_tax_incl, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS carrier
        FROM {{orders}}
        """ + _batches(f"""
        SELECT {{batch}} AS batch, {{added}} AS added, o_orderkey AS orderid_bk, CAST({{{{order_day}}}} - 40 AS BIGINT) AS date_sk,
               o_orderkey % 7 + 1 AS time_sk, {_PRICE} AS paid_tax_incl, 'WRONG' AS carrier
        FROM {{{{orders}}}} WHERE o_orderkey % 5 = 0""", (0, 1), (3, 0)),
    "payment_changes": """
        SELECT CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 0 END AS batch, 1 AS added, o_orderkey AS orderid_bk,
               CAST({order_day} + 1 AS BIGINT) AS date_sk, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 18 END AS orderstateid_bk
        FROM {orders}
        UNION ALL
        SELECT 1 AS batch, 1 AS added, o_orderkey AS orderid_bk, CAST({order_day} + 1 AS BIGINT) AS date_sk,
               CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 3 END AS orderstateid_bk
        FROM {orders}
        """ + _batches("""
        SELECT {batch} AS batch, {added} AS added, o_orderkey AS orderid_bk, CAST({{order_day}} + 9 AS BIGINT) AS date_sk, 2 AS orderstateid_bk
        FROM {{orders}} WHERE o_orderkey % 6 = 0""", (0, 1), (1, 0), (2, 1), (3, 0)),
    "line_changes": f"""
        SELECT CAST(l_partkey % 3 AS INT) AS batch, 1 AS added, l_orderkey AS orderid_bk, l_partkey AS product_sk, {_TAXED} AS amount_tax_incl
        FROM {{lineitem}}
        """ + _batches(f"""
        SELECT {{batch}} AS batch, {{added}} AS added, l_orderkey AS orderid_bk, l_partkey % 20 + 1 AS product_sk, {_TAXED} AS amount_tax_incl
        FROM {{{{lineitem}}}} WHERE l_linenumber = 2""", (1, 1), (2, 0)),
    "run_events": """
        SELECT CAST(event_id AS STRING) AS id, event_type AS job_name, 'RUNNING' AS status,
               CAST(ts AS TIMESTAMP) AS "at", CAST(NULL AS STRING) AS message, CAST(NULL AS INT) AS tables_processed,
               CAST(user_id AS STRING) AS task_id
        FROM {events}
        UNION ALL
        SELECT CAST(event_id AS STRING) AS id, CAST(NULL AS STRING) AS job_name,
               CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'RUNNING' ELSE 'SUCCESS' END AS status,
               CAST(ts AS TIMESTAMP) + INTERVAL 1 HOUR AS "at", 'event ' || event_type AS message,
               CAST(event_id % 12 AS INT) AS tables_processed, CAST(NULL AS STRING) AS task_id
        FROM {events}""",
    "run_list": """
        SELECT event_id AS id, event_type AS job_name, CAST(user_id AS STRING) AS task_id,
               CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
               CAST(event_id % 12 AS INT) AS tables_processed
        FROM {events}""",
    "report_list": """
        SELECT event_id AS id, user_id, event_type AS report_type, props AS parameters, 'SUCCESS' AS status
        FROM {events}""",
    "user_list": """
        SELECT c_custkey AS id, 'user' || CAST(c_custkey AS STRING) || '@shop.test' AS email,
               CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 2 END AS role, c_name AS last_name, c_acctbal >= 0 AS active
        FROM {customer}""",
    # Raw tables that only joined extractions read
    "ps_product_attribute": """
        SELECT l_partkey AS id_product, l_orderkey * 10 + l_linenumber AS id_product_attribute FROM {lineitem}""",
    "ps_carrier": """
        SELECT CAST(n_nationkey AS BIGINT) AS id_carrier, 'Carrier ' || n_name AS name FROM {nation}""",
    "ps_order_carrier": """
        SELECT l_orderkey AS id_order, CAST(l_linenumber AS BIGINT) AS id_carrier FROM {lineitem}""",
    "ps_tax": """
        SELECT CAST(r_regionkey AS BIGINT) AS id_tax, CAST(r_regionkey * 5 AS DECIMAL(20,6)) AS rate, r_name AS name
        FROM {region}""",
    "ps_order_detail_tax": """
        SELECT l_orderkey * 10 + l_linenumber AS id_order_detail, CAST(l_linenumber % 4 AS BIGINT) AS id_tax
        FROM {lineitem}
        UNION ALL
        SELECT o_orderkey * 10 + 1 AS id_order_detail, CAST(4 AS BIGINT) AS id_tax FROM {orders}""",
}

# Driver table and key behind each raw shop table.
RAW_BASE = {
    "ps_address": ("customer", "c_custkey"),
    "ps_country": ("nation", "n_nationkey"),
    "ps_customer": ("customer", "c_custkey"),
    "ps_customer_company": ("supplier", "s_suppkey"),
    "ps_customer_group": ("orders", "o_custkey"),
    "ps_gender": ("region", "r_regionkey"),
    "ps_group": ("nation", "n_nationkey"),
    "ps_category": ("part", "p_partkey"),
    "ps_manufacturer": ("supplier", "s_suppkey"),
    "ps_product_attribute_combination": ("lineitem", "l_partkey"),
    "ps_attribute": ("part", "p_partkey"),
    "ps_attribute_group": ("supplier", "s_suppkey"),
    "ps_currency": ("nation", "n_nationkey"),
    "ps_cart_product": ("events", "event_id"),
    "ps_order_history": ("orders", "o_orderkey"),
    "ps_order_state": ("nation", "n_nationkey"),
    "ps_order_slip": ("orders", "o_orderkey"),
    "ps_order_slip_detail": ("lineitem", "l_orderkey"),
    "ps_product": ("part", "p_partkey"),
    "ps_stock_available": ("part", "p_partkey"),
    "ps_cart": ("events", "event_id"),
    "ps_orders": ("orders", "o_orderkey"),
    "ps_order_detail": ("lineitem", "l_orderkey * 10 + l_linenumber"),
    "ps_order_payment": ("orders", "o_orderkey"),
    "ps_state": ("nation", "n_nationkey"),
}
# Join columns that are not among the extracted columns, or must meet another table.
_EXTRA = {
    "ps_cart": {"id_carrier": "k % 30"},
    "ps_orders": {"reference": "'REF' || CAST(k % 5000 AS STRING)"},
    "ps_order_payment": {"order_reference": "'REF' || CAST(k % 7000 AS STRING)"},
}
_JOINED_IN = {"sg_product": ["id_product_attribute"], "sg_cart": ["carrier"], "sg_orders": ["carrier"],
              "sg_order_detail": ["tax_rate", "tax_name"], "sg_order_payment": ["id_order"]}


def _raw_column(kind: str, i: int) -> str:
    k = f"(k + {i})"
    if kind in ("id", "id_or_0"):
        return "k" if i == 0 else f"{k} % {500 + i}"
    if kind == "int":
        return f"CAST({k} % 10 AS INT)"
    if kind == "money":
        return f"CAST({k} % 1000 AS DECIMAL(20,6))"
    if kind == "flag":
        return f"CASE {k} % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END"
    day = f"'2024-05-' || LPAD(CAST({k} % 28 + 1 AS STRING), 2, '0')"
    if kind == "moment":
        return f"CASE WHEN {k} % 5 = 0 THEN '0000-00-00 00:00:00' WHEN {k} % 7 > 0 THEN {day} || ' 10:20:30' END"
    if kind == "day":
        return f"CASE WHEN {k} % 5 = 0 THEN '0000-00-00' WHEN {k} % 7 > 0 THEN {day} END"
    return f"CASE WHEN {k} % 6 = 0 THEN '' WHEN {k} % 11 > 0 THEN 'text ' || CAST({k} % 50 AS STRING) END"


def _raw_select(target: str) -> tuple[str, str]:
    spec = SPECS[target]
    base, key = RAW_BASE[spec.source]
    columns = {
        name: _raw_column(kind, i)
        for i, (name, kind) in enumerate(spec.columns.items())
        if name not in _JOINED_IN.get(target, ())
    }
    columns |= _EXTRA.get(spec.source, {})
    listed = ", ".join(f'{expression} AS "{name}"' for name, expression in columns.items())
    return spec.source, f"SELECT {listed} FROM (SELECT CAST({key} AS BIGINT) AS k FROM {{{base}}}) t"


INPUTS |= dict(_raw_select(target) for target in SPECS)


@cache
def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@cache
def spark_input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    days = {
        "order_day": _SPARK_DAY.format("o_orderdate"),
        "ship_day": _SPARK_DAY.format("l_shipdate"),
        "event_day": _SPARK_DAY.format("ts"),
    }
    used = [t for t in TABLES if f"{{{t}}}" in INPUTS[name]]
    text = re.sub(r'AS "(\w+)"', r"AS `\1`", INPUTS[name]).format(**{t: f"{{{t}}}" for t in TABLES}, **days)
    return spark.sql(text, **{t: _table(spark, sf_dir, t) for t in used})


def duckdb_input(name: str) -> str:
    days = {
        "order_day": _DUCKDB_DAY.format("o_orderdate"),
        "ship_day": _DUCKDB_DAY.format("l_shipdate"),
        "event_day": _DUCKDB_DAY.format("ts"),
    }
    return INPUTS[name].format(**{t: t for t in TABLES}, **days)
