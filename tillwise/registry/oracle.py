"""DuckDB counterparts of the registered queries, written set-wise from the semantics and not from the Spark plans."""

from __future__ import annotations

import re

from tillwise.registry.inputs import INPUTS, duckdb_input
from tillwise.sources.extract import SPECS

_GENERATED = {
    "dim_date": """
        SELECT CAST(d - DATE '1990-01-01' + 1 AS BIGINT) AS date_key, d AS date, year(d) AS year,
               quarter(d) AS quarter, month(d) AS month, monthname(d) AS month_name, dayname(d) AS day_name
        FROM (SELECT CAST(g AS DATE) AS d FROM range(DATE '1990-01-01', DATE '2031-01-01', INTERVAL 1 DAY) AS t(g))""",
    "dim_time": "SELECT h + 1 AS time_key, CAST(h AS INTEGER) AS hour FROM range(24) AS t(h)",
}

_AS_OF = "DATE '2024-02-01'"
_OPEN = "DATE '9999-12-31'"
_YEAR = ("dd.year = 2000", "2000-01-01", "2000-12-31")
_QUARTER = ("dd.quarter = 4 AND dd.year = 1999", "1999-10-01", "1999-12-31")
_MONTH = ("dd.month = 2 AND dd.year = 1998", "1998-02-01", "1998-02-28")
_ALL = ("dd.date BETWEEN DATE '1995-01-01' AND DATE '2024-12-31'", "1995-01-01", "2024-12-31")


def _sql(body: str) -> str:
    """Put the inputs a query mentions in front of it."""
    known = {**{name: None for name in INPUTS}, **_GENERATED}
    used = [name for name in known if re.search(rf"\b{name}\b", body)]
    ctes = [f"{name} AS ({_GENERATED.get(name) or duckdb_input(name)})" for name in used]
    body = body.strip()
    if not ctes:
        return body
    return f"WITH {', '.join(ctes)}{',' + body[4:] if body.startswith('WITH') else ' ' + body}"


def _cents(expression: str, digits: int = 2) -> str:
    return f"CAST(ROUND({expression}, {digits}) AS DOUBLE)"


def _whole(expression: str) -> str:
    return f"CAST(round_even({expression}, 0) AS DOUBLE)"


def _valid(alias: str, period: tuple[str, str, str]) -> str:
    return f"{alias}.valid_from <= DATE '{period[2]}' AND {alias}.valid_to >= DATE '{period[1]}'"


_FIRST = """WITH lines AS (
    SELECT date_sk FROM fact_cart_line UNION ALL SELECT date_sk FROM fact_order_line
), earliest AS (
    SELECT MIN(dd.date) AS min_date FROM lines JOIN dim_date dd ON dd.date_key = lines.date_sk
)"""


def _calendar_menu(columns: str) -> str:
    return f"{_FIRST} SELECT DISTINCT {columns} FROM dim_date, earliest WHERE date >= min_date AND date <= {_AS_OF}"


def _value_menu(column: str, period: tuple[str, str, str]) -> str:
    return f"""
        SELECT '[Any]' AS {column}
        UNION ALL
        SELECT DISTINCT COALESCE(p.{column}, '[Not specified]') FROM dim_product p WHERE {_valid('p', period)}"""


_PAID = """fact_order_history h JOIN dim_date dd ON dd.date_key = h.date_sk
           JOIN fact_order o ON o.orderid_bk = h.orderid_bk"""
_PAID_LINES = """fact_order_history h JOIN dim_date dd ON dd.date_key = h.date_sk
           JOIN fact_order_line l ON l.orderid_bk = h.orderid_bk JOIN dim_product p ON p.product_key = l.product_sk"""


def _period_revenue(period: tuple[str, str, str], label: str, value: str) -> str:
    return f"""
        SELECT strftime(dd.date, '{label}') AS period, {value} AS total_revenue
        FROM {_PAID} WHERE {period[0]} AND h.orderstateid_bk = 2 GROUP BY 1"""


def _heatmap(period: tuple[str, str, str]) -> str:
    return f"""
        SELECT time_of_day, day_of_week, quantile_cont(n, 0.5) AS order_count
        FROM (
            SELECT dd.date, dd.day_name AS day_of_week, COUNT(*) AS n,
                   CASE WHEN t.hour < 6 THEN 'Night' WHEN t.hour < 12 THEN 'Morning' WHEN t.hour < 18 THEN 'Afternoon'
                        ELSE 'Evening' END AS time_of_day
            FROM fact_order o JOIN dim_time t ON t.time_key = o.time_sk JOIN dim_date dd ON dd.date_key = o.date_sk
            WHERE {period[0]} GROUP BY ALL
        ) daily GROUP BY 1, 2"""


def _matrix(period: tuple[str, str, str]) -> str:
    days = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
    cells = ", ".join(
        f"""CASE WHEN EXISTS (SELECT 1 FROM cells c WHERE c.day_of_week = '{d}')
                 AND EXISTS (SELECT 1 FROM cells c WHERE c.time_of_day = parts.time_of_day)
            THEN COALESCE((SELECT MAX(c.order_count) FROM cells c
                           WHERE c.day_of_week = '{d}' AND c.time_of_day = parts.time_of_day), 0.0) END AS {d}"""
        for d in days
    )
    return f"""WITH cells AS ({_heatmap(period)})
        SELECT parts.time_of_day, {cells}
        FROM (VALUES ('Morning'), ('Afternoon'), ('Evening'), ('Night')) AS parts(time_of_day)"""


def _gender(period: tuple[str, str, str], label: str) -> str:
    return f"""
        SELECT {label} AS gender, COUNT(c.customer_key) AS customers_count
        FROM dim_customer c WHERE c.active AND {_valid('c', period)} GROUP BY c.gender"""


def _choice_revenue(period: tuple[str, str, str], label: str, choice: str) -> str:
    return f"""
        SELECT strftime(dd.date, '{label}') AS period,
               CAST(round_even(SUM(o.paid_tax_incl), 2) AS DOUBLE) AS total_revenue
        FROM fact_order_line l
        JOIN fact_order o ON o.orderid_bk = l.orderid_bk
        JOIN fact_order_history h ON h.orderid_bk = o.orderid_bk AND h.orderstateid_bk = 2
        JOIN dim_date dd ON dd.date_key = l.date_sk
        JOIN dim_product p ON p.product_key = l.product_sk
        WHERE {period[0]} AND {_valid('p', period)} AND {choice} GROUP BY 1"""


def _above_median(period: tuple[str, str, str]) -> str:
    return f"""
        SELECT c.customerid_bk AS customer_id, {_cents('SUM(o.paid_tax_incl)')} AS total_spent,
               COUNT(o.orderid_bk) AS order_count
        FROM fact_order o
        JOIN dim_customer c ON c.customer_key = o.customer_sk
        JOIN dim_date dd ON dd.date_key = o.date_sk
        JOIN fact_order_history h ON h.orderid_bk = o.orderid_bk AND h.orderstateid_bk = 2
        WHERE {period[0]} AND {_valid('c', period)} AND o.paid_tax_incl > (
            SELECT quantile_cont(o.paid_tax_incl, 0.5) FROM fact_order o JOIN dim_date dd ON dd.date_key = o.date_sk
            WHERE {period[0]})
        GROUP BY 1"""


_CARTS = f"""SELECT COUNT(DISTINCT c.cartid_bk) AS carts_count
    FROM fact_cart_line c JOIN dim_date dd ON dd.date_key = c.date_sk WHERE {_ALL[0]}"""
_ORDERS = "SELECT COUNT(*) AS orders_count FROM fact_order o JOIN dim_date dd ON dd.date_key = o.date_sk WHERE "


def _orders_paid(period: tuple[str, str, str]) -> str:
    return f"""
        SELECT COUNT(o.orderid_bk) AS orders_paid_count, {_cents('SUM(o.paid_tax_incl)')} AS total_revenue
        FROM fact_order_history h JOIN fact_order o ON o.orderid_bk = h.orderid_bk
        JOIN dim_date dd ON dd.date_key = o.date_sk WHERE {period[0]} AND h.orderstateid_bk = 2"""


def _reports() -> dict[str, str]:
    return {
        "min_date": f"{_FIRST} SELECT CAST(min_date AS VARCHAR) AS min_date FROM earliest",
        "menu_months": _calendar_menu("month_name, year, month"),
        "menu_quarters": _calendar_menu("quarter, year"),
        "menu_years": _calendar_menu("year"),
        "menu_market_group": _value_menu("market_group", _QUARTER),
        "menu_market_subgroup": _value_menu("market_subgroup", _MONTH),
        "menu_market_gender": _value_menu("market_gender", _YEAR),
        "carts_count": _CARTS,
        "orders_count": _ORDERS + _YEAR[0],
        "orders_paid": _orders_paid(_YEAR),
        "summary": f"""
            SELECT orders_count, total_revenue, orders_paid_count, carts_count,
                   CAST(round_even(CASE WHEN carts_count > 0 THEN orders_count * 100.0::DOUBLE / carts_count
                        ELSE 0 END, 2) AS DOUBLE) AS conversion_rate,
                   ROUND(CASE WHEN carts_count > 0 THEN orders_paid_count * 100.0::DOUBLE / carts_count
                        ELSE 0 END, 2) AS conversion_rate_paid
            FROM ({_CARTS}) c, ({_ORDERS}{_ALL[0]}) o, ({_orders_paid(_ALL)}) p""",
        "period_revenue": _period_revenue(_YEAR, "%m", _cents("SUM(o.paid_tax_incl)")),
        "period_revenue_days": _period_revenue(_ALL, "%Y-%m-%d", _cents("SUM(o.paid_tax_incl)")),
        "period_revenue_trend": f"""WITH points AS (
                SELECT period, total_revenue, CAST(ROW_NUMBER() OVER (ORDER BY period) - 1 AS DOUBLE) AS x
                FROM ({_period_revenue(_YEAR, "%m", _whole("SUM(o.paid_tax_incl)"))}) r)
            SELECT period, total_revenue,
                   ROUND(COALESCE((SELECT regr_slope(total_revenue, x) FROM points), 0) * x
                       + COALESCE((SELECT regr_intercept(total_revenue, x) FROM points), total_revenue), 2) AS lin_reg
            FROM points""",
        "orders_heatmap": _heatmap(_ALL),
        "heatmap_matrix": _matrix(_MONTH),
        "carrier_revenue": f"""
            SELECT COALESCE(o.carrier, 'Neuvedené') AS carrier, {_cents('SUM(o.paid_tax_incl)')} AS total_revenue,
                   COUNT(o.orderid_bk) AS total_count
            FROM {_PAID} WHERE {_YEAR[0]} AND h.orderstateid_bk = 2 GROUP BY o.carrier""",
        "top_manufacturers": f"""
            SELECT manufacturer, {_cents('total')} AS total_revenue FROM (
                SELECT p.manufacturer, SUM(l.amount_tax_incl) AS total FROM {_PAID_LINES}
                WHERE {_ALL[0]} AND h.orderstateid_bk = 2 GROUP BY 1
                ORDER BY total DESC NULLS FIRST, 1 ASC NULLS LAST LIMIT 10) best""",
        "market_group_revenue": f"""
            SELECT p.market_group, {_cents('SUM(l.amount_tax_incl)')} AS total_revenue FROM {_PAID_LINES}
            WHERE {_QUARTER[0]} AND h.orderstateid_bk = 2 GROUP BY 1""",
        "market_group_share": f"""
            SELECT market_group, total_revenue, ROUND(total_revenue / SUM(total_revenue) OVER (), 6) AS share FROM (
                SELECT p.market_group, {_whole('SUM(l.amount_tax_incl)')} AS total_revenue FROM {_PAID_LINES}
                WHERE {_ALL[0]} AND h.orderstateid_bk = 2 GROUP BY 1) g""",
        "gender_distribution": _gender(_YEAR, "COALESCE(c.gender, 'Neuvedené')"),
        "gender_distribution_dashboard": _gender(
            _MONTH, "CASE c.gender WHEN 'Pán' THEN 'Muž' WHEN 'Pani' THEN 'Žena' ELSE COALESCE(c.gender, 'Neuvedené') END"
        ),
        "age_distribution": f"""
            SELECT COALESCE(CAST(CAST(floor(date_part('year', age({_AS_OF}, c.birthdate)) / 10) * 10 AS BIGINT)
                       AS VARCHAR), 'Neuvedené') AS age_range,
                   ROUND(AVG(CAST(o.paid_tax_incl AS DOUBLE)), 2) AS avg_order_value
            FROM fact_order o JOIN dim_date dd ON dd.date_key = o.date_sk
            JOIN dim_customer c ON c.customer_key = o.customer_sk
            WHERE {_ALL[0]} AND {_valid('c', _ALL)} GROUP BY 1""",
        "product_group_revenue": _choice_revenue(
            _YEAR, "%m", "p.market_group = 'ECONOMY' AND p.market_subgroup IS NULL"
        ),
        "product_gender_revenue": _choice_revenue(_ALL, "%Y-%m-%d", "p.market_gender IS NULL"),
        "product_revenue_any": _choice_revenue(_QUARTER, "%m", "TRUE"),
        "median_order_value": """
            SELECT quantile_cont(CAST(paid_tax_incl AS DOUBLE), 0.5) AS median_order_total FROM fact_order""",
        "customers_above_median": _above_median(_YEAR),
        "csv_page": f"""WITH ranked AS ({_above_median(_ALL)})
            SELECT customer_id, total_spent, order_count,
                   (SELECT CAST(ceil(COUNT(*) / 20.0) AS BIGINT) FROM ranked) AS last_page
            FROM ranked ORDER BY total_spent DESC NULLS FIRST, customer_id LIMIT 20 OFFSET 40""",
        "csv_text_page": """
            SELECT part_id, name, (SELECT CAST(ceil(COUNT(*) / 60.0) AS BIGINT) FROM part_texts) AS last_page
            FROM part_texts ORDER BY part_id LIMIT 60 OFFSET 60""",
        "report_rows": f"""
            SELECT 'report 1' AS report_id,
                   CAST(json_object('gender', gender, 'customers_count', customers_count) AS VARCHAR) AS row
            FROM ({_gender(_YEAR, "COALESCE(c.gender, 'Neuvedené')")}) g""",
    }


def _scd2(stage: str, dim: str, key: str, bk: list[str], tracked: list[str], carried: list[str], start: str) -> str:
    """Dimension after a load on 2024-02-01, one branch per outcome."""
    values = tracked + carried
    same = " AND ".join(f"c.{b} = s.{b}" for b in bk)
    changed = " OR ".join(f"c.{v} IS DISTINCT FROM s.{v}" for v in tracked)
    casts = {"price": "CAST({} AS DOUBLE)", "birthdate": "CAST({} AS VARCHAR)"}

    def row(alias: str, row_key: str, valid_from: str, valid_to: str) -> str:
        columns = [f"{casts.get(c, '{}').format(f'{alias}.{c}')} AS {c}" for c in bk + values]
        return (
            f"SELECT {row_key} AS {key}, {', '.join(columns)}, CAST({valid_from} AS VARCHAR) AS valid_from, "
            f"CAST({valid_to} AS VARCHAR) AS valid_to"
        )

    return f"""WITH s AS ({stage}), c AS (SELECT * FROM {dim} WHERE valid_to = {_OPEN})
        {row('c', f'c.{key}', 'c.valid_from', 'c.valid_to')} FROM {dim} c WHERE c.valid_to <> {_OPEN}
        UNION ALL
        {row('c', f'c.{key}', 'c.valid_from', 'c.valid_to')} FROM c
        WHERE NOT EXISTS (SELECT 1 FROM s WHERE {same} AND ({changed}))
        UNION ALL
        {row('c', f'c.{key}', 'c.valid_from', "DATE '2024-01-31'")} FROM c JOIN s ON {same} WHERE {changed}
        UNION ALL
        {row('s', 'NULL', _AS_OF, _OPEN)} FROM c JOIN s ON {same} WHERE {changed}
        UNION ALL
        {row('s', 'NULL', start, _OPEN)} FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE {same})"""


_START = "COALESCE(CAST(s.date_add AS DATE), DATE '2000-01-01')"

_ADDRESS_STAGE = """
    SELECT a.id_address AS addressid_bk, a.id_customer AS customerid_bk, NULLIF(n.name, '') AS country,
           NULLIF(t.name, '') AS state, NULLIF(a.city, '') AS city, a.postcode AS zipcode, a.date_add
    FROM sg_address a LEFT JOIN sg_country n USING (id_country) LEFT JOIN sg_state t USING (id_state)"""
_CUSTOMER_STAGE = """
    SELECT u.id_customer AS customerid_bk, u.hashed_login AS hashedemail,
           CASE WHEN u.id_default_group IN (SELECT id_group FROM sg_customer_group) THEN g.name END AS defaultgroup,
           u.birthday AS birthdate, NULLIF(x.name, '[neuvádzam]') AS gender,
           u.id_customer IN (SELECT id_customer FROM sg_customer_company) AS businessaccount, u.active, u.date_add
    FROM sg_customer u LEFT JOIN sg_group g ON g.id_group = u.id_default_group
    LEFT JOIN sg_gender x ON x.id_gender = u.id_gender"""
_PRODUCT_STAGE = """
    SELECT p.id_product AS productid_bk, COALESCE(p.id_product_attribute, 0) AS productattributeid_bk,
           p.name AS productname, NULLIF(m.name, '') AS manufacturer, NULLIF(k.name, '') AS defaultcategory,
           NULLIF(p."group", '') AS market_group, NULLIF(p.subgroup, '') AS market_subgroup,
           NULLIF(p.gender, '') AS market_gender, p.price, p.active, p.date_add
    FROM sg_product p LEFT JOIN sg_manufacturer m USING (id_manufacturer)
    LEFT JOIN sg_category k ON k.id_category = p.id_category_default"""
_STATE_STAGE = "SELECT id_order_state AS orderstateid_bk, name AS current_state FROM sg_order_state"
_ATTRIBUTE_STAGE = """
    SELECT a.id_attribute AS attributeid_bk, COALESCE(NULLIF(a.name, ''), 'Unknown') AS attribute_name,
           NULLIF(g.name, '') AS attribute_group
    FROM sg_attribute a LEFT JOIN sg_attribute_group g USING (id_attribute_group)"""

_MONEY_6 = "CAST({} AS DOUBLE)"
_CALENDAR = """LEFT JOIN dim_date dd ON dd.date = CAST({0} AS DATE) LEFT JOIN dim_time t ON t.hour = hour({0})"""
_CALENDAR_COLUMNS = """COALESCE(dd.date_key, 0) AS date_sk, COALESCE(t.time_key, 0) AS time_sk,
    COALESCE(CAST(dd.year * 100 + dd.month AS INTEGER), 0) AS date_month"""

_ORDER_LINES = f"""
    SELECT d.id_order AS orderid_bk, d.id_order_detail AS orderdetailid_bk, o.id_cart AS cartid_bk, d.product_id,
           o.id_customer, o.date_add,
           (SELECT MAX(product_key) FROM dim_product p WHERE p.productid_bk = d.product_id
               AND p.productattributeid_bk = d.product_attribute_id AND p.valid_to = {_OPEN}) AS product_sk,
           (SELECT MAX(customer_key) FROM dim_customer c WHERE c.customerid_bk = o.id_customer
               AND c.valid_to = {_OPEN}) AS customer_sk,
           COALESCE((SELECT MAX(address_key) FROM address_versions a WHERE a.addressid_bk = o.id_address_delivery
               AND a.valid_to = {_OPEN}),
               (SELECT MAX(address_key) FROM address_versions a WHERE a.addressid_bk = o.id_address_delivery))
               AS address_sk,
           d.product_quantity AS quantity, d.unit_price_tax_excl AS price, d.unit_price_tax_incl AS price_tax_incl,
           d.total_price_tax_excl AS amount, d.total_price_tax_incl AS amount_tax_incl,
           o.total_paid_tax_excl AS paid, o.total_paid_tax_incl AS paid_tax_incl, d.tax_rate AS taxrate,
           o.conversion_rate, NULLIF(o.carrier, '') AS carrier, o.payment AS paymenttype
    FROM sg_order_detail d JOIN sg_orders o ON o.id_order = d.id_order
    WHERE NOT EXISTS (SELECT 1 FROM order_lines_before f
                      WHERE f.orderid_bk = d.id_order AND f.orderdetailid_bk = d.id_order_detail)"""


def _loads() -> dict[str, str]:
    line_money = ", ".join(
        f"{_MONEY_6.format('l.' + c)} AS {c}"
        for c in "price price_tax_incl amount amount_tax_incl paid paid_tax_incl taxrate conversion_rate".split()
    )
    order_money = ", ".join(
        f"{_MONEY_6.format(f'MAX(l.{c})')} AS {c}" for c in "paid paid_tax_incl taxrate conversion_rate".split()
    )
    return {
        "calendar_days": """WITH d AS (
                SELECT CAST(g AS DATE) AS day FROM (SELECT MIN(date_add) AS a, MAX(date_add) AS z FROM sg_orders) b,
                LATERAL (SELECT UNNEST(generate_series(b.a, b.z, INTERVAL 1 DAY)) AS g) s)
            SELECT CAST(day AS VARCHAR) AS date, ROW_NUMBER() OVER (ORDER BY day) AS date_key, year(day) AS year,
                   quarter(day) AS quarter, month(day) AS month, monthname(day) AS month_name, day(day) AS day,
                   isodow(day) AS day_of_week, dayname(day) AS day_name, weekofyear(day) AS week_of_year,
                   isodow(day) > 5 AS is_weekend,
                   (SELECT COUNT(*) FROM sg_orders o WHERE CAST(o.date_add AS DATE) = d.day) AS orders
            FROM d""",
        "calendar_hours": """
            SELECT t.hour, t.time_key, lpad(CAST(t.hour AS VARCHAR), 2, '0') || ':00:00' AS time,
                   (SELECT COUNT(*) FROM sg_cart c WHERE hour(c.date_add) = t.hour) AS carts
            FROM dim_time t""",
        "dim_address_load": _scd2(
            _ADDRESS_STAGE, "dim_address_before", "address_key", ["addressid_bk"],
            ["country", "state", "city", "zipcode"], ["customerid_bk"], _START,
        ),
        "dim_customer_load": _scd2(
            _CUSTOMER_STAGE, "dim_customer_before", "customer_key", ["customerid_bk"],
            ["hashedemail", "defaultgroup", "birthdate", "gender", "businessaccount", "active"], [], _START,
        ),
        "dim_product_load": _scd2(
            _PRODUCT_STAGE, "dim_product_before", "product_key", ["productid_bk", "productattributeid_bk"],
            ["productname", "manufacturer", "defaultcategory", "market_group", "market_subgroup", "market_gender",
             "price", "active"], [], _START,
        ),
        "dim_order_state_load": _scd2(
            _STATE_STAGE, "dim_order_state_before", "orderstate_key", ["orderstateid_bk"], ["current_state"], [],
            "DATE '2000-01-01'",
        ),
        "dim_attribute_load": f"""WITH s AS ({_ATTRIBUTE_STAGE})
            SELECT d.attribute_key, d.attributeid_bk,
                   CASE WHEN s.attributeid_bk IS NULL THEN d.attribute_name ELSE s.attribute_name END AS attribute_name,
                   CASE WHEN s.attributeid_bk IS NULL THEN d.attribute_group ELSE s.attribute_group END
                       AS attribute_group
            FROM dim_attribute_before d LEFT JOIN s USING (attributeid_bk)
            UNION ALL
            SELECT NULL, s.attributeid_bk, s.attribute_name, s.attribute_group
            FROM s WHERE s.attributeid_bk NOT IN (SELECT attributeid_bk FROM dim_attribute_before)""",
        "bridge_load": """
            SELECT p.product_key AS product_sk, a.attribute_key AS attribute_sk,
                   m.id_product_attribute AS productattributeid_bk, m.id_attribute AS attributeid_bk
            FROM sg_product_attribute_combination m
            JOIN product_versions p ON p.productattributeid_bk = m.id_product_attribute
            JOIN attributes_loaded a ON a.attributeid_bk = m.id_attribute
            WHERE (p.product_key, a.attribute_key) NOT IN (SELECT product_sk, attribute_sk FROM bridge_before)""",
        "fact_cart_line_load": f"""WITH l AS (
                SELECT i.*, u.id_customer, u.date_add,
                       (SELECT MAX(product_key) FROM dim_product p WHERE p.productid_bk = i.id_product
                           AND p.productattributeid_bk = i.id_product_attribute AND p.valid_to = {_OPEN}) AS product_sk,
                       (SELECT MAX(customer_key) FROM dim_customer c WHERE c.customerid_bk = u.id_customer
                           AND c.valid_to = {_OPEN}) AS customer_sk
                FROM sg_cart_product i JOIN sg_cart u ON u.id_cart = i.id_cart
                WHERE NOT EXISTS (SELECT 1 FROM cart_lines_before f WHERE f.cartid_bk = i.id_cart
                    AND f.productid_bk = i.id_product AND f.productattributeid_bk = i.id_product_attribute
                    AND f.customerid_bk = u.id_customer))
            SELECT l.id_cart AS cartid_bk, l.product_sk, l.customer_sk, l.quantity, l.id_product AS productid_bk,
                   l.id_product_attribute AS productattributeid_bk, l.id_customer AS customerid_bk, {_CALENDAR_COLUMNS}
            FROM l {_CALENDAR.format('l.date_add')} WHERE l.product_sk IS NOT NULL AND l.customer_sk IS NOT NULL""",
        "fact_order_line_load": f"""WITH l AS ({_ORDER_LINES})
            SELECT l.orderid_bk, l.orderdetailid_bk, l.cartid_bk, l.product_sk, l.customer_sk, l.address_sk,
                   l.quantity, {line_money}, l.carrier, l.paymenttype, {_CALENDAR_COLUMNS}
            FROM l {_CALENDAR.format('l.date_add')} WHERE l.product_sk IS NOT NULL AND l.customer_sk IS NOT NULL""",
        "rejected_order_lines": f"""WITH l AS ({_ORDER_LINES})
            SELECT l.orderid_bk, l.orderdetailid_bk, l.product_id AS productid_bk, l.id_customer AS customerid_bk,
                   CASE WHEN l.product_sk IS NULL THEN 'product_sk' ELSE 'customer_sk' END AS missing_key
            FROM l WHERE l.product_sk IS NULL OR l.customer_sk IS NULL""",
        "fact_order_history_load": f"""
            SELECT h.id_order_history AS orderhistoryid_bk, h.id_order AS orderid_bk,
                   h.id_order_state AS orderstateid_bk, {_CALENDAR_COLUMNS},
                   COALESCE((SELECT MAX(orderstate_key) FROM dim_order_state_before s
                             WHERE s.orderstateid_bk = h.id_order_state AND s.valid_to = {_OPEN}),
                            (SELECT MAX(orderstate_key) FROM dim_order_state_before s
                             WHERE s.orderstateid_bk = h.id_order_state)) AS orderstate_sk
            FROM sg_order_history h {_CALENDAR.format('h.date_add')}
            WHERE NOT EXISTS (SELECT 1 FROM history_before f WHERE f.orderhistoryid_bk = h.id_order_history
                AND f.orderid_bk = h.id_order AND f.orderstateid_bk = h.id_order_state)""",
        "fact_order_load": f"""
            SELECT l.orderid_bk, l.customer_sk, l.address_sk, l.date_sk, l.time_sk, {order_money},
                   MAX(l.paymenttype) AS paymenttype, MAX(l.carrier) AS carrier
            FROM order_lines_loaded l WHERE l.orderid_bk NOT IN (SELECT orderid_bk FROM orders_before)
            GROUP BY ALL""",
    }


def _state() -> dict[str, str]:
    """Queries that answer from kept state have the answers of the facts."""
    reports = _reports()
    periods = {
        "year": "dd.year = 2024", "quarter": "dd.year = 2024 AND dd.quarter = 1", "month": "dd.year = 2024 AND dd.month = 1",
        "range": "dd.date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'", "default": "dd.year = 2024",
    }
    carts = " UNION ALL ".join(
        f"""SELECT '{kind}' AS kind, COUNT(DISTINCT c.cartid_bk) AS carts_count
            FROM fact_cart_line c JOIN dim_date dd ON dd.date_key = c.date_sk WHERE {condition}"""
        for kind, condition in periods.items()
    )
    known = {"summary": "summary", "period_revenue": "period_revenue", "heatmap": "orders_heatmap", "carrier_revenue": "carrier_revenue",
             "top_manufacturers": "top_manufacturers"}
    lines = _ORDER_LINES[: _ORDER_LINES.index("WHERE NOT EXISTS")]  # nothing was loaded before
    return {f"maintained_{name}": reports[report] for name, report in known.items()} | {
        "carts_by_period": carts,
        "dim_product_bucketed_load": _loads()["dim_product_load"],
        "gender_by_end_year": _gender(_MONTH, "COALESCE(c.gender, 'Neuvedené')"),
        "warehouse_in_loads": f"""WITH l AS ({lines}), f AS (
                SELECT l.orderid_bk, l.paid_tax_incl, {_CALENDAR_COLUMNS} FROM l {_CALENDAR.format('l.date_add')}
                WHERE l.product_sk IS NOT NULL AND l.customer_sk IS NOT NULL),
            g AS (SELECT orderid_bk, date_month, MAX(paid_tax_incl) AS paid FROM f GROUP BY 1, 2)
            SELECT date_month, 'fact_order_line' AS fact, COUNT(*) AS rows, COUNT(*) AS keys, CAST(SUM(paid_tax_incl) AS DOUBLE) AS paid
            FROM f GROUP BY 1
            UNION ALL
            SELECT date_month, 'fact_order', COUNT(*), COUNT(*), CAST(SUM(paid) AS DOUBLE) FROM g GROUP BY 1""",
        "reconcile_surrogates": _surrogates(),
    }


def _reconciled(fact: str, keys: list[str], fields: list[str], expected: str, actual: str) -> tuple[str, str]:
    """CTEs and SELECTs of the mismatches between two queries with the columns ``keys`` and ``fields``."""
    columns, key = ", ".join(keys + fields), ", ".join(keys)
    same = " AND ".join(f"{{0}}.{k} = p.{k}" for k in keys)
    ctes = f"""{fact}_net AS (
            SELECT {columns}, SUM(s) AS n FROM (SELECT {columns}, 1 AS s FROM ({expected}) e UNION ALL SELECT {columns}, -1 FROM ({actual}) a)
            GROUP BY {columns} HAVING SUM(s) <> 0),
        {fact}_per AS (SELECT {key}, SUM(greatest(n, 0)) AS m, SUM(greatest(-n, 0)) AS u FROM {fact}_net GROUP BY {key})"""
    parts = [
        f"""SELECT '{fact}' AS fact, p.{keys[-1]} AS id, 'different' AS status, '{f}' AS field, CAST(e.{f} AS VARCHAR) AS expected,
                   CAST(a.{f} AS VARCHAR) AS actual, 1 AS rows
            FROM {fact}_per p JOIN {fact}_net e ON {same.format('e')} AND e.n > 0 JOIN {fact}_net a ON {same.format('a')} AND a.n < 0
            WHERE p.m = 1 AND p.u = 1 AND e.{f} IS DISTINCT FROM a.{f}"""
        for f in fields
    ]
    parts += [
        f"SELECT '{fact}', {keys[-1]}, '{status}', NULL, NULL, NULL, {count} FROM {fact}_per WHERE NOT (m = 1 AND u = 1) AND {count} > 0"
        for status, count in (("missing", "m"), ("unexpected", "u"))
    ]
    return ctes, " UNION ALL ".join(parts)


def _surrogates() -> str:
    moment = "LEFT JOIN dim_date dd ON dd.date = CAST({0}.date_add AS DATE)"
    meaning = "LEFT JOIN dim_date dd ON dd.date_key = f.date_sk LEFT JOIN dim_time t ON t.time_key = f.time_sk"
    found = [
        _reconciled(
            "fact_order_line", ["orderid_bk", "orderdetailid_bk"], ["productid_bk", "productattributeid_bk", "quantity"],
            """SELECT d.id_order AS orderid_bk, d.id_order_detail AS orderdetailid_bk, d.product_id AS productid_bk,
                      d.product_attribute_id AS productattributeid_bk, d.product_quantity AS quantity
               FROM sg_order_detail d JOIN sg_orders o USING (id_order)""",
            """SELECT f.orderid_bk, f.orderdetailid_bk, p.productid_bk, p.productattributeid_bk, f.quantity
               FROM lines_checked f LEFT JOIN dim_product p ON p.product_key = f.product_sk""",
        ),
        _reconciled(
            "fact_order", ["orderid_bk"], ["customerid_bk", "addressid_bk", "day", "hour"],
            f"""SELECT o.id_order AS orderid_bk, o.id_customer AS customerid_bk,
                      CASE WHEN o.id_address_delivery IN (SELECT addressid_bk FROM address_versions) THEN o.id_address_delivery END AS addressid_bk,
                      dd.date AS day, hour(o.date_add) AS hour
               FROM sg_orders o {moment.format('o')} WHERE o.id_order IN (SELECT id_order FROM sg_order_detail)""",
            f"""SELECT f.orderid_bk, c.customerid_bk, a.addressid_bk, dd.date AS day, t.hour FROM orders_checked f
               LEFT JOIN dim_customer c ON c.customer_key = f.customer_sk LEFT JOIN address_versions a ON a.address_key = f.address_sk {meaning}""",
        ),
        _reconciled(
            "fact_order_history", ["orderhistoryid_bk"], ["orderid_bk", "stateid", "day", "hour"],
            f"""SELECT h.id_order_history AS orderhistoryid_bk, h.id_order AS orderid_bk,
                      CASE WHEN h.id_order_state IN (SELECT orderstateid_bk FROM dim_order_state_before) THEN h.id_order_state END AS stateid,
                      dd.date AS day, hour(h.date_add) AS hour
               FROM sg_order_history h {moment.format('h')}""",
            f"""SELECT f.orderhistoryid_bk, f.orderid_bk, s.orderstateid_bk AS stateid, dd.date AS day, t.hour FROM history_checked f
               LEFT JOIN dim_order_state_before s ON s.orderstate_key = f.orderstate_sk {meaning}""",
        ),
    ]
    return f"WITH {', '.join(ctes for ctes, _ in found)} {' UNION ALL '.join(select for _, select in found)}"


def _operations() -> dict[str, str]:
    fields = ["customerid_bk", "paid", "carrier"]
    different = " UNION ALL ".join(
        f"""SELECT e.orderid_bk, 'different' AS status, '{f}' AS field, 1 AS rows
            FROM orders_expected e JOIN orders_actual a USING (orderid_bk) WHERE e.{f} IS DISTINCT FROM a.{f}"""
        for f in fields
    )
    runs = "job_name LIKE '%c%' AND tables_processed > 2 AND id <= 5000"
    return {
        "run_audit": """WITH r AS (
                SELECT id, MAX(job_name) AS job_name, MAX(task_id) AS task_id, MIN(r0."at") AS started_at,
                       MAX(CASE WHEN status <> 'RUNNING' THEN r0."at" END) AS ended_at, MAX(r0."at") AS latest
                FROM run_events r0 GROUP BY id)
            SELECT r.id, r.job_name, r.task_id, CAST(r.started_at AS VARCHAR) AS started_at,
                   CAST(r.ended_at AS VARCHAR) AS ended_at, e.status, e.message, e.tables_processed
            FROM r JOIN run_events e ON e.id = r.id AND e."at" = r.latest""",
        "run_listing": f"SELECT * FROM run_list WHERE {runs} ORDER BY job_name, id DESC LIMIT 10 OFFSET 20",
        "run_listing_pages": f"""
            SELECT COUNT(*) AS total_records, CAST(ceil(COUNT(*) / 10.0) AS BIGINT) AS last_page
            FROM run_list WHERE {runs}""",
        "report_listing": "SELECT * FROM report_list WHERE user_id = 8 ORDER BY id DESC LIMIT 5 OFFSET 5",
        "user_listing": "SELECT * FROM user_list WHERE role = 1 ORDER BY last_name DESC, id DESC LIMIT 15",
        "run_listing_deep": """WITH n AS (SELECT COUNT(*) AS total FROM run_list),
            r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY job_name, id DESC) AS place FROM run_list)
            SELECT id, job_name, task_id, status, tables_processed, 'middle' AS page, CAST(ceil(total / 10.0) AS BIGINT) AS last_page
            FROM r, n WHERE place BETWEEN ((total + 1) // 2 // 10 - 1) * 10 + 1 AND (total + 1) // 2 // 10 * 10
            UNION ALL
            SELECT id, job_name, task_id, status, tables_processed, 'last', CAST(ceil(total / 10.0) AS BIGINT)
            FROM r, n WHERE place > (ceil(total / 10.0) - 1) * 10""",
        "indexed_user_search": " UNION ALL ".join(
            f"SELECT id, email, role, last_name, active, '{value}' AS pattern FROM user_list WHERE email LIKE '%{value}%'"
            for value in ("7", "12", "r11", "99@shop", "er1_5@", "user%0@shop.test", "nobody")
        ),
        "reconcile_orders": f"""{different}
            UNION ALL SELECT orderid_bk, 'missing', NULL, 1 FROM orders_expected e
            WHERE orderid_bk NOT IN (SELECT orderid_bk FROM orders_actual)
            UNION ALL SELECT orderid_bk, 'unexpected', NULL, 1 FROM orders_actual
            WHERE orderid_bk NOT IN (SELECT orderid_bk FROM orders_expected)""",
        "high_water_mark": "SELECT MAX(id_order_detail) AS last_key FROM sg_order_detail",
        "delete_orders": """
            SELECT orderid_bk, customerid_bk, CAST(paid AS DOUBLE) AS paid, carrier FROM orders_expected
            WHERE carrier NOT LIKE '1%' AND paid <= 300000""",
        "row_fingerprint": """
            SELECT customer_key, md5(CAST(customerid_bk AS VARCHAR) || '-' || COALESCE(hashedemail, 'None') || '-'
                   || COALESCE(defaultgroup, 'None') || '-' || COALESCE(gender, 'None')) AS fingerprint
            FROM dim_customer_before""",
    }


_CLEANSED = {
    "id": "CAST({} AS BIGINT)",
    "int": "CAST({} AS INTEGER)",
    "text": "{}",
    "money": "CAST({} AS DOUBLE)",
    "flag": "CASE WHEN {0} IS NOT NULL THEN {0} <> 0 END",
    "moment": "CAST(CAST(NULLIF({}, '0000-00-00 00:00:00') AS TIMESTAMP) AS VARCHAR)",
    "day": "CAST(CAST(NULLIF({}, '0000-00-00') AS DATE) AS VARCHAR)",
    "hashed": "sha256({})",
    "id_or_0": "COALESCE(CAST({} AS BIGINT), 0)",
    "rate_or_0": "CAST(COALESCE({}, 0) AS DOUBLE)",
}
_JOINED = {
    "sg_product": """ps_product p LEFT JOIN ps_product_attribute v ON v.id_product = p.id_product""",
    "sg_cart": """(SELECT p.*, c.name AS carrier FROM ps_cart p LEFT JOIN ps_carrier c USING (id_carrier)) p""",
    "sg_orders": """(SELECT p.*, c.name AS carrier FROM ps_orders p
        LEFT JOIN ps_order_carrier oc ON oc.id_order = p.id_order
        LEFT JOIN ps_carrier c ON c.id_carrier = oc.id_carrier) p""",
    "sg_order_detail": """(SELECT p.*, t.rate AS tax_rate, t.name AS tax_name FROM ps_order_detail p
        LEFT JOIN ps_order_detail_tax dt ON dt.id_order_detail = p.id_order_detail
        LEFT JOIN ps_tax t ON t.id_tax = dt.id_tax) p""",
    "sg_order_payment": """(SELECT p.*, o.id_order FROM ps_order_payment p
        LEFT JOIN ps_orders o ON o.reference = p.order_reference) p""",
}


def _extracts() -> dict[str, str]:
    out = {}
    for target, spec in SPECS.items():
        source = _JOINED.get(target, f"{spec.source} p")
        columns = []
        for name, kind in spec.columns.items():
            owner = "v" if target == "sg_product" and name == "id_product_attribute" else "p"
            column = f'{owner}."{name}"'
            columns.append(f'{_CLEANSED[kind].format(column)} AS "{name}"')
        distinct = "DISTINCT " if target in _JOINED and target != "sg_product" else ""
        out[f"extract_{target}"] = f"SELECT {distinct}{', '.join(columns)} FROM {source}"
    out["stage_round_trip"] = out["extract_sg_order_history"]
    return out


def oracle_sql() -> dict[str, str]:
    return {name: _sql(body) for name, body in (_reports() | _loads() | _state() | _operations() | _extracts()).items()}
