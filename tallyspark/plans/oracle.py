"""The same queries as plain SQL for an independent engine."""

from __future__ import annotations

LINES_TPCH_ALL = """
all_lines AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(l_orderkey AS VARCHAR) AS order_id,
         o_orderdate AS order_date, l_quantity AS quantity,
         l_extendedprice / l_quantity AS unit_price,
         l_extendedprice * (1 - l_discount) AS line_value,
         p_name AS product, n_name AS country, c_name AS customer_name, p_type AS category,
         l_partkey AS part_key, l_linenumber AS line_number, l_returnflag AS return_flag,
         o_orderstatus AS order_status, c_mktsegment AS market_segment, TRUE AS is_product,
         CAST(round_even(l_extendedprice * (1 - l_discount) * 10000.0, 0) AS BIGINT) AS units
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey)"""
LINES_TPCH = LINES_TPCH_ALL + """,
lines AS (SELECT * FROM all_lines WHERE return_flag <> 'R')"""
LINES_EVENTS = """
lines AS (
  SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(event_id AS VARCHAR) AS order_id,
         ts AS order_date, CAST(1.0 AS DOUBLE) AS quantity, value AS unit_price,
         value AS line_value, '' AS product, '' AS country, TRUE AS is_product,
         CAST(round_even(value * 10000.0, 0) AS BIGINT) AS units
  FROM events WHERE event_type = 'purchase')"""

ORDERS = """,
ord AS (
  SELECT order_id, arg_min(customer_id, (order_date, customer_id)) AS customer_id,
         min(order_date) AS order_date, CAST(sum(units) AS BIGINT) AS value_units,
         CAST(coalesce(sum(CASE WHEN is_product THEN
              CAST(round_even(quantity * 10000.0, 0) AS BIGINT) END), 0) AS BIGINT) AS item_units
  FROM lines GROUP BY order_id)"""

FEATURES = ORDERS + """,
snap AS (SELECT max(order_date) + INTERVAL 1 DAY AS now_ts FROM lines),
act AS (
  SELECT customer_id, min(order_date) AS first_seen, max(order_date) AS last_seen,
         count(*) AS frequency, CAST(sum(value_units) AS BIGINT) AS spend,
         CAST(sum(item_units) AS BIGINT) AS items
  FROM ord GROUP BY customer_id),
ctry AS (
  SELECT customer_id, arg_min(country, (-n, country)) AS country FROM
    (SELECT customer_id, country, count(*) AS n FROM lines GROUP BY 1, 2) GROUP BY 1),
dist AS (SELECT customer_id, count(DISTINCT product) AS distinct_products
         FROM lines WHERE is_product GROUP BY 1),
feat AS (
  SELECT act.customer_id,
         CAST(floor((epoch_us(now_ts) - epoch_us(last_seen)) / 86400000000.0) AS INTEGER) AS recency,
         frequency, spend, spend / 10000.0::DOUBLE AS monetary,
         spend / (frequency * 10000.0::DOUBLE) AS avg_order_value,
         items / (frequency * 10000.0::DOUBLE) AS avg_basket_items,
         CAST(floor((epoch_us(last_seen) - epoch_us(first_seen)) / 86400000000.0) AS INTEGER) AS tenure_days,
         first_seen, last_seen, coalesce(distinct_products, 0) AS distinct_products, country
  FROM act CROSS JOIN snap LEFT JOIN ctry USING (customer_id) LEFT JOIN dist USING (customer_id))"""


def _score(column: str, name: str, reverse: bool = False) -> str:
    average_rank = (f"(rank() OVER (ORDER BY {column}) + "
                    f"(count(*) OVER (PARTITION BY {column}) - 1) / 2.0)")
    score = (f"least(5, greatest(1, CAST(ceil({average_rank} / (count(*) OVER ()) * 5) AS INTEGER)))")
    return f"CAST({'6 - ' if reverse else ''}{score} AS INTEGER) AS {name}"


SCORED = FEATURES + f""",
sc AS (SELECT *, {_score('recency', 'R', True)}, {_score('frequency', 'F')},
              {_score('monetary', 'M')} FROM feat),
scored AS (
  SELECT *, CASE
    WHEN R >= 4 AND F >= 4 AND M >= 4 THEN 'Champions'
    WHEN R >= 3 AND (F >= 4 OR M >= 4) THEN 'Loyal'
    WHEN R >= 4 AND F <= 2 AND tenure_days <= 60 THEN 'New'
    WHEN R <= 2 AND (F >= 3 OR M >= 3) THEN 'At-risk'
    WHEN R <= 2 THEN 'Dormant'
    WHEN F <= 2 AND tenure_days <= 90 THEN 'New' ELSE 'Loyal' END AS segment,
    CAST(R AS VARCHAR) || CAST(F AS VARCHAR) || CAST(M AS VARCHAR) AS rfm_cell
  FROM sc)"""

PROFILE = SCORED + """,
prof0 AS (
  SELECT segment, count(*) AS customers, sum(spend)::DOUBLE / 10000.0::DOUBLE AS revenue,
         avg(recency) AS avg_recency, avg(frequency) AS avg_frequency,
         avg(avg_order_value) AS avg_order_value
  FROM scored GROUP BY segment),
profile AS (
  SELECT segment,
    CAST(list_position(['Champions','Loyal','At-risk','New','Dormant'], segment) AS INTEGER) AS position,
    customers, round_even(revenue, 1) AS revenue,
    round_even(avg_recency, 1) AS avg_recency, round_even(avg_frequency, 1) AS avg_frequency,
    round_even(revenue / customers, 1) AS avg_monetary,
    round_even(avg_order_value, 1) AS avg_order_value,
    round_even(customers / sum(customers) OVER () * 100, 1) AS share_pct,
    round_even(revenue / sum(revenue) OVER () * 100, 1) AS rev_share_pct
  FROM prof0)"""

_FEATURE_ROWS = """
SELECT customer_id, recency, frequency, monetary, avg_order_value, avg_basket_items,
       tenure_days,
       strftime(first_seen, '%Y-%m-%d %H:%M:%S.%f') AS first_seen,
       strftime(last_seen, '%Y-%m-%d %H:%M:%S.%f') AS last_seen,
       distinct_products, country,
       CASE WHEN frequency > 1 THEN tenure_days / (frequency - 1) END AS interpurchase_days
FROM feat"""

ORACLE = {
    "segment_profile": f"WITH {LINES_TPCH}{PROFILE} SELECT * FROM profile",
    "segment_profile_events": f"WITH {LINES_EVENTS}{PROFILE} SELECT * FROM profile",
    "rfm_scores": f"WITH {LINES_TPCH}{SCORED} SELECT customer_id, R, F, M, segment, rfm_cell FROM scored",
    "rfm_scores_events": f"WITH {LINES_EVENTS}{SCORED} SELECT customer_id, R, F, M, segment, rfm_cell FROM scored",
    "rfm_cells": f"WITH {LINES_TPCH}{SCORED} SELECT rfm_cell, segment, count(*) AS customers FROM scored GROUP BY 1, 2",
    "order_rollup": f"""WITH {LINES_TPCH}{ORDERS}
        SELECT order_id, customer_id, strftime(order_date, '%Y-%m-%d') AS order_day,
               value_units / 10000.0::DOUBLE AS order_value,
               item_units / 10000.0::DOUBLE AS order_items FROM ord""",
    "customer_features": f"WITH {LINES_TPCH}{FEATURES}{_FEATURE_ROWS}",
    "customer_features_events": f"WITH {LINES_EVENTS}{FEATURES}{_FEATURE_ROWS}",
}

# --- canonical frame ------------------------------------------------------------------------

def _cents_text(value: str, mark: str = ",") -> str:
    cents = f"CAST(round_even({value} * 100, 0) AS BIGINT)"
    return (f"(CAST({cents} // 100 AS VARCHAR) || '{mark}' || "
            f"lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))")


def _grouped_text(value: str, group: str, mark: str) -> str:
    cents = f"CAST(round_even({value} * 100, 0) AS BIGINT)"
    return (f"(replace(format('{{:,}}', {cents} // 100), ',', '{group}') || '{mark}' || "
            f"lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))")


MESSY = LINES_TPCH_ALL + f""",
marked AS (SELECT *, (CAST(order_id AS BIGINT) * 7 + line_number) % 40 AS m FROM all_lines),
raw AS (
  SELECT CASE WHEN m = 1 THEN ' ' WHEN m = 8 THEN 'NaN' WHEN m <> 6 THEN ' ' || customer_id || ' ' END AS kunde,
         CASE WHEN m = 3 THEN 'C' || order_id ELSE order_id END AS beleg,
         CASE WHEN m = 0 THEN 'not a date' ELSE strftime(order_date, '%d.%m.%Y') END AS datum,
         CASE WHEN m = 4 THEN '0' WHEN m = 7 THEN '' ELSE CAST(CAST(quantity AS BIGINT) AS VARCHAR) END AS menge,
         CASE WHEN m = 2 THEN 'n/a' WHEN m = 5 THEN '-5,00' ELSE {_cents_text('unit_price')} || ' Kč' END AS preis,
         product AS artikel, country AS land FROM marked),
parsed AS (
  SELECT trim(kunde) AS customer_id, beleg AS order_id,
         try_strptime(datum, '%d.%m.%Y') AS order_date,
         coalesce(try_cast(menge AS DOUBLE), 1.0) AS quantity,
         try_cast(replace(regexp_replace(preis, '[^0-9,-]', '', 'g'), ',', '.') AS DOUBLE) AS unit_price,
         artikel AS product, land AS country FROM raw),
canon AS (
  SELECT *, quantity * unit_price AS line_value,
    CASE WHEN order_date IS NULL THEN 'unparseable date'
         WHEN customer_id IS NULL OR lower(customer_id) IN ('', 'nan', 'none') THEN 'missing customer id'
         WHEN unit_price IS NULL THEN 'unparseable price'
         WHEN regexp_full_match(order_id, '[Cc][0-9]+') OR quantity <= 0 THEN 'cancellations / returns'
         WHEN unit_price <= 0 THEN 'non-positive price' END AS drop_reason
  FROM parsed)"""
_CANON_ROWS = """SELECT customer_id, order_id, strftime(order_date, '%Y-%m-%d') AS order_day,
    quantity, unit_price, line_value, product, country"""
_LIST_PRICE = f"CAST({_cents_text('unit_price', '.')} AS DOUBLE)"

_SHOP_VALUE = f"CAST({_cents_text('line_value', '.')} AS DOUBLE)"
SHOP = LINES_TPCH_ALL + f""",
typed AS (
  SELECT *, part_key % 10 AS kind, CAST(part_key AS VARCHAR) AS pk,
         (CAST(order_id AS BIGINT) * 7 + line_number) % 50 AS broken FROM all_lines),
shop AS (
  SELECT CASE WHEN broken = 0 THEN '' ELSE customer_id END AS customer_id, order_id,
    strftime(order_date, '%Y-%m-%d') AS order_day,
    CASE WHEN broken = 1 THEN 0.0 ELSE CAST(CAST(quantity AS BIGINT) AS DOUBLE) END AS quantity,
    {_LIST_PRICE} AS unit_price,
    CASE WHEN broken <> 2 THEN CASE WHEN kind = 2 THEN -{_SHOP_VALUE} ELSE {_SHOP_VALUE} END END AS line_value,
    CAST({_cents_text('(unit_price * 0.5)', '.')} AS DOUBLE) AS line_cost,
    CASE kind WHEN 0 THEN 'SHIPPING-' WHEN 1 THEN 'billing-' WHEN 2 THEN 'COUPON-' WHEN 3 THEN 'GIFT-' ELSE '' END || pk AS product,
    country,
    CASE WHEN order_status = 'P' THEN 'Stornována' WHEN order_status = 'O' AND kind = 9 THEN 'Platba selhala'
         ELSE 'Vyřízena' END AS status,
    kind NOT IN (0, 1, 2) AS is_product,
    CASE WHEN broken IN (0, 2) THEN 'missing customer / date / value'
         WHEN kind IN (0, 1) THEN 'billing / shipping lines'
         WHEN order_status = 'P' OR (order_status = 'O' AND kind = 9) THEN 'cancelled / returned / failed' END AS drop_reason
  FROM typed)"""

_REPORT = "SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS rows FROM {} GROUP BY 1"
_STAMP = "(o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60))"
_RENDERED = f"""
rendered AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, {_STAMP} AS stamp, o_orderdate AS d,
    strftime({_STAMP}, '%-d.%-m.%Y') AS dotted, strftime({_STAMP}, '%d/%m/%Y') AS slashed,
    strftime({_STAMP}, '%m/%d/%Y') AS american,
    CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS DOUBLE) AS excel,
    epoch(o_orderdate) + 3652 * 86400 AS seconds, o_orderdate + to_days(3652) AS later FROM orders)"""
_KIND = """SELECT '{0}' AS rendering,
    CASE WHEN median({0}) BETWEEN 20000 AND 80000 THEN 'excel' WHEN median({0}) BETWEEN 1e9 AND 3e9 THEN 'seconds'
         WHEN median({0}) BETWEEN 1e12 AND 3e12 THEN 'millis' ELSE 'text' END AS kind,
    FALSE AS day_first, CAST(1.0 AS DOUBLE) AS numeric_share FROM {1}"""
_FIRST = """SELECT '{0}' AS rendering, 'text' AS kind,
    CASE WHEN bool_or(CAST(regexp_extract({0}, '^([0-9]+)', 1) AS INTEGER) > 12)
          AND NOT bool_or(CAST(regexp_extract({0}, '^[0-9]+[./]([0-9]+)', 1) AS INTEGER) > 12) THEN TRUE
         WHEN bool_or(CAST(regexp_extract({0}, '^[0-9]+[./]([0-9]+)', 1) AS INTEGER) > 12)
          AND NOT bool_or(CAST(regexp_extract({0}, '^([0-9]+)', 1) AS INTEGER) > 12) THEN FALSE
         ELSE bool_or(contains({0}, '.')) END AS day_first,
    CAST(0.0 AS DOUBLE) AS numeric_share FROM rendered"""
_FULL = "strftime({}, '%Y-%m-%d %H:%M:%S')"

ORACLE.update({
    "clean_lines": f"WITH {MESSY} {_CANON_ROWS} FROM canon WHERE drop_reason IS NULL",
    "ingest_reasons": f"WITH {MESSY} {_REPORT.format('canon')}",
    "retail_scan": f"""WITH {LINES_TPCH} SELECT customer_id, order_id,
        strftime(order_date, '%Y-%m-%d') AS order_day, quantity, unit_price,
        quantity * unit_price AS line_value, product, country FROM lines""",
    "shop_lines": f"WITH {SHOP} SELECT customer_id, order_id, order_day, quantity, unit_price, "
                  "line_value, line_cost, product, country, status, is_product FROM shop WHERE drop_reason IS NULL",
    "shop_report": f"WITH {SHOP} {_REPORT.format('shop')}",
    "parse_numbers_eu": f"""WITH {LINES_TPCH_ALL} SELECT order_id, line_number,
        CAST({_cents_text('line_value', '.')} AS DOUBLE) AS value FROM all_lines""",
    "parse_numbers_us": f"""WITH {LINES_TPCH_ALL} SELECT order_id, line_number,
        CAST({_cents_text('line_value', '.')} AS DOUBLE) AS value FROM all_lines""",
    "date_kinds": f"""WITH {_RENDERED},
        numbers AS (SELECT CAST(strftime(d, '%Y%m%d') AS DOUBLE) AS compact, excel, seconds,
                           seconds * 1000 AS millis FROM rendered)
        SELECT 'iso' AS rendering, 'text' AS kind, FALSE AS day_first, CAST(0.0 AS DOUBLE) AS numeric_share
        UNION ALL SELECT 'named', 'text', FALSE, CAST(0.0 AS DOUBLE)
        UNION ALL {_FIRST.format('dotted')} UNION ALL {_FIRST.format('slashed')}
        UNION ALL {_FIRST.format('american')}
        UNION ALL {_KIND.format('compact', 'numbers')} UNION ALL {_KIND.format('excel', 'numbers')}
        UNION ALL {_KIND.format('seconds', 'numbers')} UNION ALL {_KIND.format('millis', 'numbers')}""",
    "parse_dates": f"""WITH {_RENDERED} SELECT order_id, {_FULL.format('stamp')} AS iso,
        {_FULL.format('stamp')} AS dotted, {_FULL.format('stamp')} AS american,
        {', '.join(_FULL.format('d') + ' AS ' + c for c in
                   ('slashed', 'compact', 'named', 'excel'))},
        {_FULL.format('later')} AS seconds, {_FULL.format('later')} AS millis FROM rendered""",
    "order_id_synthesis": f"""WITH {LINES_TPCH} SELECT customer_id || '@' || strftime(order_date, '%Y-%m-%d') AS order_id,
        count(*) AS rows FROM lines GROUP BY 1""",
    "derive_prices": f"""WITH {LINES_TPCH_ALL} SELECT order_id, line_number,
        line_value / nullif(CASE WHEN line_number = 7 THEN 0.0 ELSE quantity END, 0.0) AS unit_price FROM all_lines""",
    "export_folder": f"""WITH {LINES_TPCH_ALL}, p AS (SELECT *, {_LIST_PRICE} AS price FROM all_lines)
        SELECT customer_id, order_id, strftime(order_date, '%Y-%m-%d') AS order_day, quantity,
               price AS unit_price, quantity * price AS line_value,
               product || CASE WHEN order_status = 'O' THEN chr(10) || 'second line' ELSE '' END AS product,
               '' AS country FROM p WHERE quantity > 0 AND price > 0""",
    "export_quoted": f"""WITH {LINES_TPCH_ALL}, p AS (SELECT *, {_LIST_PRICE} AS price FROM all_lines)
        SELECT customer_id, order_id, strftime(order_date, '%Y-%m-%d') AS order_day, quantity,
               price AS unit_price, quantity * price AS line_value,
               '27" of ' || product || ',' || chr(10) || '"second"' || chr(10) || chr(10)
               || ', line' AS product, '' AS country FROM p WHERE quantity > 0 AND price > 0""",
    "export_repeated_header": f"""WITH {LINES_TPCH_ALL}, p AS (SELECT *, {_LIST_PRICE} AS price FROM all_lines),
        r AS (SELECT CASE WHEN NOT quantity > 0 THEN 'cancellations / returns'
                          WHEN NOT price > 0 THEN 'non-positive price' ELSE 'kept' END AS reason FROM p
              UNION ALL SELECT 'unparseable date' FROM orders WHERE o_orderkey % 1000 < 4)
        SELECT reason, count(*) AS rows FROM r GROUP BY 1""",
    "export_ragged": f"""WITH {LINES_TPCH_ALL}, p AS (SELECT *, {_LIST_PRICE} AS price FROM all_lines)
        SELECT customer_id, order_id, strftime(order_date, '%Y-%m-%d') AS order_day, quantity,
               price AS unit_price, quantity * price AS line_value,
               CASE line_number % 3 WHEN 1 THEN 'whole' WHEN 2 THEN 'long' ELSE '' END AS product, '' AS country
        FROM p WHERE quantity > 0 AND price > 0""",
    "export_dialects": """
        SELECT 'semicolon' AS folder, 'cp1250' AS encoding, ';' AS delimiter, FALSE AS multiline,
               CAST(0 AS INTEGER) AS skipped_rows, 'zákazník|datum|celkem|event_type' AS header
        FROM (SELECT count(*) AS n FROM events) WHERE n > 0
        UNION ALL SELECT 'comma', 'utf-8', ',', FALSE, 0, 'zákazník|datum|celkem|event_type'
        FROM (SELECT count(*) AS n FROM events) WHERE n > 0
        UNION ALL SELECT 'bar', 'utf-8', '|', FALSE, 0, 'zákazník|datum|celkem|event_type'
        FROM (SELECT count(*) AS n FROM events) WHERE n > 0""",
    "nested_orders": f"""WITH {LINES_TPCH_ALL}, p AS (SELECT *, {_LIST_PRICE} AS price FROM all_lines)
        SELECT customer_id || '@shop.example' AS customer_id, order_id,
               strftime(order_date, '%Y-%m-%d') AS order_day, quantity, price AS unit_price,
               quantity * price AS line_value, product, country FROM p WHERE quantity > 0 AND price > 0""",
})

# --- column meaning ---------------------------------------------------------------------------

_HEADERS = "['Datum', 'E-Mail Kunde', 'Bestell-Nr', 'Menge', 'Einzelpreis', 'Artikel', 'Land']"
# Which canonical column each of the seven headers stands for when no other is free.
_MEANING = """
hdr AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS "table", l_linenumber AS position FROM lineitem),
named AS (SELECT "table", list_extract({0}, position) AS header, CASE position
            WHEN 1 THEN 'order_date' WHEN 2 THEN 'customer_id' WHEN 3 THEN 'order_id' WHEN 4 THEN 'quantity'
            WHEN 5 THEN 'unit_price' WHEN 6 THEN 'product' WHEN 7 THEN 'country' END AS canonical
          FROM hdr)""".format(_HEADERS)
_EU = "[0-9]{1,3}([.][0-9]{3})+(,[0-9]+)?"
_US = "[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?"


def _evidence(name, text, decimal, currency, language):
    def hits(pattern):
        return f"CAST(count(*) FILTER (WHERE regexp_full_match(num, '{pattern}')) AS BIGINT)"
    return f"""SELECT '{name}' AS "table", {hits(_EU)} AS eu_grouped, {hits(_US)} AS us_grouped,
      {hits('[0-9.]*[0-9],[0-9]{1,2}')} AS comma_decimal,
      {hits('[0-9,]*[0-9][.][0-9]{1,2}')} AS dot_decimal,
      {decimal} AS decimal, '{currency}' AS currency, '{language}' AS language
      FROM (SELECT {text} AS num FROM all_lines)"""


_BY_COUNT = ("CASE WHEN {0} > {1} THEN ',' WHEN {1} > {0} THEN '.' WHEN {2} > {3} THEN ',' "
             "WHEN {3} > {2} THEN '.' ELSE '.' END")
_DECIDED = _BY_COUNT.format("eu_grouped", "us_grouped", "comma_decimal", "dot_decimal")

ORACLE.update({
    "number_evidence": f"""WITH {LINES_TPCH_ALL}, e AS (
        {_evidence('eu', _grouped_text('line_value', '.', ','), "''", 'Kč', 'cs')}
        UNION ALL {_evidence('us', _grouped_text('line_value', ',', '.'), "''", '$', 'en')}
        UNION ALL {_evidence('plain', _cents_text('line_value', '.'), "''", '', 'en')}
        UNION ALL {_evidence('comma', _cents_text('line_value'), "''", '€', 'en')})
        SELECT "table", eu_grouped, us_grouped, comma_decimal, dot_decimal,
               {_DECIDED} AS decimal, currency, language FROM e""",
    "header_mapping": f'WITH {_MEANING} SELECT "table", canonical, header FROM named',
    "missing_required_columns": f"""WITH {_MEANING} SELECT "table", concat_ws(', ',
        CASE WHEN NOT bool_or(canonical = 'customer_id') THEN 'customer_id' END,
        CASE WHEN NOT bool_or(canonical = 'order_date') THEN 'order_date' END,
        CASE WHEN NOT bool_or(canonical = 'unit_price') THEN 'unit_price (or a total column)' END) AS missing
        FROM named GROUP BY 1""",
})

# --- summary, quality, calendar -----------------------------------------------------------------

_SUMMARY = ORDERS + """
SELECT (SELECT count(*) FROM lines) AS rows, count(DISTINCT customer_id) AS customers,
       (SELECT count(*) FROM ord) AS orders, count(DISTINCT country) AS countries,
       strftime(min(order_date), '%Y-%m-%d') AS date_from, strftime(max(order_date), '%Y-%m-%d') AS date_to,
       round_even((SELECT sum(value_units)::DOUBLE / 10000.0::DOUBLE FROM ord), 2) AS revenue,
       round_even((SELECT sum(value_units)::DOUBLE / 10000.0::DOUBLE / count(*) FROM ord), 2) AS avg_order_value
FROM lines"""
_DAILY = """, daily AS (
  SELECT CAST(order_date AS DATE) AS d, CAST(sum(units) AS BIGINT) AS units,
         count(DISTINCT order_id) AS orders FROM lines GROUP BY 1)"""
_DAILY_ROWS = """ SELECT strftime(d, '%Y-%m-%d') AS "date", units / 10000.0::DOUBLE AS revenue, orders FROM daily"""
_SEASON = """,
span AS (SELECT min(CAST(order_date AS DATE)) AS a, max(CAST(order_date AS DATE)) AS b FROM lines),
cal AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM span),
expo AS (SELECT month(d) AS month_num, count(*) AS n FROM cal GROUP BY 1),
moy AS (SELECT month(order_date) AS month_num, CAST(sum(units) AS BIGINT) AS units FROM lines GROUP BY 1),
rate AS (SELECT month_num, coalesce(units / 10000.0::DOUBLE, 0) / n AS rate
         FROM expo LEFT JOIN moy USING (month_num)),
idx AS (SELECT CAST(month_num AS INTEGER) AS month_num,
  list_extract(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], month_num) AS month,
  CAST(round_even(rate / (avg(rate) OVER ()) * 100, 0) AS INTEGER) AS "index" FROM rate)"""
_EN_SHORT = ("The data covers only {} days. Frequency-based segmentation needs roughly 6+ months — "
             "on a short window almost everyone looks like a one-time buyer.")
_CS_SHORT = ("Data pokrývají jen {} dní. Segmentace podle frekvence nákupů potřebuje zhruba 6+ měsíců "
             "– na krátkém okně vypadá skoro každý jako jednorázový zákazník.")


def _warned(short: str, few: str, weak: str) -> str:
    def said(text):
        before, after = text.split("{}")
        return before, after
    s0, s1 = said(short)
    f0, f1 = said(few)
    return f"""SELECT 'short-window' AS code, 'high' AS severity, '{s0}' || span_days || '{s1}' AS message FROM q WHERE span_days < 180
      UNION ALL SELECT 'few-customers', 'medium', '{f0}' || customers || '{f1}' FROM q WHERE customers < 50
      UNION ALL SELECT 'weak-structure', 'medium', '{weak}' FROM q WHERE customers >= 50"""


_QUALITY = """
q AS (SELECT CAST(floor((epoch_us(max(order_date)) - epoch_us(min(order_date))) / 86400000000.0) AS INTEGER) AS span_days,
             count(DISTINCT customer_id) AS customers FROM lines),
med AS (SELECT median(v) AS median_order FROM (SELECT CAST(sum(units) AS BIGINT) / 10000.0::DOUBLE AS v FROM lines GROUP BY order_id))"""

ORACLE.update({
    "frame_summary": f"WITH {LINES_TPCH}{_SUMMARY}",
    "frame_summary_events": f"WITH {LINES_EVENTS}{_SUMMARY}",
    "kpis": f"""WITH {LINES_TPCH}{FEATURES} SELECT count(*) AS total_customers,
        round_even(count(*) FILTER (WHERE frequency > 1) / count(*) * 100, 1) AS repeat_rate_pct,
        round_even(sum(spend)::DOUBLE / 10000.0::DOUBLE / sum(frequency), 2) AS avg_order_value,
        round_even(sum(spend)::DOUBLE / 10000.0::DOUBLE, 2) AS revenue FROM feat""",
    "quality_inputs": f"""WITH {MESSY}, lines AS (SELECT *,
          CAST(round_even(line_value * 10000.0, 0) AS BIGINT) AS units FROM canon WHERE drop_reason IS NULL), {_QUALITY}
        SELECT span_days, round_even(median_order, 4) AS median_order, customers,
          round_even((SELECT count(*) FILTER (WHERE drop_reason IN ('unparseable date', 'unparseable price', 'missing customer id'))
             / count(*) FROM canon), 6) AS suspicious_share FROM q CROSS JOIN med""",
    "quality_inputs_events": f"""WITH {LINES_EVENTS}, {_QUALITY}
        SELECT span_days, median_order, customers, CAST(0.0 AS DOUBLE) AS suspicious_share FROM q CROSS JOIN med""",
    "quality_warnings": f"""WITH {LINES_EVENTS}, {_QUALITY}
        {_warned(_EN_SHORT, 'Only {} customers — quantile-based segments are coarse below ~50; read them as rough groups.',
                 'Rule-based segments and KMeans clusters barely agree (ARI 0.06) — segment boundaries are uncertain. Often a symptom of a short or sparse history.')}
        UNION ALL {_warned(_CS_SHORT, 'Jen {} zákazníků – kvantilové segmenty jsou pod ~50 zákazníky hrubé; berte je jako orientační skupiny.',
                 'Pravidlové segmenty a shluky KMeans se téměř neshodují (ARI 0.06) – hranice segmentů jsou nejisté. Bývá to příznak krátké nebo řídké historie.')}""",
    "unusable_inputs": f"""WITH {LINES_TPCH}, part AS (
          SELECT 'all' AS input, customer_id FROM lines
          UNION ALL SELECT 'one customer', customer_id FROM lines WHERE customer_id = (SELECT min(customer_id) FROM lines)),
        n AS (SELECT input, count(customer_id) AS rows, count(DISTINCT customer_id) AS customers
              FROM (VALUES ('all'), ('one customer'), ('no lines')) AS c(input) LEFT JOIN part USING (input) GROUP BY 1)
        SELECT input, rows, customers, CASE WHEN rows = 0 THEN 'no usable rows; check the file or the column mapping'
          WHEN customers < 2 THEN 'at least two customers are needed' ELSE 'accepted' END AS verdict FROM n""",
    "factor_first_values": """SELECT strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') AS date,
          arg_min(value, event_id) FILTER (WHERE event_id % 3 <> 0) AS level FROM events GROUP BY 1""",
    "daily_sales": f"WITH {LINES_TPCH}{_DAILY}{_DAILY_ROWS}",
    "daily_sales_events": f"WITH {LINES_EVENTS}{_DAILY}{_DAILY_ROWS}",
    "daily_sales_streamed": f"WITH {LINES_EVENTS}{_DAILY}{_DAILY_ROWS}",
    "monthly_curve": f"""WITH {LINES_TPCH}, m AS (
          SELECT date_trunc('month', order_date)::DATE AS p, CAST(sum(units) AS BIGINT) AS units,
                 count(DISTINCT order_id) AS orders FROM lines GROUP BY 1),
        cal AS (SELECT CAST(unnest(generate_series(min(p), max(p), INTERVAL 1 MONTH)) AS DATE) AS p FROM m)
        SELECT strftime(p, '%Y-%m') AS month, coalesce(units / 10000.0::DOUBLE, 0) AS revenue,
               coalesce(orders, 0) AS orders FROM cal LEFT JOIN m USING (p)""",
    "seasonality": f"WITH {LINES_TPCH}{_SEASON} SELECT * FROM idx",
    "seasonality_events": f"WITH {LINES_EVENTS}{_SEASON} SELECT * FROM idx",
    "peak_month": f"""WITH {LINES_TPCH}{_SEASON},
        top AS (SELECT * FROM idx ORDER BY "index" DESC, month_num LIMIT 1),
        low AS (SELECT * FROM idx ORDER BY "index", month_num LIMIT 1)
        SELECT top.month AS peak_month, top."index" AS peak_index, CAST(top."index" - 100 AS INTEGER) AS peak_uplift_pct,
               low.month AS low_month, low."index" AS low_index FROM top CROSS JOIN low""",
})

# --- factors --------------------------------------------------------------------------------------

_FACTORS = """,
fac AS (SELECT CAST(ts AS DATE) AS d, count(*) FILTER (WHERE event_type = 'error') AS errors,
          count(*) FILTER (WHERE event_type = 'click') AS clicks,
          count(*) FILTER (WHERE event_type = 'view') AS views
        FROM events WHERE event_type <> 'purchase' GROUP BY 1),
comb AS (SELECT daily.d, units, units / 10000.0::DOUBLE AS revenue, errors, clicks, views,
           CASE WHEN fac.d IS NOT NULL THEN CAST(dayofweek(fac.d) IN (0, 6) AS INTEGER) END AS weekend
         FROM daily LEFT JOIN fac ON daily.d = fac.d)"""


def _numeric_factor(name: str) -> str:
    return f"""SELECT '{name}' AS factor, corr({name}, revenue) AS r, count(*) AS n,
      count({name}) AS known, min({name}) < max({name}) AS varies FROM comb"""


ORACLE.update({
    "factor_effects": f"""WITH {LINES_EVENTS}{_DAILY}{_FACTORS},
      num AS ({_numeric_factor('errors')} UNION ALL {_numeric_factor('clicks')} UNION ALL {_numeric_factor('views')}),
      flag AS (SELECT count(*) AS n, count(weekend) AS known, count(*) FILTER (WHERE weekend = 1) AS on_days,
                 count(*) FILTER (WHERE weekend = 0) AS off_days,
                 sum(units) FILTER (WHERE weekend = 1)::DOUBLE / 10000.0::DOUBLE AS on_sum,
                 sum(units) FILTER (WHERE weekend = 0)::DOUBLE / 10000.0::DOUBLE AS off_sum FROM comb),
      lift AS (SELECT *, on_sum / on_days AS avg_on, off_sum / off_days AS avg_off FROM flag
               WHERE n >= 30 AND known >= 30 AND on_days >= 3 AND off_days >= 3),
      eff AS (
        SELECT factor, 'numeric' AS type, CAST(NULL AS DOUBLE) AS effect_pct, round_even(r, 3) AS correlation,
          CAST(0 AS BIGINT) AS on_days, CAST(NULL AS DOUBLE) AS avg_on, CAST(NULL AS DOUBLE) AS avg_off,
          CASE WHEN r >= 0 THEN 'raises' ELSE 'lowers' END AS direction,
          CASE WHEN abs(r) >= 0.5 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength
        FROM num WHERE n >= 30 AND known >= 30 AND varies
        UNION ALL
        SELECT 'weekend', 'flag', round_even((avg_on - avg_off) / avg_off * 100, 1), NULL, on_days,
          round_even(avg_on, 2), round_even(avg_off, 2),
          CASE WHEN avg_on >= avg_off THEN 'raises' ELSE 'lowers' END, NULL FROM lift WHERE avg_off <> 0)
      SELECT *, CAST(row_number() OVER (ORDER BY abs(coalesce(effect_pct, correlation * 100)) DESC, factor) AS INTEGER)
        AS position FROM eff""",
    "factor_matched": f"""WITH {LINES_EVENTS}{_DAILY}{_FACTORS}
      SELECT count(*) AS n_days, count(*) FILTER (WHERE errors IS NOT NULL AND day(d) <= 20) AS matched_days FROM comb""",
})

# --- products -----------------------------------------------------------------------------------------

_MIX = """
SELECT segment, category, round_even(CAST(sum(units) AS BIGINT) / 10000.0::DOUBLE, 2) AS revenue,
       count(DISTINCT customer_id) AS customers
FROM cat JOIN scored USING (customer_id)
WHERE category IN (SELECT category FROM cat JOIN scored USING (customer_id) GROUP BY 1
                   ORDER BY sum(units) DESC, category LIMIT {})
GROUP BY 1, 2"""
_WORD = "split_part(product, ' ', 1)"
_CATALOG = """
entry AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name,
            left(p_type, 2) AS "cat_1_ID", p_type AS cat_1_name, p_brand AS "cat_2_ID", p_brand AS cat_2_name
          FROM part WHERE p_partkey % 7 <> 0),
catalog AS (SELECT * FROM entry UNION ALL
            SELECT product_id, 'z ' || product_name, "cat_1_ID", cat_1_name, "cat_2_ID", cat_2_name
            FROM entry WHERE CAST(product_id AS BIGINT) % 5 = 0)"""
_MISSING = """
absent AS (SELECT DISTINCT CAST(part_key AS VARCHAR) AS product_id FROM lines WHERE part_key % 7 = 0),
filler AS (SELECT product_id, 'Produkt ' || product_id AS product_name, 'C99' AS "cat_1_ID",
             'Ostatni' AS cat_1_name, 'C9901' AS "cat_2_ID", 'Nezarazeno' AS cat_2_name FROM absent)"""

ORACLE.update({
    "category_from_names": """SELECT p_partkey,
        upper(left(p_name, 1)) || lower(split_part(substr(p_name, 2), ' ', 1)) AS category,
        CASE WHEN p_size > 5 THEN p_type ELSE 'Other' END AS label FROM part""",
    "product_mix": f"""WITH {LINES_TPCH}{SCORED},
        cat AS (SELECT customer_id, units, coalesce(nullif(category, ''), 'Other') AS category FROM lines) {_MIX.format(4)}""",
    "product_mix_from_text": f"""WITH {LINES_TPCH}{SCORED},
        cat AS (SELECT customer_id, units, upper(left({_WORD}, 1)) || lower(substr({_WORD}, 2)) AS category
                FROM lines) {_MIX.format(12)}""",
    "catalog_join": f"""WITH {LINES_TPCH}, {_CATALOG} SELECT order_id, line_number, CAST(part_key AS VARCHAR) AS product,
        product_name, cat_1_name, cat_2_name FROM lines LEFT JOIN entry ON CAST(part_key AS VARCHAR) = product_id""",
    "catalog_repeats": f"WITH {_CATALOG} SELECT product_id, min(product_name) AS product_name, count(*) AS entries FROM catalog GROUP BY 1",
    "catalog_missing": f"WITH {LINES_TPCH}, {_MISSING} SELECT * FROM filler",
    "catalog_complete": f"WITH {LINES_TPCH}, {_CATALOG}, {_MISSING} SELECT * FROM catalog UNION ALL SELECT * FROM filler",
})

# --- clusters and lookalikes ------------------------------------------------------------------------------

_MODEL = ["recency", "frequency", "monetary", "avg_order_value", "avg_basket_items",
          "distinct_products"]
_DAMPED = ", ".join(f"{'CAST(recency AS DOUBLE)' if c == 'recency' else f'ln(1 + greatest({c}, 0))'} AS d_{c}"
                    for c in _MODEL)
SCALED = f""",
damp AS (SELECT *, {_DAMPED} FROM scored),
scaled AS (SELECT *, {', '.join(f'(d_{c} - avg(d_{c}) OVER ()) / stddev_pop(d_{c}) OVER () AS z_{c}' for c in _MODEL)}
           FROM damp)"""
_LENGTH = "(sqrt(" + " + ".join(f"z_{c} * z_{c}" for c in _MODEL) + ") + 1e-9)"
UNIT = SCALED + f""",
unit AS (SELECT *, {', '.join(f'z_{c} / {_LENGTH} AS u_{c}' for c in _MODEL)} FROM scaled)"""
_DOT = " + ".join(f"unit.u_{c} * target.u_{c}" for c in _MODEL)
_NEAR = ("unit.customer_id AS customer_id, round_even(" + _DOT + ", 3) AS similarity, unit.recency AS recency, "
         "unit.frequency AS frequency, unit.monetary AS monetary, unit.avg_order_value AS avg_order_value, "
         "unit.segment AS segment")
_CENTRE = ", ".join(f"avg(u_{c}) AS u_{c}" for c in _MODEL)
EXPANDED = UNIT + f""",
target AS (SELECT {_CENTRE} FROM unit WHERE segment = 'Champions'),
prospects AS (SELECT {_NEAR} FROM unit CROSS JOIN target WHERE unit.segment <> 'Champions'
              ORDER BY {_DOT} DESC, unit.customer_id LIMIT 15)"""
_PROFILE_TAIL = PROFILE[len(SCORED):]
PSTATS = EXPANDED + """,
pstats AS (SELECT 'Champions' AS for_segment, count(*) AS customers,
    round_even(count(*) / (SELECT count(*) FROM scored) * 100, 1) AS share_pct,
    round_even(sum(monetary) / (SELECT round_even(sum(spend)::DOUBLE / 10000.0::DOUBLE, 2) FROM scored) * 100, 1) AS rev_share_pct,
    avg(recency) AS avg_recency, avg(frequency) AS avg_frequency, avg(monetary) AS avg_monetary,
    avg(avg_order_value) AS avg_order_value FROM prospects)"""

ORACLE.update({
    "scaled_features": f"WITH {LINES_TPCH}{SCORED}{SCALED} SELECT customer_id, "
                       + ", ".join(f"round_even(z_{c}, 6) + 0.0 AS z_{c}" for c in _MODEL) + " FROM scaled",
    "lookalikes": f"""WITH {LINES_TPCH}{SCORED}{UNIT},
        target AS (SELECT * FROM unit WHERE customer_id = (SELECT min(customer_id) FROM unit))
        SELECT {_NEAR} FROM unit CROSS JOIN target WHERE unit.customer_id <> target.customer_id
        ORDER BY {_DOT} DESC, unit.customer_id LIMIT 8""",
    "lookalikes_many": f"""WITH {LINES_TPCH}{SCORED}{UNIT},
        target AS (SELECT * FROM unit WHERE segment = 'Champions'),
        near AS (SELECT target.customer_id AS anchor_id, unit.customer_id AS customer_id, {_DOT} AS dot
                 FROM unit JOIN target ON unit.customer_id <> target.customer_id),
        placed AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY dot DESC, customer_id) AS place FROM near)
        SELECT anchor_id, CAST(place AS INTEGER) AS place, customer_id, round_even(dot, 3) AS similarity
        FROM placed WHERE place <= 8""",
    "segment_expansion": f"WITH {LINES_TPCH}{SCORED}{EXPANDED} SELECT * FROM prospects",
    "seed_segment": f"""WITH {LINES_TPCH}{PROFILE} SELECT coalesce(max(segment) FILTER (WHERE segment = 'Champions'),
        arg_max(segment, (rev_share_pct, -position))) AS seed FROM profile""",
    "prospect_stats": f"""WITH {LINES_TPCH}{SCORED}{PSTATS} SELECT for_segment, customers, share_pct, rev_share_pct,
        round_even(avg_recency, 4) AS avg_recency, round_even(avg_frequency, 4) AS avg_frequency,
        round_even(avg_monetary, 4) AS avg_monetary, round_even(avg_order_value, 4) AS avg_order_value FROM pstats""",
    "rand_index": f"""WITH {LINES_TPCH}{SCORED},
        lab AS (SELECT segment AS a, c_mktsegment AS b FROM scored JOIN customer ON CAST(c_custkey AS VARCHAR) = customer_id),
        ct AS (SELECT a, b, count(*) AS n FROM lab GROUP BY 1, 2),
        s AS (SELECT sum(n * (n - 1) / 2) AS ij, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM ct GROUP BY a)) AS sa,
                (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM ct GROUP BY b)) AS sb,
                sum(n) * (sum(n) - 1) / 2 AS t FROM ct)
        SELECT round_even((ij - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t), 6) AS ari FROM s""",
    "silhouette": f"""WITH {LINES_TPCH}{SCORED}{SCALED},
        pt AS (SELECT customer_id, segment, {', '.join('z_' + c for c in _MODEL)},
                 {' + '.join(f'z_{c} ** 2' for c in _MODEL)} AS norm FROM scaled),
        mid AS (SELECT segment AS other, count(*) AS n, avg(norm) AS square,
                  {', '.join(f'avg(z_{c}) AS m_{c}' for c in _MODEL)} FROM pt GROUP BY 1),
        gap AS (SELECT customer_id, segment AS own, other, n, greatest(0,
                  norm + square - 2 * ({' + '.join(f'z_{c} * m_{c}' for c in _MODEL)})) AS mean FROM pt, mid),
        ab AS (SELECT customer_id, max(CASE WHEN own = other THEN mean * n / greatest(n - 1, 1) END) AS a,
                 min(CASE WHEN own <> other THEN mean END) AS b, max(CASE WHEN own = other THEN n END) AS own_n
               FROM gap GROUP BY 1)
        SELECT round_even(avg(CASE WHEN own_n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6)
          AS silhouette FROM ab""",
    "kmeans_facts": f"""WITH {LINES_TPCH}{SCORED}{SCALED}
        SELECT count(*) AS customers, 5::BIGINT AS clusters, true AS halved FROM scaled""",
    "silhouette_sampled": f"""WITH {LINES_TPCH}{SCORED}{SCALED},
        pt AS (SELECT customer_id, segment, {', '.join('z_' + c for c in _MODEL)} FROM scaled),
        size AS (SELECT segment, count(*) AS n FROM pt GROUP BY 1),
        gap AS (SELECT p.customer_id, p.segment AS own, q.segment AS other,
                   sum(sqrt({' + '.join(f'(p.z_{c} - q.z_{c}) ** 2' for c in _MODEL)})) AS total
                 FROM pt p CROSS JOIN pt q GROUP BY 1, 2, 3),
        ab AS (SELECT customer_id, max(CASE WHEN own = other THEN total / greatest(n - 1, 1) END) AS a,
                 min(CASE WHEN own <> other THEN total / n END) AS b, max(CASE WHEN own = other THEN n END) AS own_n
               FROM gap JOIN size ON size.segment = gap.other GROUP BY 1)
        SELECT round_even(avg(CASE WHEN own_n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6)
          AS silhouette FROM ab""",
})

# --- history, campaigns, audience ----------------------------------------------------------------------------


def _suffixed(cte: str, names: list[str], suffix: str) -> str:
    """The same chain of CTEs under other names, for a second set of lines."""
    import re
    for name in names:
        cte = re.sub(rf"\b{name}\b", f"{name}_{suffix}", cte)
    return cte


_CHAIN = ["lines", "ord", "snap", "act", "ctry", "dist", "feat", "sc", "scored"]
_RATE = ("CASE segment WHEN 'Champions' THEN 0.25 WHEN 'Loyal' THEN 0.15 WHEN 'At-risk' THEN 0.08 "
         "WHEN 'New' THEN 0.20 WHEN 'Dormant' THEN 0.04 WHEN 'Prospects' THEN 0.12 ELSE 0.05 END::DOUBLE")


def _estimate(source: str) -> str:
    return f"""est AS (SELECT *, {_RATE} AS assumed_response_rate,
      CAST(round_even(customers * {_RATE}, 0) AS BIGINT) AS expected_responders,
      CAST(round_even(CAST(round_even(customers * {_RATE}, 0) AS BIGINT) * avg_order_value, 0) AS BIGINT)
        AS est_incremental_revenue FROM {source})"""


_BOOK_EN = """(VALUES
  ('Champions', 'Reward & upsell; protect the relationship', 'VIP early access + bundle', 'Email'),
  ('Loyal', 'Increase frequency; grow basket', 'Loyalty points 2x this month', 'Email'),
  ('At-risk', 'Win back before they churn', 'A 14-day comeback offer', 'Email+SMS'),
  ('New', 'Drive the crucial 2nd purchase', 'Free shipping on order #2', 'Email'),
  ('Dormant', 'Reactivate or let go cheaply', 'We miss you – a welcome-back gift', 'Email'),
  ('Prospects', 'Move high-potential shoppers up into Champions', 'An incentive for their next order', 'Email'))"""
_BOOK_CS = """(VALUES
  ('Champions', 'Odměnit a rozšířit nákup; udržet vztah', 'VIP přístup k novinkám + dárek', 'E-mail'),
  ('Loyal', 'Zvýšit frekvenci; větší košík', 'Dvojnásobné věrnostní body', 'E-mail'),
  ('At-risk', 'Získat zpět, než odejdou', 'Návratová nabídka na 14 dní', 'E-mail+SMS'),
  ('New', 'Podpořit klíčový druhý nákup', 'Doprava zdarma na druhou objednávku', 'E-mail'),
  ('Dormant', 'Reaktivovat, nebo levně opustit', 'Chybíte nám – dárek k návratu', 'E-mail'),
  ('Prospects', 'Posunout nadějné zákazníky mezi „Champions“', 'Pobídka k dalšímu nákupu', 'E-mail'))"""


def _cards(book: str, rationale: str, prospects: bool = True) -> str:
    extra = ("UNION ALL SELECT 'Prospects', 99, customers, avg_order_value FROM pstats"
             if prospects else "")
    return f""", audience_rows AS (SELECT segment, position, customers, avg_order_value FROM profile {extra}),
      {_estimate('audience_rows')},
      cards0 AS (SELECT est.*, objective, offer, channel, CAST(row_number() OVER
          (ORDER BY est_incremental_revenue DESC, position) AS INTEGER) AS place
        FROM est JOIN {book} AS book(segment, objective, offer, channel) USING (segment)),
      cards AS (SELECT place, segment, CASE WHEN segment = 'Prospects' THEN 'prospects' ELSE 'segment' END AS audience,
          CASE WHEN segment = 'Prospects' THEN 'Champions' ELSE '' END AS seed_segment, objective, channel, offer,
          offer AS headline, '{rationale}' AS rationale,
          CASE WHEN place <= 2 THEN 'high' WHEN place <= 4 THEN 'medium' ELSE 'low' END AS priority,
          'fallback' AS source, customers, assumed_response_rate, expected_responders, est_incremental_revenue
        FROM cards0)"""


CONTACT_LINES = LINES_TPCH_ALL + """,
lines AS (
  SELECT CASE WHEN CAST(customer_id AS BIGINT) % 5 = 0 THEN 'c' || customer_id || '@mail.example' ELSE customer_id END AS customer_id,
         order_id, order_date, units, quantity, product, country, is_product,
         CASE WHEN CAST(customer_id AS BIGINT) % 5 = 0 OR CAST(order_id AS BIGINT) % 3 <> 0 THEN ''
              ELSE ' u' || customer_id || '_' || (CAST(order_id AS BIGINT) % 4) || '@shop.example' END AS customer_email,
         CASE WHEN CAST(order_id AS BIGINT) % 2 = 0 THEN 'Name' || chr(13) || chr(10) || customer_name ELSE ' ' END AS customer_name
  FROM all_lines WHERE return_flag <> 'R')"""
CONTACTS = """,
mail AS (SELECT customer_id, arg_max(customer_email, (order_date, customer_email)) AS email FROM lines
         WHERE trim(customer_email) <> '' GROUP BY 1),
nm AS (SELECT customer_id, arg_max(customer_name, (order_date, customer_name)) AS name FROM lines
       WHERE trim(customer_name) <> '' GROUP BY 1),
contact AS (SELECT i.customer_id, coalesce(email, CASE WHEN regexp_full_match(i.customer_id,
              '[^@[:space:]]+@[^@[:space:]]+[.][^@[:space:]]+') THEN i.customer_id END, '') AS email, coalesce(name, '') AS name
            FROM (SELECT DISTINCT customer_id FROM lines) i LEFT JOIN mail USING (customer_id) LEFT JOIN nm USING (customer_id))"""
RECIPIENTS = CONTACTS + """,
rec AS (SELECT segment AS audience, customer_id,
          CASE WHEN trim(email) = '' AND contains(customer_id, '@') THEN customer_id ELSE trim(email) END AS email,
          trim(replace(replace(name, chr(13), ' '), chr(10), ' ')) AS name
        FROM scored JOIN contact USING (customer_id))"""
_ESTIMATES = """SELECT segment, customers, assumed_response_rate, expected_responders, est_incremental_revenue FROM est"""

ORACLE.update({
    "migration_between_runs": f"""WITH {LINES_TPCH_ALL},
        lines_p AS (SELECT * FROM all_lines WHERE return_flag <> 'R' AND order_date < TIMESTAMP '1997-08-01'),
        lines_c AS (SELECT * FROM all_lines WHERE return_flag <> 'R' AND order_date < TIMESTAMP '1999-01-01')
        {_suffixed(SCORED, _CHAIN, 'p')} {_suffixed(SCORED, _CHAIN, 'c')},
        both_ AS (SELECT coalesce(p.customer_id, c.customer_id) AS customer_id, p.segment AS b, c.segment AS a
                  FROM scored_p p FULL OUTER JOIN scored_c c USING (customer_id))
        SELECT CASE WHEN b IS NULL THEN 'entered' WHEN a IS NULL THEN 'left' ELSE 'moved' END AS change,
               CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE '' END AS "from",
               CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE '' END AS "to", count(*) AS customers
        FROM both_ WHERE a IS DISTINCT FROM b GROUP BY 1, 2, 3""",
    "segment_migration": f"""WITH {LINES_TPCH_ALL},
        lines_p AS (SELECT * FROM all_lines WHERE return_flag <> 'R' AND order_date < TIMESTAMP '1997-01-01'),
        lines_c AS (SELECT * FROM all_lines WHERE return_flag <> 'R' AND CAST(customer_id AS BIGINT) % 9 <> 0)
        {_suffixed(SCORED, _CHAIN, 'p')} {_suffixed(SCORED, _CHAIN, 'c')},
        both_ AS (SELECT coalesce(p.customer_id, c.customer_id) AS customer_id, p.segment AS b, c.segment AS a
                  FROM scored_p p FULL OUTER JOIN scored_c c USING (customer_id))
        SELECT CASE WHEN b IS NULL THEN 'entered' WHEN a IS NULL THEN 'left' ELSE 'moved' END AS change,
               CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE '' END AS "from",
               CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE '' END AS "to", count(*) AS customers
        FROM both_ WHERE a IS DISTINCT FROM b GROUP BY 1, 2, 3""",
    "campaign_estimates": f"WITH {LINES_TPCH}{PROFILE}, {_estimate('profile')} {_ESTIMATES}",
    "campaign_cards": f"WITH {LINES_TPCH}{PROFILE}{PSTATS}{_cards(_BOOK_EN, 'Rule-based default.')} SELECT * FROM cards",
    "campaign_cards_czech": f"WITH {LINES_TPCH}{PROFILE}{PSTATS}{_cards(_BOOK_CS, 'Pravidlové výchozí nastavení.')} SELECT * FROM cards",
    "owner_discounts": f"""WITH {LINES_TPCH}{PROFILE}{PSTATS}{_cards(_BOOK_EN, 'x')},
        given AS (SELECT * FROM (VALUES ('Champions', '15% off with code VIP15', 'percent', 'VIP15'),
                    ('Dormant', '£10 off', 'amount', NULL), ('New', 'Free shipping with code SHIP1', 'free_shipping', 'SHIP1'))
                  AS g(segment, said, discount_kind, discount_code))
        SELECT segment, coalesce(said, offer) AS offer, coalesce(said, headline) AS headline,
               CASE WHEN said IS NULL THEN source ELSE 'owner-discount' END AS source, discount_kind, discount_code
        FROM cards LEFT JOIN given USING (segment)""",
    "contacts": f"WITH {CONTACT_LINES}{CONTACTS} SELECT * FROM contact",
    "audience_files": f"WITH {CONTACT_LINES}{SCORED}{RECIPIENTS} SELECT * FROM rec",
    "csv_export": """SELECT c_custkey AS customer, list_extract(['''=', '''+', '''-', '''@', '', '"a, b" '], CAST(c_custkey % 6 + 1 AS INTEGER))
          || c_name AS name, c_mktsegment AS segment FROM customer""",
    "audience_export": f"WITH {CONTACT_LINES}{SCORED}{RECIPIENTS} SELECT * FROM rec",
    "mailings": f"""WITH {CONTACT_LINES}{PROFILE}{RECIPIENTS}{_cards(_BOOK_EN, 'x', prospects=False)}
        SELECT segment, channel, headline AS subject,
          'Hello,' || chr(10) || chr(10) || headline || chr(10) || chr(10) || 'Thank you for shopping with us.'
            || chr(10) || chr(10) || 'Your team' AS body_text,
          count(rec.customer_id) AS recipients, count(*) FILTER (WHERE rec.email <> '') AS deliverable
        FROM cards LEFT JOIN rec ON rec.audience = cards.segment GROUP BY 1, 2, 3, 4""",
    "customers_by_spend": f"""WITH {CONTACT_LINES}{SCORED}{CONTACTS}
        SELECT customer_id, segment, recency, frequency, monetary, email, name
        FROM scored JOIN contact USING (customer_id) ORDER BY monetary DESC, customer_id""",
    "currency_of_orders": """SELECT symbol, CASE WHEN symbol = 'Kč' THEN 'cs' ELSE 'en' END AS language, count(*) AS orders
        FROM (SELECT list_extract(['Kč', '€', '$', '£', 'CHF'], CAST(o_orderkey % 5 + 1 AS INTEGER)) AS symbol FROM orders)
        GROUP BY 1, 2""",
})


# Voucher phrases and bare codes, spelled without lookahead.
_CODE_LETTERS = "A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"
_C = f"[0-9{_CODE_LETTERS}-]"
_BARE = (f"\\\\b[{_CODE_LETTERS}](?:{_C}{{{{2,}}}}[0-9]{_C}*|{_C}[0-9]{_C}+|[0-9]{_C}{{{{2,}}}})\\\\b"
         .replace("{{", "{").replace("}}", "}").replace("\\\\", "\\"))
_PHRASE = (r"\s*(?:s\s+)?(?:kódem|kódu|kód|kupónem|kupón|voucher|coupon|(?:use\s+|with\s+)?code)"
           "\\s*[:\"''„]?\\s*[0-9_" + _CODE_LETTERS + "-]{3,}[\"“]?")
_DISCOUNT = (r"[0-9]+\s*%|(?:kč|czk|eur|€|\$|£)\s*[0-9]+|[0-9]+\s*(?:kč|czk|eur)\b|[0-9]+\s*[€$£]")

ORACLE["copy_audit"] = f"""
WITH t AS (SELECT doc_id, replace(text || ' Use code SAVE' || doc_id ||
             CASE WHEN doc_id % 3 = 0 THEN ' for 20 % off' ELSE ' today' END || ' or KEEP7 now', 'KEEP7', chr(57344)) AS copy
           FROM documents),
c AS (SELECT doc_id, replace(trim(regexp_replace(regexp_replace(regexp_replace(copy, '{_PHRASE}', '', 'gi'),
        '{_BARE}', '', 'g'), '\\s{{2,}}', ' ', 'g'), ' ,;:–-'), chr(57344), 'KEEP7') AS clean FROM t)
SELECT doc_id, md5(clean) AS clean_md5, CAST(length(clean) AS INTEGER) AS clean_length,
       regexp_matches(clean, '{_DISCOUNT}', 'i') AS promises_discount FROM c"""
