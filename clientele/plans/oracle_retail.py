"""DuckDB SQL for the retail queries: an independent statement of each
query's semantics, run on the same Parquet tables by the correctness check.

Conventions shared with the Spark side: money is DECIMAL until output,
then DOUBLE; other doubles are rounded to 6 places; percentages "to one
place" are rounded half-up on integers (``pct``).
"""
from __future__ import annotations

# Fixed values, restated here on purpose: a wrong constant in the plans must not pass on both sides.
HALF_YEAR_CUT = "1998-06-01 00:00:00"
SPEND_EDGES = [0, 100, 500, 1000, 3000, 5000, 10000, float("inf")]
SPEND_LABELS = ["<100", "100-500", "500-1K", "1K-3K", "3K-5K", "5K-10K", ">10K"]
FREQUENCY_EDGES = [0, 1, 2, 5, 10, 20, 50, float("inf")]
FREQUENCY_LABELS = ["1", "2", "3-5", "6-10", "11-20", "21-50", "50+"]
INTERVAL_EDGES = [0, 7, 14, 30, 60, 90, 180, float("inf")]
INTERVAL_LABELS = ["<7d", "7-14d", "14-30d", "30-60d", "60-90d", "90-180d", ">180d"]
SEGMENT_LABELS = {"Champions": "High-value champions", "Loyal": "Loyal customers", "Potential": "Potential loyalists",
                  "AtRisk": "At risk", "Lost": "Lost", "New": "New customers", "Average": "Average customers"}
SEGMENTS = list(SEGMENT_LABELS)
STAGES = ["New", "Active", "VIP", "Growing", "Normal", "AtRisk"]


def pct(num: str, den: str, places: int = 1) -> str:
    scale = 10 ** (places + 2)
    return (f"(floor((2 * ({num}) * {scale} + ({den})) / (2.0 * nullif({den}, 0))) / {float(10 ** places)})")


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


TX_RAW = """tx_raw AS (
  SELECT CASE WHEN l.l_returnflag = 'R' THEN 'C' || CAST(l.l_orderkey AS VARCHAR)
              ELSE CAST(l.l_orderkey AS VARCHAR) END AS invoice,
         CAST(l.l_partkey AS VARCHAR) AS stock_code, p.p_name AS description,
         CAST(trunc(l.l_quantity) AS INTEGER) AS quantity, o.o_orderdate AS invoice_date,
         CAST(p.p_retailprice AS DECIMAL(12,2)) AS price, o.o_custkey AS customer_id, n.n_name AS country
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

TX = TX_RAW + """,
tx AS (
  SELECT *, CAST(quantity AS DECIMAL(10,0)) * price AS revenue FROM tx_raw
  WHERE customer_id IS NOT NULL AND NOT coalesce(starts_with(invoice, 'C'), false)
    AND NOT (coalesce(quantity <= 0, false) OR coalesce(price <= 0, false)))"""

USERS = TX + """,
ord AS (
  SELECT customer_id, invoice, min(invoice_date) AS first_ts, max(invoice_date) AS last_ts,
         sum(quantity) AS q, sum(revenue) AS rev
  FROM tx GROUP BY customer_id, invoice),
users AS (
  SELECT customer_id, min(first_ts) AS first_purchase, max(last_ts) AS last_purchase, count(*) AS total_orders,
         CAST(sum(q) AS BIGINT) AS total_quantity, sum(rev) AS total_revenue
  FROM ord GROUP BY customer_id)"""

SEGMENT_CASE = """CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
       WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'Loyal'
       WHEN r_score >= 4 AND f_score <= 2 THEN 'Potential'
       WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'AtRisk'
       WHEN r_score <= 2 AND f_score <= 2 THEN 'Lost'
       WHEN r_score >= 3 AND f_score <= 2 AND m_score <= 2 THEN 'New'
       ELSE 'Average' END"""


def _qscore(rn: str) -> str:
    return f"CAST(greatest(1, coalesce(floor((4 * ({rn} - 1) + (n - 1) - 1) / nullif(n - 1, 0)), 1)) AS INTEGER)"


RFM = USERS + f""",
ref AS (SELECT max(last_purchase) AS as_of FROM users),
rfm AS (
  SELECT customer_id, last_purchase, date_sub('day', last_purchase, (SELECT as_of FROM ref)) AS recency,
         total_orders AS frequency, total_revenue AS monetary FROM users),
edges AS (
  SELECT quantile_cont(CAST(recency AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(recency AS DOUBLE), 0.5) AS q2,
         quantile_cont(CAST(recency AS DOUBLE), 0.75) AS q3 FROM rfm),
ranked AS (
  SELECT r.*, row_number() OVER (ORDER BY frequency, customer_id) AS rn_f,
         row_number() OVER (ORDER BY monetary, customer_id) AS rn_m, count(*) OVER () AS n FROM rfm r),
scores AS (
  SELECT customer_id, last_purchase, recency, frequency, monetary,
         CAST(CASE WHEN recency <= e.q1 THEN 4 WHEN recency <= e.q2 THEN 3 WHEN recency <= e.q3 THEN 2 ELSE 1 END
              AS INTEGER) AS r_score,
         {_qscore('rn_f')} AS f_score, {_qscore('rn_m')} AS m_score
  FROM ranked, edges e),
segs AS (
  SELECT *, r_score + f_score + m_score AS rfm_score, {SEGMENT_CASE} AS rfm_segment FROM scores)"""

MONTHLY = USERS + """,
um AS (
  SELECT strftime(invoice_date, '%Y-%m') AS ym, customer_id, count(DISTINCT invoice) AS orders,
         sum(revenue) AS rev FROM tx GROUP BY 1, 2),
mo AS (
  SELECT strftime(invoice_date, '%Y-%m') AS ym, count(DISTINCT customer_id) AS mau, sum(revenue) AS total_revenue,
         count(DISTINCT invoice) AS total_orders FROM tx GROUP BY 1),
nu AS (SELECT strftime(first_purchase, '%Y-%m') AS ym, count(*) AS new_users FROM users GROUP BY 1),
monthly AS (
  SELECT mo.ym AS year_month, mau, total_revenue, total_orders, CAST(coalesce(new_users, 0) AS BIGINT) AS new_users
  FROM mo LEFT JOIN nu ON mo.ym = nu.ym)"""

COHORT = TX + f""",
firsts AS (SELECT customer_id, min(invoice_date) AS f FROM tx GROUP BY customer_id),
active AS (SELECT DISTINCT customer_id, date_trunc('month', invoice_date) AS om FROM tx),
cc AS (
  SELECT strftime(f, '%Y-%m') AS cohort_month,
         CAST((year(om) - year(f)) * 12 + (month(om) - month(f)) AS INTEGER) AS period_index, count(*) AS users
  FROM active JOIN firsts USING (customer_id) GROUP BY 1, 2),
ret AS (
  SELECT c.cohort_month, c.period_index, c.users, s.users AS cohort_size, {pct('c.users', 's.users')} AS retention_rate
  FROM cc c JOIN (SELECT cohort_month, users FROM cc WHERE period_index = 0) s USING (cohort_month))"""


def _bands(value: str, edges, labels, source: str, where: str = "") -> str:
    conds = []
    for i in range(len(labels)):
        lo, hi = edges[i], edges[i + 1]
        c = f"{value} > {lo}" + ("" if hi == float("inf") else f" AND {value} <= {hi}")
        conds.append(f"WHEN {c} THEN {i + 1}")
    vals = ", ".join(f"({i + 1}, '{lbl}')" for i, lbl in enumerate(labels))
    return f"""b AS (SELECT CASE {' '.join(conds)} END AS band_ord FROM {source} {where}),
tot AS (SELECT count(*) AS n FROM b)
SELECT v.band_ord, v.band, count(b.band_ord) AS users, {pct('count(b.band_ord)', 'min(tot.n)')} AS pct
FROM (VALUES {vals}) v(band_ord, band) LEFT JOIN b ON b.band_ord = v.band_ord, tot
GROUP BY v.band_ord, v.band"""


def _column_type(position: int, column: str, declared: str, kind: str) -> str:
    """One row of ``dq_schema``; text columns (no ``kind``) are judged by the casts they survive."""
    if not kind:
        plain = f"regexp_full_match(trim({column}), '[-+0-9.eE]+')"
        kind_of = (f"CASE WHEN bool_and(regexp_full_match(trim({column}), '[-+]?[0-9]+')) THEN 'integer' "
                   f"WHEN bool_and({plain} AND TRY_CAST({column} AS DOUBLE) IS NOT NULL) THEN 'number' "
                   f"WHEN bool_and(TRY_CAST({column} AS TIMESTAMP) IS NOT NULL) THEN 'timestamp' ELSE 'text' END")
    else:
        kind_of = f"'{kind}'"
    return (f"SELECT CAST({position} AS INTEGER) AS position, '{column}' AS column_name, '{declared}' AS data_type, "
            f"CASE WHEN count({column}) > 0 THEN {kind_of} END AS value_type, count({column}) AS value_count FROM "
            f"(SELECT {column} FROM tx_raw)" + (f" WHERE {column} IS NOT NULL" if not kind else ""))


def _sql() -> dict[str, str]:
    seg_ord = "CASE rfm_segment " + " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(SEGMENTS)) + " END"
    seg_lbl = "CASE rfm_segment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_LABELS.items()) + \
        " ELSE rfm_segment END"
    user_cols = f"""customer_id, first_purchase, last_purchase, total_orders, total_quantity,
  CAST(total_revenue AS DOUBLE) AS total_revenue, {r6(div('total_revenue', 'total_orders'))} AS avg_order_value,
  date_sub('day', first_purchase, last_purchase) AS life_days"""
    interval = "(CAST(life_days AS DOUBLE) / CAST(total_orders - 1 AS DOUBLE))"
    multi = "(SELECT *, date_sub('day', first_purchase, last_purchase) AS life_days FROM users) u"
    cut = f"TIMESTAMP '{HALF_YEAR_CUT}'"
    stage_case = f"""CASE WHEN total_orders = 1 AND d <= 90 THEN 'New'
       WHEN total_orders >= 2 AND d <= 60 THEN CASE WHEN CAST(total_revenue AS DOUBLE) >= q70 THEN 'VIP' ELSE 'Active' END
       WHEN d > 180 THEN 'AtRisk' WHEN total_orders >= 2 AND d <= 180 THEN 'Growing' ELSE 'Normal' END"""
    stages = f"""st AS (
  SELECT customer_id, {stage_case} AS life_stage
  FROM (SELECT u.*, date_sub('day', last_purchase, (SELECT max(last_purchase) FROM users)) AS d,
               (SELECT quantile_cont(CAST(total_revenue AS DOUBLE), 0.7) FROM users) AS q70 FROM users u))"""
    null_parts = " UNION ALL ".join(
        f"SELECT {i + 1} AS position, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
        f"count(*) AS n FROM tx_raw"
        for i, c in enumerate(["invoice", "stock_code", "description", "quantity", "invoice_date", "price",
                               "customer_id", "country"]))
    scan = (f"WITH {TX_RAW} SELECT invoice, stock_code, description, quantity, invoice_date, "
            "CAST(price AS DOUBLE) AS price, customer_id, country FROM tx_raw")
    sqls = {
        "scan_transactions": scan,
        "csv_roundtrip": scan,
        "clean_transactions": f"WITH {TX} SELECT invoice, stock_code, description, quantity, invoice_date, "
                              "CAST(price AS DOUBLE) AS price, customer_id, country, CAST(revenue AS DOUBLE) AS revenue "
                              "FROM tx",
        "stream_clean_transactions": f"WITH {TX} SELECT invoice, stock_code, description, quantity, invoice_date, "
                                     "CAST(price AS DOUBLE) AS price, customer_id, country, "
                                     "CAST(revenue AS DOUBLE) AS revenue FROM tx",
        "date_parts": f"""WITH {TX} SELECT invoice, invoice_date, CAST(year(invoice_date) AS INTEGER) AS year,
  CAST(month(invoice_date) AS INTEGER) AS month, CAST(week(invoice_date) AS INTEGER) AS week,
  CAST(day(invoice_date) AS INTEGER) AS day, strftime(invoice_date, '%Y-%m') AS year_month FROM tx""",
        "dq_overview": f"""WITH {TX_RAW} SELECT count(*) AS row_count, CAST(8 AS BIGINT) AS column_count,
  count(DISTINCT customer_id) AS customers, count(DISTINCT stock_code) AS products, count(DISTINCT invoice) AS orders,
  count(DISTINCT country) AS countries, min(invoice_date) AS first_date, max(invoice_date) AS last_date FROM tx_raw""",
        "dq_schema": f"WITH {TX_RAW} " + " UNION ALL ".join(_column_type(i, *c) for i, c in enumerate([
            ("invoice", "string", ""), ("stock_code", "string", ""), ("description", "string", ""), ("quantity", "int", "integer"),
            ("invoice_date", "timestamp_ntz", "timestamp"), ("price", "decimal(12,2)", "number"), ("customer_id", "bigint", "integer"),
            ("country", "string", "")], 1)),
        "dq_nulls": f"""WITH {TX_RAW}, p AS ({null_parts})
SELECT position, column_name, null_count, {pct('null_count', 'n', 2)} AS null_pct FROM p""",
        "dq_rule_counts": f"""WITH {TX_RAW}, c AS (
  SELECT count(*) AS row_count, count(*) FILTER (WHERE customer_id IS NULL) AS missing_customer,
         count(*) FILTER (WHERE coalesce(starts_with(invoice, 'C'), false)) AS cancelled,
         count(*) FILTER (WHERE coalesce(quantity <= 0, false)) AS quantity_not_positive,
         count(*) FILTER (WHERE coalesce(price <= 0, false)) AS price_not_positive FROM tx_raw)
SELECT *, {pct('missing_customer', 'row_count', 1)} AS missing_customer_pct,
       {pct('cancelled', 'row_count', 2)} AS cancelled_pct FROM c""",
        "cleaning_waterfall": f"""WITH {TX_RAW}, r AS (
  SELECT count(*) AS raw_rows,
         count(*) FILTER (WHERE customer_id IS NULL) AS r1,
         count(*) FILTER (WHERE customer_id IS NOT NULL AND coalesce(starts_with(invoice, 'C'), false)) AS r2,
         count(*) FILTER (WHERE customer_id IS NOT NULL AND NOT coalesce(starts_with(invoice, 'C'), false)
                          AND (coalesce(quantity <= 0, false) OR coalesce(price <= 0, false))) AS r3
  FROM tx_raw),
s AS (
  SELECT 1 AS step, 'missing_customer' AS rule, raw_rows AS rows_in, r1 AS removed, raw_rows - r1 AS rows_out, raw_rows FROM r
  UNION ALL SELECT 2, 'cancelled', raw_rows - r1, r2, raw_rows - r1 - r2, raw_rows FROM r
  UNION ALL SELECT 3, 'invalid_quantity_or_price', raw_rows - r1 - r2, r3, raw_rows - r1 - r2 - r3, raw_rows FROM r)
SELECT step, rule, rows_in, removed, rows_out, {pct('rows_out', 'raw_rows', 1)} AS kept_pct_of_raw FROM s""",
        "sink_roundtrip": f"WITH {USERS} SELECT {user_cols} FROM users",
        "order_revenue": f"WITH {USERS} SELECT customer_id, invoice, CAST(rev AS DOUBLE) AS revenue FROM ord",
        "user_metrics": f"WITH {USERS} SELECT {user_cols} FROM users",
        "spend_bands": f"WITH {USERS}, " + _bands("total_revenue", SPEND_EDGES, SPEND_LABELS, "users"),
        "frequency_bands": f"WITH {USERS}, " + _bands("total_orders", FREQUENCY_EDGES, FREQUENCY_LABELS, "users"),
        "interval_bands": f"WITH {USERS}, " + _bands(interval, INTERVAL_EDGES, INTERVAL_LABELS, multi,
                                                     "WHERE total_orders >= 2"),
        "purchase_interval": f"""WITH {USERS} SELECT count(*) AS multi_order_users,
  {r6(f'quantile_cont({interval}, 0.5)')} AS median_interval_days FROM {multi} WHERE total_orders >= 2""",
        "spend_summary": f"""WITH {USERS} SELECT count(*) AS users, {r6(div('sum(total_revenue)', 'count(*)'))} AS mean_spend,
  {r6('quantile_cont(CAST(total_revenue AS DOUBLE), 0.5)')} AS median_spend,
  CAST(max(total_revenue) AS DOUBLE) AS max_spend FROM users""",
        "repeat_purchase": f"""WITH {USERS}, c AS (
  SELECT count(*) AS users, count(*) FILTER (WHERE total_orders > 1) AS repeat_users,
         count(*) FILTER (WHERE total_orders = 1) AS one_time_users,
         {r6(div('sum(total_orders)', 'count(*)'))} AS mean_orders,
         {r6('quantile_cont(CAST(total_orders AS DOUBLE), 0.5)')} AS median_orders FROM users)
SELECT users, repeat_users, one_time_users, {pct('repeat_users', 'users')} AS repeat_pct,
       {pct('one_time_users', 'users')} AS one_time_pct, mean_orders, median_orders FROM c""",
        "report_tiers": f"""WITH {USERS}, t AS (
  SELECT 'spend' AS tier_kind, 1 AS tier_ord, '<500' AS tier, count(*) FILTER (WHERE total_revenue < 500) AS users FROM users
  UNION ALL SELECT 'spend', 2, '500-3000', count(*) FILTER (WHERE total_revenue >= 500 AND total_revenue < 3000) FROM users
  UNION ALL SELECT 'spend', 3, '>=3000', count(*) FILTER (WHERE total_revenue >= 3000) FROM users
  UNION ALL SELECT 'orders', 1, '1', count(*) FILTER (WHERE total_orders = 1) FROM users
  UNION ALL SELECT 'orders', 2, '2-5', count(*) FILTER (WHERE total_orders >= 2 AND total_orders <= 5) FROM users
  UNION ALL SELECT 'orders', 3, '>=6', count(*) FILTER (WHERE total_orders >= 6) FROM users)
SELECT tier_kind, tier_ord, tier, users, {pct('users', '(SELECT count(*) FROM users)')} AS pct FROM t""",
        "ltv_histogram": f"""WITH {USERS},
r AS (SELECT min(CAST(total_revenue AS DOUBLE)) AS lo, max(CAST(total_revenue AS DOUBLE)) AS hi FROM users),
b AS (SELECT least(59, coalesce(CAST(floor((CAST(total_revenue AS DOUBLE) - lo) / nullif((hi - lo) / 60.0, 0)) AS INTEGER), 0)) AS bin
      FROM users, r),
c AS (SELECT bin, count(*) AS users FROM b GROUP BY bin)
SELECT CAST(g.range AS INTEGER) AS bin, {r6('lo + ((hi - lo) / 60.0) * g.range')} AS bin_start,
       {r6('lo + ((hi - lo) / 60.0) * (g.range + 1)')} AS bin_end, coalesce(c.users, 0) AS users
FROM range(60) g CROSS JOIN r LEFT JOIN c ON c.bin = g.range""",
        "monthly_user_stats": f"""WITH {MONTHLY} SELECT year_month, mau, CAST(total_revenue AS DOUBLE) AS total_revenue,
  total_orders, new_users FROM monthly""",
        "monthly_kpi_summary": f"""WITH {MONTHLY}
SELECT count(*) AS months, {r6(div('sum(mau)', 'count(*)'))} AS avg_mau, {r6(div('sum(new_users)', 'count(*)'))} AS avg_new_users,
  (SELECT year_month FROM monthly ORDER BY mau DESC, year_month LIMIT 1) AS peak_mau_month, max(mau) AS peak_mau,
  (SELECT year_month FROM monthly ORDER BY year_month DESC LIMIT 1 OFFSET 1) AS latest_complete_month,
  (SELECT mau FROM monthly ORDER BY year_month DESC LIMIT 1 OFFSET 1) AS latest_complete_mau
FROM monthly""",
        "best_worst_month": f"""WITH {MONTHLY}
SELECT (SELECT year_month FROM monthly ORDER BY new_users DESC, year_month LIMIT 1) AS max_new_month,
       max(new_users) AS max_new_users,
       (SELECT year_month FROM monthly ORDER BY new_users, year_month LIMIT 1) AS min_new_month,
       min(new_users) AS min_new_users FROM monthly""",
        "monthly_line_averages": f"""WITH {TX} SELECT strftime(invoice_date, '%Y-%m') AS year_month,
  {r6(div('sum(revenue)', 'count(*)'))} AS avg_line_revenue, {r6(div('sum(quantity)', 'count(*)'))} AS avg_line_quantity
FROM tx GROUP BY 1""",
        "monthly_repeat_rate": f"""WITH {MONTHLY}, p AS (
  SELECT ym, count(*) AS users, count(*) FILTER (WHERE orders >= 2) AS repeat_users FROM um GROUP BY ym)
SELECT ym AS year_month, users, repeat_users,
       CASE WHEN repeat_users > 0 THEN {r6(div('repeat_users', 'users') + ' * 100')} END AS repeat_rate FROM p""",
        "revenue_per_new_user": f"""WITH {MONTHLY} SELECT year_month, CAST(total_revenue AS DOUBLE) AS total_revenue, new_users,
  {r6(div('total_revenue', 'new_users'))} AS revenue_per_new_user FROM monthly""",
        "revenue_moving_avg": f"""WITH {MONTHLY} SELECT year_month, CAST(total_revenue AS DOUBLE) AS total_revenue,
  CASE WHEN count(*) OVER w = 2 THEN {r6(div('sum(total_revenue) OVER w', '2'))} END AS moving_avg
FROM monthly WINDOW w AS (ORDER BY year_month ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
        "revenue_mom": f"""WITH {MONTHLY}, m AS (
  SELECT year_month, total_revenue, CAST(substr(year_month, 1, 4) AS INTEGER) * 12 + CAST(substr(year_month, 6, 2) AS INTEGER) AS k
  FROM monthly)
SELECT a.year_month, CAST(a.total_revenue AS DOUBLE) AS total_revenue, CAST(b.total_revenue AS DOUBLE) AS prev_revenue,
  CASE WHEN b.total_revenue IS NULL OR b.total_revenue = 0 THEN 0.0
       ELSE {r6(div('a.total_revenue - b.total_revenue', 'b.total_revenue') + ' * 100')} END AS mom_pct
FROM m a LEFT JOIN m b ON b.k + 1 = a.k""",
        "rfm_scores": f"""WITH {RFM} SELECT customer_id, last_purchase, recency, frequency, CAST(monetary AS DOUBLE) AS monetary,
  r_score, f_score, m_score, r_score + f_score + m_score AS rfm_score FROM scores""",
        "rfm_segments": f"""WITH {RFM} SELECT customer_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary,
  r_score, f_score, m_score, rfm_score, rfm_segment FROM segs""",
        "segment_profile": f"""WITH {RFM}, t AS (SELECT count(*) AS n, sum(monetary) AS m FROM segs),
g AS (SELECT rfm_segment, count(*) AS users, {r6(div('sum(recency)', 'count(*)'))} AS avg_recency,
        {r6(div('sum(frequency)', 'count(*)'))} AS avg_frequency, {r6(div('sum(monetary)', 'count(*)'))} AS avg_monetary,
        sum(monetary) AS revenue FROM segs GROUP BY rfm_segment)
SELECT CAST({seg_ord} AS INTEGER) AS segment_ord, rfm_segment, users, {pct('users', 't.n')} AS user_pct,
  avg_recency, avg_frequency, avg_monetary, CAST(revenue AS DOUBLE) AS revenue,
  {r6(div('revenue', 't.m') + ' * 100')} AS revenue_pct FROM g, t""",
        "label_lookup": f"WITH {RFM} SELECT customer_id, rfm_segment, {seg_lbl} AS segment_label FROM segs",
        "rfm_summary": f"""WITH {RFM} SELECT {r6(div('sum(recency)', 'count(*)'))} AS mean_recency,
  {r6(div('sum(frequency)', 'count(*)'))} AS mean_frequency, {r6(div('sum(monetary)', 'count(*)'))} AS mean_monetary,
  {r6('quantile_cont(CAST(recency AS DOUBLE), 0.5)')} AS median_recency,
  {r6('quantile_cont(CAST(frequency AS DOUBLE), 0.5)')} AS median_frequency,
  {r6('quantile_cont(CAST(monetary AS DOUBLE), 0.5)')} AS median_monetary FROM rfm""",
        "rfm_score_distribution": f"""WITH {RFM}, l AS (
  SELECT 'R' AS score_name, r_score AS score FROM scores UNION ALL SELECT 'F', f_score FROM scores
  UNION ALL SELECT 'M', m_score FROM scores)
SELECT score_name, score, count(*) AS users FROM l GROUP BY 1, 2""",
        "risk_vs_safe_profile": f"""WITH {RFM} SELECT CASE WHEN rfm_segment IN ('AtRisk', 'Lost') THEN 'at_risk' ELSE 'other' END
  AS segment_group, count(*) AS users, {r6(div('sum(recency)', 'count(*)'))} AS avg_recency,
  {r6(div('sum(frequency)', 'count(*)'))} AS avg_frequency, {r6(div('sum(monetary)', 'count(*)'))} AS avg_monetary
FROM segs GROUP BY 1""",
        "recoverable_revenue": f"""WITH {RFM} SELECT count(*) FILTER (WHERE rfm_segment = 'AtRisk') AS at_risk_users,
  CAST(coalesce(sum(monetary) FILTER (WHERE rfm_segment = 'AtRisk'), 0) AS DOUBLE) AS at_risk_revenue,
  count(*) FILTER (WHERE rfm_segment IN ('AtRisk', 'Lost')) AS at_risk_or_lost_users,
  CAST(coalesce(sum(monetary) FILTER (WHERE rfm_segment IN ('AtRisk', 'Lost')), 0) AS DOUBLE) AS at_risk_or_lost_revenue
FROM segs""",
        "rfm_sample_points": f"""WITH {RFM} SELECT customer_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary,
  CAST(least(greatest(frequency * 2.5, 4), 35) AS DOUBLE) AS bubble_size
FROM rfm ORDER BY md5(CAST(customer_id AS VARCHAR) || '42') LIMIT 1200""",
        "rfm_standardized": f"""WITH {RFM}, s AS (
  SELECT avg(CAST(recency AS DOUBLE)) AS ar, stddev_pop(CAST(recency AS DOUBLE)) AS sr,
         avg(CAST(frequency AS DOUBLE)) AS af, stddev_pop(CAST(frequency AS DOUBLE)) AS sf,
         avg(CAST(monetary AS DOUBLE)) AS am, stddev_pop(CAST(monetary AS DOUBLE)) AS sm FROM rfm)
SELECT customer_id, {r6('(CAST(recency AS DOUBLE) - ar) / nullif(sr, 0)')} AS z_recency,
  {r6('(CAST(frequency AS DOUBLE) - af) / nullif(sf, 0)')} AS z_frequency,
  {r6('(CAST(monetary AS DOUBLE) - am) / nullif(sm, 0)')} AS z_monetary FROM rfm, s""",
        "lifecycle_stage": f"WITH {USERS}, {stages} SELECT customer_id, life_stage FROM st",
        "lifecycle_distribution": f"""WITH {USERS}, {stages}
SELECT v.stage_ord, v.life_stage, count(st.life_stage) AS users,
  {pct('count(st.life_stage)', '(SELECT count(*) FROM st)')} AS pct
FROM (VALUES {', '.join(f"({i + 1}, '{s}')" for i, s in enumerate(STAGES))}) v(stage_ord, life_stage)
LEFT JOIN st ON st.life_stage = v.life_stage GROUP BY 1, 2""",
        "purchase_funnel": f"""WITH {USERS}, c AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE total_orders >= 2) AS o2, count(*) FILTER (WHERE total_orders >= 3) AS o3,
         count(*) FILTER (WHERE total_orders >= 6) AS o6, count(*) FILTER (WHERE total_orders >= 10) AS o10,
         count(*) FILTER (WHERE CAST(total_revenue AS DOUBLE) >=
                          (SELECT quantile_cont(CAST(total_revenue AS DOUBLE), 0.8) FROM users)) AS q80 FROM users),
s AS (
  SELECT 1 AS stage_ord, 'first_purchase' AS stage, n AS users, n AS prev, n FROM c
  UNION ALL SELECT 2, 'orders_2_plus', o2, n, n FROM c UNION ALL SELECT 3, 'orders_3_plus', o3, o2, n FROM c
  UNION ALL SELECT 4, 'orders_6_plus', o6, o3, n FROM c UNION ALL SELECT 5, 'orders_10_plus', o10, o6, n FROM c
  UNION ALL SELECT 6, 'high_value_top20pct', CAST(n // 5 AS BIGINT), o10, n FROM c
  UNION ALL SELECT 7, 'high_value_q80', q80, o10, n FROM c)
SELECT stage_ord, stage, users, {pct('users', 'n')} AS pct_of_first, {pct('users', 'prev')} AS step_rate FROM s""",
        "pareto_curve": f"""WITH {USERS}, r AS (
  SELECT customer_id, row_number() OVER w AS user_rank, sum(total_revenue) OVER w AS cum,
         count(*) OVER () AS n, sum(total_revenue) OVER () AS tot
  FROM users WINDOW w AS (ORDER BY total_revenue DESC, customer_id ROWS UNBOUNDED PRECEDING))
SELECT customer_id, user_rank, {r6(div('user_rank', 'n') + ' * 100')} AS user_pct,
  {r6(div('cum', 'tot') + ' * 100')} AS cum_revenue_pct FROM r""",
        "top20_share": f"""WITH {USERS}, r AS (
  SELECT total_revenue, row_number() OVER (ORDER BY total_revenue DESC, customer_id) AS rk FROM users),
t AS (SELECT count(*) AS n, sum(total_revenue) AS tot FROM users)
SELECT n AS users, CAST(n // 5 AS BIGINT) AS top_users,
  CAST(coalesce((SELECT sum(total_revenue) FROM r WHERE rk <= n // 5), 0) AS DOUBLE) AS top_revenue,
  {r6(div('coalesce((SELECT sum(total_revenue) FROM r WHERE rk <= n // 5), 0)', 'tot') + ' * 100')} AS top_share_pct FROM t""",
        "half_year_migration": f"""WITH {TX}, f AS (
  SELECT customer_id, bool_or(invoice_date <= {cut}) AS h1, bool_or(invoice_date > {cut}) AS h2 FROM tx GROUP BY 1)
SELECT count(*) FILTER (WHERE h1) AS h1_users, count(*) FILTER (WHERE h2) AS h2_users,
  count(*) FILTER (WHERE h1 AND h2) AS retained, count(*) FILTER (WHERE NOT h1 AND h2) AS new_in_h2,
  count(*) FILTER (WHERE h1 AND NOT h2) AS lost_after_h1 FROM f""",
        "users_retained_intersect": f"""WITH {TX} SELECT customer_id FROM tx WHERE invoice_date <= {cut}
INTERSECT SELECT customer_id FROM tx WHERE invoice_date > {cut}""",
        "users_new_except": f"""WITH {TX} SELECT customer_id FROM tx WHERE invoice_date > {cut}
EXCEPT SELECT customer_id FROM tx WHERE invoice_date <= {cut}""",
        "kpi_summary": f"""WITH {RFM}, {MONTHLY.split(USERS + ',', 1)[1]}
SELECT (SELECT count(*) FROM users) AS users, (SELECT {r6(div('sum(mau)', 'count(*)'))} FROM monthly) AS avg_mau,
  (SELECT CAST(sum(revenue) AS DOUBLE) FROM tx) AS total_revenue,
  (SELECT {r6(div('sum(revenue)', 'count(*)'))} FROM tx) AS avg_line_revenue,
  {r6(div("(SELECT coalesce(sum(monetary) FILTER (WHERE rfm_segment = 'Champions'), 0) FROM segs)",
          '(SELECT sum(revenue) FROM tx)') + ' * 100')} AS champion_revenue_pct,
  (SELECT count(*) FILTER (WHERE rfm_segment IN ('AtRisk', 'Lost')) FROM segs) AS at_risk_users,
  (SELECT {r6(div('count(*) FILTER (WHERE total_orders > 1)', 'count(*)') + ' * 100')} FROM users) AS repeat_pct,
  (SELECT count(*) FILTER (WHERE date_sub('day', last_purchase, (SELECT as_of FROM ref)) <= 30) FROM users) AS active_30d""",
        "report_metrics": f"""WITH {RFM}, {MONTHLY[len(USERS) + 2:]}, {COHORT[len(TX) + 2:]},
top AS (SELECT total_revenue, row_number() OVER (ORDER BY total_revenue DESC, customer_id) AS rk FROM users),
m AS (
  SELECT 'data' AS section, 'raw_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM tx_raw
  UNION ALL SELECT 'data', 'clean_rows', count(*) FROM tx
  UNION ALL SELECT 'data', 'customers', count(DISTINCT customer_id) FROM tx
  UNION ALL SELECT 'data', 'products', count(DISTINCT stock_code) FROM tx
  UNION ALL SELECT 'data', 'countries', count(DISTINCT country) FROM tx
  UNION ALL SELECT 'data', 'revenue', CAST(sum(revenue) AS DOUBLE) FROM tx
  UNION ALL SELECT 'users', 'repeat_pct', {pct('count(*) FILTER (WHERE total_orders > 1)', 'count(*)')} FROM users
  UNION ALL SELECT 'users', 'mean_orders', {div('sum(total_orders)', 'count(*)')} FROM users
  UNION ALL SELECT 'users', 'mean_spend', {div('sum(total_revenue)', 'count(*)')} FROM users
  UNION ALL SELECT 'users', 'median_spend', quantile_cont(CAST(total_revenue AS DOUBLE), 0.5) FROM users
  UNION ALL SELECT 'users', 'top_share_pct',
    {div('coalesce((SELECT sum(total_revenue) FROM top WHERE rk <= (SELECT count(*) FROM users) // 5), 0)', '(SELECT sum(total_revenue) FROM users)')} * 100
  UNION ALL SELECT 'monthly', 'avg_mau', {div('sum(mau)', 'count(*)')} FROM monthly
  UNION ALL SELECT 'monthly', 'avg_new_users', {div('sum(new_users)', 'count(*)')} FROM monthly
  UNION ALL SELECT 'monthly', 'peak_mau', max(mau) FROM monthly
  UNION ALL SELECT 'monthly', 'latest_complete_mau', (SELECT mau FROM monthly ORDER BY year_month DESC LIMIT 1 OFFSET 1)
  UNION ALL SELECT 'monthly', 'max_new_users', max(new_users) FROM monthly
  UNION ALL SELECT 'monthly', 'min_new_users', min(new_users) FROM monthly
  UNION ALL SELECT 'rfm', 'champions_users', count(*) FILTER (WHERE rfm_segment = 'Champions') FROM segs
  UNION ALL SELECT 'rfm', 'champions_revenue_pct',
    {div("sum(monetary) FILTER (WHERE rfm_segment = 'Champions')", 'sum(monetary)')} * 100 FROM segs
  UNION ALL SELECT 'retention', 'month1_mean', {div('sum(retention_rate)', 'count(*)')} FROM ret
    WHERE period_index = 1 GROUP BY period_index
  UNION ALL SELECT 'retention', 'month1_zero_filled',
    {div('sum(retention_rate)', '(SELECT count(*) FROM ret WHERE period_index = 0)')} FROM ret
    WHERE period_index = 1 GROUP BY period_index)
SELECT section, metric, round(value, 6) AS value FROM m""",
        "country_users_top10": f"""WITH {TX}, c AS (SELECT country, count(DISTINCT customer_id) AS users FROM tx GROUP BY 1)
SELECT country, users, {pct('users', '(SELECT count(DISTINCT customer_id) FROM tx)')} AS pct
FROM c ORDER BY users DESC, country LIMIT 10""",
        "country_matrix": f"""WITH {TX} SELECT country, count(DISTINCT customer_id) AS users,
  {r6(div('sum(revenue)', 'count(*)'))} AS avg_line_revenue FROM tx GROUP BY 1 HAVING count(DISTINCT customer_id) >= 5""",
        "top_products": f"""WITH {TX} SELECT description, CAST(sum(revenue) AS DOUBLE) AS revenue FROM tx GROUP BY 1
ORDER BY sum(revenue) DESC, description LIMIT 10""",
        "weekday_hour_revenue": _weekday_hour(f"WITH {TX}, src AS (SELECT invoice_date AS ts, revenue AS amt FROM tx)"),
        "weekday_hour_event_value": _weekday_hour(
            "WITH src AS (SELECT ts, value AS amt FROM events WHERE event_type = 'purchase')"),
        "user_cohort": f"""WITH {TX} SELECT customer_id, strftime(min(invoice_date), '%Y-%m') AS cohort_month FROM tx GROUP BY 1""",
        "cohort_retention": f"WITH {COHORT} SELECT cohort_month, period_index, users, cohort_size, retention_rate FROM ret",
        "cohort_matrix": f"""WITH {COHORT} SELECT cohort_month, {", ".join(
            f'max(CASE WHEN period_index = {i} THEN retention_rate END) AS "{i}"' for i in range(80))}
  FROM ret GROUP BY cohort_month""",
        "cohort_unpivot": f"WITH {COHORT} SELECT cohort_month, period_index, retention_rate FROM ret",
        "retention_insight": f"""WITH {COHORT} SELECT period_index, count(*) AS cohorts,
  {r6(div('sum(retention_rate)', 'count(*)'))} AS mean_rate, max(retention_rate) AS best_rate,
  arg_min(cohort_month, (-retention_rate, cohort_month)) AS best_cohort, min(retention_rate) AS worst_rate,
  arg_min(cohort_month, (retention_rate, cohort_month)) AS worst_cohort
FROM ret WHERE period_index IN (1, 3) GROUP BY 1""",
        "retention_curve": f"""WITH {COHORT} SELECT period_index, count(*) AS cohorts,
  {r6(div('sum(retention_rate)', 'count(*)'))} AS avg_retention FROM ret WHERE period_index <= 12 GROUP BY 1""",
        "retention_zero_filled": f"""WITH {COHORT} SELECT period_index,
  {r6(div('sum(retention_rate)', '(SELECT count(*) FROM ret WHERE period_index = 0)'))} AS avg_retention_zero_filled
FROM ret WHERE period_index <= 12 GROUP BY 1""",
    }
    grouped = [("cleaning_waterfall", "cleaning", "rule", ["removed", "rows_out", "kept_pct_of_raw"]),
               ("segment_profile", "segments", "rfm_segment",
                ["users", "user_pct", "avg_recency", "avg_frequency", "avg_monetary", "revenue", "revenue_pct"]),
               ("purchase_funnel", "funnel", "stage", ["users", "pct_of_first", "step_rate"]),
               ("report_tiers", "tiers", "tier_kind || ' ' || tier", ["users", "pct"]),
               ("lifecycle_distribution", "stages", "life_stage", ["users", "pct"])]
    sqls["report_metrics"] = f"SELECT * FROM ({sqls['report_metrics']})" + "".join(
        f" UNION ALL SELECT '{section}', {name} || '.{v}', round(CAST({v} AS DOUBLE), 6) FROM ({sqls[key]})"
        for key, section, name, values in grouped for v in values)
    return sqls


def _weekday_hour(prefix: str) -> str:
    return f"""{prefix},
per AS (SELECT CAST(isodow(ts) AS INTEGER) AS weekday_ord, CAST(hour(ts) AS INTEGER) AS hour, sum(amt) AS amt
        FROM src GROUP BY 1, 2),
grid AS (SELECT CAST(d.range + 1 AS INTEGER) AS weekday_ord, CAST(h.range AS INTEGER) AS hour,
                dayname(DATE '2024-01-01' + CAST(d.range AS INTEGER)) AS weekday FROM range(7) d, range(24) h)
SELECT g.weekday_ord, g.weekday, g.hour, {r6('coalesce(CAST(per.amt AS DOUBLE), 0.0)')} AS revenue
FROM grid g LEFT JOIN per ON per.weekday_ord = g.weekday_ord AND per.hour = g.hour"""


ORACLE_SQL = _sql()
