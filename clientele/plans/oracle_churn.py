"""DuckDB SQL for the value-checked churn queries (same conventions as
``oracle_retail``)."""
from __future__ import annotations

from .oracle_retail import div, pct, r6

CHURN = """mx AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS cut FROM orders),
fo AS (SELECT o.*, o_orderdate <= (SELECT cut FROM mx) AS before FROM orders o),
per AS (
  SELECT o_custkey, min(o_orderdate) FILTER (WHERE before) AS f, max(o_orderdate) FILTER (WHERE before) AS l,
         count(*) FILTER (WHERE before) AS n_orders,
         sum(CAST(o_totalprice AS DECIMAL(14,2))) FILTER (WHERE before) AS spend, bool_or(NOT before) AS after
  FROM fo GROUP BY o_custkey),
pc AS (SELECT o_custkey, o_orderpriority, count(*) AS c FROM fo WHERE before GROUP BY 1, 2),
prio AS (
  SELECT o_custkey, o_orderpriority AS priority FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderpriority) AS k FROM pc) WHERE k = 1),
cust AS (
  SELECT c_custkey, c_acctbal, c_mktsegment, r_name FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
churn AS (
  SELECT p.o_custkey AS customer_id, date_sub('day', f, (SELECT cut FROM mx)) AS tenure_days, n_orders,
         CAST(spend AS DOUBLE) / CAST(n_orders AS DOUBLE) AS avg_order_value, CAST(spend AS DOUBLE) AS total_spend,
         date_sub('day', l, (SELECT cut FROM mx)) AS recency_days, c_acctbal AS account_balance,
         CASE WHEN n_orders >= 2 THEN CAST(date_sub('day', f, (SELECT cut FROM mx)) AS DOUBLE)
                                      / CAST(n_orders - 1 AS DOUBLE) END AS avg_days_between_orders,
         c_mktsegment AS segment, r_name AS region, priority,
         CASE WHEN c_acctbal < 0 THEN 'Yes' ELSE 'No' END AS negative_balance,
         CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'Yes' ELSE 'No' END AS high_priority,
         CASE WHEN after THEN 'No' ELSE 'Yes' END AS churn
  FROM per p LEFT JOIN prio USING (o_custkey) JOIN cust ON p.o_custkey = cust.c_custkey WHERE n_orders > 0),
lab AS (SELECT *, CAST(CASE churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INTEGER) AS label FROM churn),
scored AS (
  SELECT customer_id, label, CAST(recency_days AS DOUBLE) / CAST(max(recency_days) OVER () AS DOUBLE) AS score FROM lab),
tot AS (SELECT count(*) FILTER (WHERE label = 1) AS P, count(*) FILTER (WHERE label <> 1) AS N FROM scored),
perscore AS (
  SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
  FROM scored GROUP BY 1),
curve AS (
  SELECT threshold, pos, neg, CAST(row_number() OVER w AS BIGINT) AS step, CAST(sum(pos) OVER w AS BIGINT) AS tp,
         CAST(sum(neg) OVER w AS BIGINT) AS fp
  FROM perscore WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
cm AS (
  SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label <> 1) AS fp,
         count(*) FILTER (WHERE score < 0.5 AND label <> 1) AS tn, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn
  FROM scored)"""

NUMERIC_COLS = ["customer_id", "tenure_days", "n_orders", "avg_order_value", "total_spend", "recency_days",
                "account_balance", "avg_days_between_orders", "segment", "region", "priority", "negative_balance",
                "high_priority", "churn"]

# The TPC-H domains of the encoded categoricals.
LEVELS = {
    "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
    "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "negative_balance": ["No", "Yes"],
    "high_priority": ["No", "Yes"],
}


# The numeric features in the order of the feature vector.
NUMERIC_FEATURES = ["tenure_days", "n_orders", "avg_order_value", "total_spend", "recency_days", "account_balance",
                    "avg_days_between_orders"]


def _features() -> tuple[str, str]:
    """(list expression of the feature vector over ``lab``, list of the feature names)."""
    values, names = [], []
    for c in NUMERIC_FEATURES:
        x = f"CAST({c} AS DOUBLE)"
        if c == "avg_days_between_orders":
            x = f"coalesce({x}, (SELECT quantile_cont(avg_days_between_orders, 0.5) FROM churn))"
        values.append(x)
        names.append(c)
    for c, levels in LEVELS.items():
        for level in levels:
            values.append(f"CASE WHEN {c} = '{level}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
            names.append(f"{c}_{level}")
    return f"[{', '.join(values)}]", "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _smote(split: str) -> str:
    """Brute force: all pairs of minority rows, then the md5 draws."""
    vector, names = _features()
    hexa = lambda what, n: (f"CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '|' || CAST(t AS VARCHAR) || '|{what}|42'), 1, {n}) "  # noqa: E731
                            "AS BIGINT)")
    return f"""WITH {CHURN}, {split}, ft AS (SELECT customer_id, label, {vector} AS x FROM lab),
tr AS (SELECT ft.* FROM ft JOIN sp USING (customer_id) WHERE split = 'train'),
cl AS (SELECT label, count(*) AS c FROM tr GROUP BY label),
nn AS (SELECT min(c) AS m, max(c) AS mj, arg_min(label, (c, label)) AS minor FROM cl),
mi AS (SELECT customer_id, x, row_number() OVER (ORDER BY customer_id) AS pos FROM tr WHERE label = (SELECT minor FROM nn)),
nb AS (SELECT a.customer_id, b.x AS y, row_number() OVER (PARTITION BY a.customer_id ORDER BY sqrt(list_reduce(list_transform(
         list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda s, v: s + v)), b.customer_id) - 1 AS r
       FROM mi a JOIN mi b ON a.customer_id <> b.customer_id),
dr AS (SELECT customer_id, x, unnest(range(1, (mj - m) // m + CASE WHEN pos - 1 < (mj - m) % m THEN 2 ELSE 1 END)) AS t FROM mi, nn),
dw AS (SELECT *, {hexa('neighbour', 8)} % least(5, (SELECT m - 1 FROM nn)) AS r, CAST({hexa('gap', 13)} AS DOUBLE) / 4503599627370496.0 AS u FROM dr),
sy AS (SELECT 's' || dw.customer_id || '-' || t AS row_key, (SELECT minor FROM nn) AS label, true AS synthetic,
         list_transform(list_zip(x, y), lambda p: p[1] + u * (p[2] - p[1])) AS x
       FROM dw JOIN nb ON nb.customer_id = dw.customer_id AND nb.r = dw.r),
al AS (SELECT * FROM sy UNION ALL SELECT 'r' || customer_id, label, false, x FROM tr)
SELECT row_key, label, synthetic, unnest({names}) AS feature, round(unnest(x), 6) AS value FROM al"""


def _prf(tp, fp, fn):
    p = f"coalesce({div(tp, f'{tp} + {fp}')}, 0.0)"
    r = f"coalesce({div(tp, f'{tp} + {fn}')}, 0.0)"
    f = f"coalesce({div(f'2.0 * {p} * {r}', f'{p} + {r}')}, 0.0)"
    return p, r, f


def _sql() -> dict[str, str]:
    w = f"WITH {CHURN}"
    nulls = " UNION ALL ".join(
        f"SELECT {i + 1} AS position, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
        f"count(*) AS n FROM churn" for i, c in enumerate(NUMERIC_COLS))
    summ = " UNION ALL ".join(
        f"""SELECT {i + 1} AS position, '{c}' AS column_name, count({c}) AS count, {r6(f'avg({c})')} AS mean,
  {r6(f'stddev_samp({c})')} AS std, {r6(f'min({c})')} AS min, {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS p25,
  {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS p50, {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS p75,
  {r6(f'max({c})')} AS max FROM churn""" for i, c in enumerate(["tenure_days", "avg_order_value", "total_spend"]))
    dummies = ", ".join(f"""CASE WHEN {c} = '{lv}' THEN 1 ELSE 0 END AS "{c}_{lv}\""""
                        for c, lvs in LEVELS.items() for lv in lvs)
    rates = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS segment_value, count(*) AS customers, "
        f"{r6(div('sum(label)', 'count(*)'))} AS churn_rate FROM lab GROUP BY {d}"
        for d in ["segment", "region", "priority"])
    gaps = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {r6(div(f"sum(label) FILTER (WHERE {c} = 'No')", f"count(*) FILTER (WHERE {c} = 'No')"))} AS rate_no,
  {r6(div(f"sum(label) FILTER (WHERE {c} = 'Yes')", f"count(*) FILTER (WHERE {c} = 'Yes')"))} AS rate_yes FROM lab"""
        for c in ["negative_balance", "high_priority"])
    split = """sp AS (
  SELECT customer_id, label, CASE WHEN pos <= floor((400 * sz + 1000) / 2000.0) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT customer_id, label,
               row_number() OVER (PARTITION BY label ORDER BY md5(CAST(customer_id AS VARCHAR) || '42'), customer_id) AS pos,
               count(*) OVER (PARTITION BY label) AS sz FROM lab))"""
    # Rates are rounded to 6 places only at the end; the text has one place.
    exact_rates = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS v, {div('sum(label)', 'count(*)')} AS rate FROM lab GROUP BY {d}"
        for d in ["segment", "region", "priority"])
    insights = f"""{w}, er AS ({exact_rates}),
rk AS (SELECT dimension, arg_min(v, (-rate, v)) AS v, max(rate) AS rate FROM er GROUP BY dimension), gp AS ({gaps})
SELECT 'overall' AS section, 'all' AS name, 'churn_rate' AS item, {r6(div('sum(label)', 'count(*)'))} AS value, CAST(NULL AS VARCHAR) AS text FROM lab
UNION ALL SELECT 'highest_risk', dimension, 'segment', NULL, v FROM rk
UNION ALL SELECT 'highest_risk', dimension, 'churn_rate', round(rate, 6), printf('%.1f%%', rate * 100) FROM rk
UNION ALL SELECT 'service_gaps', feature, 'rate_no', rate_no, NULL FROM gp
UNION ALL SELECT 'service_gaps', feature, 'rate_yes', rate_yes, NULL FROM gp"""
    p1, rc1, f1 = _prf("tp", "fp", "fn")
    p0, rc0, f0 = _prf("tn", "fn", "fp")
    best = lambda obj, v: f"""SELECT '{obj}' AS objective, threshold, {r6(v)} AS score, {r6('precision')} AS precision,
  {r6('recall')} AS recall FROM pr ORDER BY {v} DESC, threshold ASC LIMIT 1"""  # noqa: E731
    pr = f"""pr AS (SELECT threshold, {div('tp', 'tp + fp')} AS precision, {div('tp', '(SELECT P FROM tot)')} AS recall FROM curve)"""
    return {
        "churn_customers": f"""{w} SELECT customer_id, tenure_days, n_orders, {r6('avg_order_value')} AS avg_order_value,
  {r6('total_spend')} AS total_spend, recency_days, {r6('account_balance')} AS account_balance,
  {r6('avg_days_between_orders')} AS avg_days_between_orders, segment, region, priority, negative_balance,
  high_priority, churn FROM churn""",
        "churn_label": f"{w} SELECT customer_id, churn, label FROM lab",
        "churn_nulls": f"""{w}, p AS ({nulls})
SELECT position, column_name, null_count, {pct('null_count', 'n', 2)} AS null_pct FROM p""",
        "class_distribution": f"""{w} SELECT churn, count(*) AS "count", {r6(div('count(*)', '(SELECT count(*) FROM churn WHERE churn IS NOT NULL)'))} AS share
FROM churn WHERE churn IS NOT NULL GROUP BY churn""",
        "label_quality_distribution": f"""SELECT quality, count(*) AS "count",
  {r6(div('count(*)', '(SELECT count(*) FROM labels WHERE quality IS NOT NULL)'))} AS share
FROM labels WHERE quality IS NOT NULL GROUP BY quality""",
        "numeric_summary": f"{w} {summ}",
        "impute_median": f"""{w} SELECT customer_id, {r6('coalesce(avg_days_between_orders, (SELECT quantile_cont(avg_days_between_orders, 0.5) FROM churn))')}
  AS avg_days_between_orders FROM churn""",
        "one_hot": f"{w} SELECT customer_id, {dummies} FROM churn",
        "churn_rate_by_segment": f"""{w} SELECT row_number() OVER (PARTITION BY dimension ORDER BY churn_rate DESC, segment_value) AS rank, *
  FROM ({rates})""",
        "highest_risk_segment": f"""{w}, r AS ({rates}) SELECT dimension, arg_min(segment_value, (-churn_rate, segment_value)) AS segment,
  max(churn_rate) AS churn_rate FROM r GROUP BY dimension""",
        "service_gap": f"{w} {gaps}",
        "churn_rate_overall": f"""{w} SELECT count(*) AS customers, CAST(sum(label) AS BIGINT) AS churners,
  {r6(div('sum(label)', 'count(*)'))} AS churn_rate FROM lab""",
        "stratified_split": f"{w}, {split} SELECT customer_id, label, split FROM sp",
        "stratified_folds": f"""{w}, {split} SELECT customer_id, label, CAST((pos - 1) % 5 AS INTEGER) AS fold FROM (
  SELECT customer_id, label,
         row_number() OVER (PARTITION BY label ORDER BY md5(CAST(customer_id AS VARCHAR) || '42'), customer_id) AS pos
  FROM sp WHERE split = 'train')""",
        "insights_json_roundtrip": insights,
        "insights_by_path": insights,
        "business_insights": insights,
        "churn_features": f"""{w}, {split} SELECT customer_id, sp.label, sp.split, unnest({_features()[1]}) AS feature,
  round(unnest({_features()[0]}), 6) AS value FROM lab JOIN sp USING (customer_id)""",
        "smote_oversample": _smote(split),
        "classification_metrics": f"""{w} SELECT 0.5 AS threshold, {r6(div('tp + tn', 'tp + fp + tn + fn'))} AS accuracy,
  (SELECT {r6(div('sum(pos * (2 * ((SELECT N FROM tot) - fp) + neg))', '2 * (SELECT P FROM tot) * (SELECT N FROM tot)'))} FROM curve) AS roc_auc,
  {r6(p1)} AS precision, {r6(rc1)} AS recall, {r6(f1)} AS f1,
  (SELECT {r6(f"sum({div('pos', '(SELECT P FROM tot)')} * {div('tp', 'tp + fp')})")} FROM curve) AS pr_auc FROM cm""",
        "confusion_matrix": f"""{w} SELECT 0 AS actual, 0 AS predicted, tn AS "count" FROM cm UNION ALL SELECT 0, 1, fp FROM cm
UNION ALL SELECT 1, 0, fn FROM cm UNION ALL SELECT 1, 1, tp FROM cm""",
        "roc_auc": f"""{w} SELECT {r6(div('sum(pos * (2 * ((SELECT N FROM tot) - fp) + neg))', '2 * (SELECT P FROM tot) * (SELECT N FROM tot)'))}
  AS roc_auc FROM curve""",
        "average_precision": f"""{w} SELECT {r6(f"coalesce(sum({div('pos', '(SELECT P FROM tot)')} * {div('tp', 'tp + fp')}), 0.0)")}
  AS average_precision FROM curve""",
        "roc_curve": f"""{w} SELECT {r6('threshold')} AS threshold, tp, fp, {r6(div('tp', '(SELECT P FROM tot)'))} AS tpr,
  {r6(div('fp', '(SELECT N FROM tot)'))} AS fpr FROM curve""",
        "pr_curve": f"""{w} SELECT {r6('threshold')} AS threshold, tp, fp, {r6(div('tp', 'tp + fp'))} AS precision,
  {r6(div('tp', '(SELECT P FROM tot)'))} AS recall FROM curve""",
        "best_threshold": f"""{w}, {pr} ({best('f1', '(2.0 * precision * recall) / (precision + recall + 1e-12)')})
UNION ALL ({best('recall', 'recall')})""",
        "classification_report": f"""{w} SELECT 1 AS row_ord, 'No Churn' AS label, {r6(p0)} AS precision, {r6(rc0)} AS recall,
  {r6(f0)} AS f1, tn + fp AS support FROM cm
UNION ALL SELECT 2, 'Churn', {r6(p1)}, {r6(rc1)}, {r6(f1)}, tp + fn FROM cm
UNION ALL SELECT 3, 'accuracy', NULL, NULL, {r6(div('tp + tn', 'tp + fp + tn + fn'))}, tp + fp + tn + fn FROM cm
UNION ALL SELECT 4, 'macro avg', {r6(f'({p0} + {p1}) / 2')}, {r6(f'({rc0} + {rc1}) / 2')}, {r6(f'({f0} + {f1}) / 2')},
  tp + fp + tn + fn FROM cm
UNION ALL SELECT 5, 'weighted avg', {r6(div(f'{p0} * (tn + fp) + {p1} * (tp + fn)', 'tp + fp + tn + fn'))},
  {r6(div(f'{rc0} * (tn + fp) + {rc1} * (tp + fn)', 'tp + fp + tn + fn'))},
  {r6(div(f'{f0} * (tn + fp) + {f1} * (tp + fn)', 'tp + fp + tn + fn'))}, tp + fp + tn + fn FROM cm""",
    }


ORACLE_SQL = _sql()
