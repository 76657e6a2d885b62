"""Plain SQL with the meaning of each query, for an independent engine."""

from __future__ import annotations

import re

from ledgerloom.constants import CHURN_FEATURES
from ledgerloom.plans.pins import (
    EXTRACT_BOUNDARY,
    FEATURE_SCALES,
    PINNED_CENTERS,
    PINNED_PURCHASES,
    PINNED_SPEND,
    PIVOT_MONTHS,
    RISK_MIDPOINT_DAYS,
    RISK_SCALE_DAYS,
    RULED_DEPTH,
    RULED_NODE,
    RULED_TREES,
    SCORED_CENTERS,
    SILHOUETTE_GRID,
)

# Shared definitions: name -> (body, names it needs).
_DEFS: dict[str, tuple[str, tuple[str, ...]]] = {}


def _define(name: str, body: str, *needs: str) -> None:
    _DEFS[name] = (body.strip(), needs)


def _sql(body: str, *needs: str) -> str:
    """``body`` behind the definitions it needs, each once and in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _DEFS[name][1]:
            visit(need)
        if name not in order:
            order.append(name)

    for need in needs:
        visit(need)
    head = ",\n".join(f"{name} AS (\n{_DEFS[name][0]}\n)" for name in order)
    recursive = any(re.search(rf"\b{name}\b", _DEFS[name][0]) for name in order)
    return f"WITH {'RECURSIVE ' * recursive}{head}\n{body.strip()}" if order else body.strip()


_IS_RETURN = "(l_returnflag = 'R')"
_INVOICE = f"CASE WHEN {_IS_RETURN} THEN 'C' ELSE '' END || CAST(o_orderkey AS VARCHAR)"

_define(
    "tx_clean",
    f"""
SELECT {_INVOICE} AS invoice, CAST(l_partkey AS VARCHAR) AS stock_code, l_quantity AS quantity,
       o_orderdate AS invoice_ts, l_extendedprice / l_quantity AS price, o_custkey AS customer_id,
       {_IS_RETURN} AS is_return
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
_define(
    "tx_dirty",
    f"""
SELECT {_INVOICE} AS invoice, CAST(l_partkey AS VARCHAR) AS stock_code,
       CASE WHEN {_IS_RETURN} THEN -l_quantity WHEN l_partkey % 97 = 0 THEN 0.0 ELSE l_quantity END AS quantity,
       o_orderdate AS invoice_ts,
       CASE WHEN l_partkey % 89 = 0 THEN 0.0 ELSE l_extendedprice / l_quantity END AS price,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS customer_id,
       {_IS_RETURN} AS is_return
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
_define(
    "tx_events",
    """
SELECT CAST(event_id AS VARCHAR) AS invoice, CAST(event_id AS VARCHAR) AS stock_code,
       CAST(1 AS DOUBLE) AS quantity, ts AS invoice_ts, value AS price, user_id AS customer_id,
       FALSE AS is_return
FROM events WHERE event_type = 'purchase'""",
)
for _v in ("clean", "dirty", "events"):
    _define(f"known_{_v}", f"SELECT * FROM tx_{_v} WHERE customer_id IS NOT NULL", f"tx_{_v}")
    _define(
        f"lines_{_v}",
        f"SELECT * FROM known_{_v} WHERE NOT is_return AND quantity > 0 AND price > 0",
        f"known_{_v}",
    )
    _define(
        f"caps_{_v}",
        f"""
SELECT quantile_cont(quantity, 0.01) AS q_lo, quantile_cont(quantity, 0.99) AS q_hi,
       quantile_cont(price, 0.01) AS p_lo, quantile_cont(price, 0.99) AS p_hi
FROM lines_{_v}""",
        f"lines_{_v}",
    )
    _define(
        f"sales_{_v}",
        f"""
SELECT invoice, stock_code, invoice_ts, customer_id, is_return,
       CASE WHEN quantity < q_lo THEN q_lo WHEN quantity > q_hi THEN q_hi ELSE quantity END AS quantity,
       CASE WHEN price < p_lo THEN p_lo WHEN price > p_hi THEN p_hi ELSE price END AS price,
       (CASE WHEN quantity < q_lo THEN q_lo WHEN quantity > q_hi THEN q_hi ELSE quantity END)
       * (CASE WHEN price < p_lo THEN p_lo WHEN price > p_hi THEN p_hi ELSE price END) AS amount
FROM lines_{_v}, caps_{_v}""",
        f"lines_{_v}",
        f"caps_{_v}",
    )
    _define(
        f"rates_{_v}",
        f"""
SELECT customer_id, COUNT(DISTINCT CASE WHEN is_return THEN invoice END) AS return_count,
       COUNT(DISTINCT invoice) AS total_invoices,
       COUNT(DISTINCT CASE WHEN is_return THEN invoice END) / COUNT(DISTINCT invoice) AS return_rate
FROM known_{_v} GROUP BY customer_id""",
        f"known_{_v}",
    )
    _define(f"as_of_{_v}", f"SELECT MAX(invoice_ts) + INTERVAL 2 DAY AS as_of FROM sales_{_v}", f"sales_{_v}")
    _define(
        f"rfm_{_v}",
        f"""
SELECT customer_id, date_sub('day', MAX(invoice_ts), (SELECT as_of FROM as_of_{_v})) AS recency,
       COUNT(DISTINCT invoice) AS frequency, SUM(amount) AS monetary
FROM sales_{_v} GROUP BY customer_id""",
        f"sales_{_v}",
        f"as_of_{_v}",
    )
    _define(
        f"daily_{_v}",
        f"""
SELECT customer_id, CAST(invoice_ts AS DATE) AS day, SUM(amount) AS spend,
       MIN(CAST(invoice_ts AS DATE)) OVER (PARTITION BY customer_id) AS first_day
FROM sales_{_v} GROUP BY customer_id, CAST(invoice_ts AS DATE)""",
        f"sales_{_v}",
    )
    _define(
        f"rfmt_{_v}",
        f"""
SELECT customer_id, COUNT(*) - 1 AS frequency,
       date_diff('day', MIN(day), MAX(day)) AS recency,
       date_diff('day', MIN(day), (SELECT MAX(CAST(invoice_ts AS DATE)) FROM sales_{_v})) AS T,
       COALESCE(AVG(CASE WHEN day > first_day THEN spend END), 0.0) AS monetary_value
FROM daily_{_v} GROUP BY customer_id""",
        f"sales_{_v}",
        f"daily_{_v}",
    )
    _define(
        f"ref_{_v}",
        f"SELECT MAX(invoice_ts) - INTERVAL 6 MONTH AS ref FROM lines_{_v}",
        f"lines_{_v}",
    )
    _define(f"obs_{_v}", f"SELECT s.*, ref FROM sales_{_v} s, ref_{_v} WHERE invoice_ts <= ref", f"sales_{_v}", f"ref_{_v}")
    _define(f"perf_{_v}", f"SELECT s.*, ref FROM sales_{_v} s, ref_{_v} WHERE invoice_ts > ref", f"sales_{_v}", f"ref_{_v}")
    _define(
        f"labels_{_v}",
        f"""
SELECT DISTINCT customer_id,
       CASE WHEN customer_id IN (SELECT customer_id FROM perf_{_v}) THEN 0 ELSE 1 END AS is_churn
FROM obs_{_v}""",
        f"obs_{_v}",
        f"perf_{_v}",
    )
    _define(
        f"feats_{_v}",
        f"""
SELECT customer_id, date_sub('day', MAX(invoice_ts), MAX(ref)) AS recency,
       COUNT(DISTINCT invoice) AS frequency, SUM(amount) AS monetary,
       date_sub('day', MIN(invoice_ts), MAX(invoice_ts)) AS timespan,
       date_sub('day', MIN(invoice_ts), MAX(invoice_ts)) / COUNT(DISTINCT invoice) AS avg_order_gap,
       COUNT(DISTINCT stock_code) AS unique_products
FROM obs_{_v} GROUP BY customer_id""",
        f"obs_{_v}",
    )
    _define(
        f"obs_rates_{_v}",
        f"""
SELECT customer_id,
       COUNT(DISTINCT CASE WHEN is_return THEN invoice END) / COUNT(DISTINCT invoice) AS return_rate
FROM known_{_v}, ref_{_v} WHERE invoice_ts <= ref GROUP BY customer_id""",
        f"known_{_v}",
        f"ref_{_v}",
    )
    _define(
        f"churn_{_v}",
        f"""
SELECT customer_id, recency, frequency, monetary, avg_order_gap, unique_products,
       COALESCE(return_rate, 0.0) AS return_rate, is_churn
FROM feats_{_v} JOIN labels_{_v} USING (customer_id) LEFT JOIN obs_rates_{_v} USING (customer_id)""",
        f"feats_{_v}",
        f"labels_{_v}",
        f"obs_rates_{_v}",
    )

_define(
    "logged",
    "SELECT *, ln(1 + recency) AS log_recency, ln(1 + frequency) AS log_frequency, ln(1 + monetary) AS log_monetary FROM rfm_clean",
    "rfm_clean",
)
_define(
    "scaled",
    """
SELECT logged.*, (log_recency - m1) / s1 AS z_recency, (log_frequency - m2) / s2 AS z_frequency,
       (log_monetary - m3) / s3 AS z_monetary
FROM logged, (SELECT AVG(log_recency) AS m1, STDDEV_POP(log_recency) AS s1, AVG(log_frequency) AS m2,
              STDDEV_POP(log_frequency) AS s2, AVG(log_monetary) AS m3, STDDEV_POP(log_monetary) AS s3
              FROM logged) moments""",
    "logged",
)


def _distance(center: tuple[float, ...], prefix: str = "") -> str:
    names = ("z_recency", "z_frequency", "z_monetary")
    return " + ".join(f"({prefix}{n} - ({v!r})) ** 2" for n, v in zip(names, center))


def _labels(source: str, centers: tuple[tuple[float, ...], ...], extra: str = "") -> str:
    options = "\n  UNION ALL ".join(
        f"SELECT customer_id, {i} AS cluster, {_distance(c)} AS d FROM {source}"
        for i, c in enumerate(centers)
    )
    return f"""
SELECT customer_id, {extra}cluster FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY d, cluster) AS place FROM (
  {options})) WHERE place = 1"""


_define("assigned", _labels("scaled", PINNED_CENTERS), "scaled")
_define("clustered", "SELECT * FROM rfm_clean JOIN assigned USING (customer_id)", "rfm_clean", "assigned")
_define(
    "labelled",
    " UNION ALL ".join(f"({_labels('scaled', c, f'{k} AS k, ')})" for k, c in SCORED_CENTERS.items()),
    "scaled",
)
_SCORES = """
SELECT k, AVG(CASE WHEN own_n = 1 OR own IS NULL OR other IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END) AS silhouette
FROM (
  SELECT k, customer_id, MAX(CASE WHEN own_cluster = cluster THEN n END) AS own_n,
         MAX(CASE WHEN own_cluster = cluster AND n > 1 THEN total / (n - 1) END) AS own,
         MIN(CASE WHEN own_cluster <> cluster THEN total / n END) AS other
  FROM (
    SELECT a.k, a.customer_id, a.cluster AS own_cluster, b.cluster, SUM(p.d) AS total, COUNT(*) AS n
    FROM (SELECT x.customer_id AS i, y.customer_id AS j,
                 sqrt((x.z_recency - y.z_recency) ** 2 + (x.z_frequency - y.z_frequency) ** 2
                      + (x.z_monetary - y.z_monetary) ** 2) AS d
          FROM scaled x, scaled y) p
    JOIN labelled a ON a.customer_id = p.i
    JOIN labelled b ON b.customer_id = p.j AND b.k = a.k
    GROUP BY a.k, a.customer_id, a.cluster, b.cluster)
  GROUP BY k, customer_id)
GROUP BY k"""
_define("scores", _SCORES, "scaled", "labelled")
_define(
    "gridded",
    f"""
SELECT customer_id, round_even(z_recency / {SILHOUETTE_GRID}, 0) * {SILHOUETTE_GRID} AS z_recency,
  round_even(z_frequency / {SILHOUETTE_GRID}, 0) * {SILHOUETTE_GRID} AS z_frequency,
  round_even(z_monetary / {SILHOUETTE_GRID}, 0) * {SILHOUETTE_GRID} AS z_monetary FROM scaled""",
    "scaled",
)
_define("grid_scores", _SCORES.replace("FROM scaled x, scaled y", "FROM gridded x, gridded y"), "gridded", "labelled")

_B, _G = PINNED_PURCHASES, PINNED_SPEND


def _expected(horizon: str, terms: int = 400) -> str:
    """Body giving (customer_id, frequency, recency, T, monetary_value, h, e) from the plain series."""
    A = f"({_B.r} + frequency)"
    B = f"({_B.b} + frequency)"
    C = f"({_B.a + _B.b - 1} + frequency)"
    age = f"({_B.alpha} + T)"
    z = f"(h / ({age} + h))"

    def signed_gamma_ratio(k: str) -> str:
        # C is positive here, so log-gamma is enough.
        return (
            f"exp(lgamma({A} + {k}) - lgamma({A}) + lgamma({B} + {k}) - lgamma({B})"
            f" - lgamma({C} + {k}) + lgamma({C}) - lgamma({k} + 1) + {k} * ln{z})"
        )

    return f"""
SELECT customer_id, frequency, recency, T, monetary_value, h,
       {C} / ({_B.a} - 1) * (1 - ({age} / ({age} + h)) ** {A} * SUM({signed_gamma_ratio('k')}))
       / (1 + CASE WHEN frequency > 0 THEN {_B.a} / ({_B.b} + frequency - 1)
                   * ({age} / ({_B.alpha} + recency)) ** {A} ELSE 0 END) AS e
FROM {{source}}, (SELECT CAST(unnest({horizon}) AS DOUBLE) AS h) horizons,
     (SELECT CAST(range AS DOUBLE) AS k FROM range(0, {terms})) series
GROUP BY customer_id, frequency, recency, T, monetary_value, h"""


for _v in ("clean", "events"):
    _define(f"expected_{_v}", _expected("[180]").format(source=f"rfmt_{_v}"), f"rfmt_{_v}")
_define("repeat", "SELECT * FROM rfmt_clean WHERE frequency > 0", "rfmt_clean")
_define("curve", _expected("[30, 60, 90, 120, 150, 180]").format(source="repeat"), "repeat")
_define(
    "flows",
    """
SELECT customer_id, SUM(gain / 1.01 ** (h / 30)) AS weighted
FROM (SELECT customer_id, h, e - LAG(e, 1, 0.0) OVER (PARTITION BY customer_id ORDER BY h) AS gain
      FROM curve) GROUP BY customer_id""",
    "curve",
)
_PROFIT = f"{_G.p} * ({_G.v} + frequency * monetary_value) / ({_G.p} * frequency + {_G.q} - 1)"
_define(
    "valued",
    f"""
SELECT customer_id, frequency, monetary_value, e AS expected_purchases_6m, {_PROFIT} AS expected_avg_profit,
       monetary_value * weighted AS clv_6m
FROM expected_clean JOIN flows USING (customer_id) WHERE frequency > 0""",
    "expected_clean",
    "flows",
)
_define(
    "rfm_clv",
    """
SELECT c.customer_id, c.recency, c.frequency, c.monetary, c.cluster, clv_6m, expected_purchases_6m, expected_avg_profit
FROM clustered c LEFT JOIN valued v ON c.customer_id = v.customer_id""",
    "clustered",
    "valued",
)

_define("dated", "SELECT *, CAST(date_trunc('month', invoice_ts) AS DATE) AS invoice_month FROM lines_clean", "lines_clean")
_define("first_month", "SELECT customer_id, MIN(invoice_month) AS cohort_month FROM dated GROUP BY customer_id", "dated")
_define(
    "cohorts",
    """
SELECT dated.*, cohort_month,
       CAST((year(invoice_month) - year(cohort_month)) * 12 + month(invoice_month) - month(cohort_month) AS INTEGER) AS cohort_index
FROM dated JOIN first_month USING (customer_id)""",
    "dated",
    "first_month",
)
_define(
    "cells",
    "SELECT cohort_month, cohort_index, COUNT(DISTINCT customer_id) AS n_customers FROM cohorts GROUP BY ALL",
    "cohorts",
)
_define(
    "retained",
    """
SELECT c.cohort_month, c.cohort_index, c.n_customers / z.n_customers * 100 AS retention_pct
FROM cells c JOIN cells z ON c.cohort_month = z.cohort_month AND z.cohort_index = 0""",
    "cells",
)
_define(
    "mature",
    """
SELECT * FROM retained
WHERE cohort_month <= (SELECT CAST(MAX(cohort_month) - INTERVAL 4 MONTH AS DATE) FROM retained)""",
    "retained",
)
_define(
    "averages",
    """
SELECT AVG(early) AS early_avg, AVG(late) AS late_avg FROM (
  SELECT position, AVG(CASE WHEN up <= 3 THEN retention_pct END) AS early,
         AVG(CASE WHEN down <= 3 THEN retention_pct END) AS late
  FROM mature
  JOIN (SELECT cohort_index, dense_rank() OVER (ORDER BY cohort_index) - 1 AS position
        FROM (SELECT DISTINCT cohort_index FROM retained)) USING (cohort_index)
  JOIN (SELECT cohort_month, row_number() OVER (ORDER BY cohort_month) AS up,
               row_number() OVER (ORDER BY cohort_month DESC) AS down
        FROM (SELECT DISTINCT cohort_month FROM mature)) USING (cohort_month)
  WHERE position BETWEEN 1 AND 3 GROUP BY position)""",
    "mature",
    "retained",
)

_define(
    "split",
    """
SELECT *, row_number() OVER (PARTITION BY is_churn ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42'))
          <= ceil(0.25 * COUNT(*) OVER (PARTITION BY is_churn)) AS is_test
FROM churn_clean""",
    "churn_clean",
)
_define(
    "scored",
    f"""
SELECT *, 1 / (1 + exp(-(recency - {RISK_MIDPOINT_DAYS}) / {RISK_SCALE_DAYS})) AS churn_probability
FROM split WHERE is_test""",
    "split",
)
_define(
    "medians",
    "SELECT quantile_cont(churn_probability, 0.5) AS median_p, quantile_cont(monetary, 0.5) AS median_m FROM scored",
    "scored",
)
_define(
    "segmented",
    """
SELECT customer_id, churn_probability, monetary, median_p, median_m,
       CASE WHEN monetary >= median_m AND churn_probability >= median_p THEN 'Top Priority Customer'
            WHEN monetary >= median_m THEN 'Loyal Customer'
            WHEN churn_probability >= median_p THEN 'Low Value Churner'
            ELSE 'Loyal Low Value Customer' END AS segment
FROM scored, medians""",
    "scored",
    "medians",
)

# The forest made by rule, walked node by node.
_SCALE = " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(FEATURE_SCALES))
_VALUE = " ".join(f"WHEN {i} THEN {name}" for i, name in enumerate(CHURN_FEATURES))
_define(
    "ruled_nodes",
    f"""
SELECT tree, node, {RULED_NODE["feature"]} AS feature, {RULED_NODE["gain"]} AS gain,
       CAST({RULED_NODE["share"]} AS DOUBLE) * CASE {RULED_NODE["feature"]} {_SCALE} END AS split,
       {RULED_NODE["n0"]} AS n0, {RULED_NODE["n1"]} AS n1
FROM range({RULED_TREES}) t(tree), range(1, {2 << RULED_DEPTH}) n(node)""",
)
_define(
    "ruled_walk",
    f"""
SELECT customer_id, tree, CAST(1 AS BIGINT) AS node FROM split, range({RULED_TREES}) t(tree)
UNION ALL
SELECT w.customer_id, w.tree, CASE WHEN CASE feature {_VALUE} END <= n.split THEN 2 * w.node ELSE 2 * w.node + 1 END
FROM ruled_walk w JOIN ruled_nodes n ON n.tree = w.tree AND n.node = w.node JOIN split s ON s.customer_id = w.customer_id
WHERE w.node < {1 << RULED_DEPTH}""",
    "split",
    "ruled_nodes",
)
_define(
    "ruled_chances",
    f"""
SELECT customer_id, AVG(n1 / (n0 + n1)) AS churn_probability FROM ruled_walk JOIN ruled_nodes USING (tree, node)
WHERE node >= {1 << RULED_DEPTH} GROUP BY customer_id""",
    "ruled_walk",
)
_define(
    "ruled_scored",
    "SELECT * FROM split JOIN ruled_chances USING (customer_id) WHERE is_test",
    "split",
    "ruled_chances",
)
_define("ruled_medians", _DEFS["medians"][0].replace("scored", "ruled_scored"), "ruled_scored")
_define(
    "ruled_segmented",
    _DEFS["segmented"][0].replace("FROM scored, medians", "FROM ruled_scored, ruled_medians"),
    "ruled_scored",
    "ruled_medians",
)
_define(
    "ruled_guessed",
    "SELECT is_churn, CASE WHEN churn_probability > 0.5 THEN 1 ELSE 0 END AS g FROM ruled_scored",
    "ruled_scored",
)

_CLASS_ROW = """
SELECT '{name}' AS label,
       COALESCE(SUM(CASE WHEN is_churn = {c} AND g = {c} THEN 1 END) / NULLIF(SUM(CASE WHEN g = {c} THEN 1 END), 0), 0) AS p,
       COALESCE(SUM(CASE WHEN is_churn = {c} AND g = {c} THEN 1 END) / NULLIF(SUM(CASE WHEN is_churn = {c} THEN 1 END), 0), 0) AS r,
       COALESCE(2 * SUM(CASE WHEN is_churn = {c} AND g = {c} THEN 1 END)
                / NULLIF(SUM(CASE WHEN g = {c} THEN 1 ELSE 0 END) + SUM(CASE WHEN is_churn = {c} THEN 1 ELSE 0 END), 0), 0) AS f,
       SUM(CASE WHEN is_churn = {c} THEN 1 ELSE 0 END) AS s
FROM guessed"""

_define("guessed", "SELECT is_churn, CASE WHEN churn_probability >= 0.5 THEN 1 ELSE 0 END AS g FROM scored", "scored")
_define(
    "classes",
    _CLASS_ROW.format(name="Active", c=0) + " UNION ALL " + _CLASS_ROW.format(name="Churned", c=1),
    "guessed",
)

_define("ruled_classes", _DEFS["classes"][0].replace("FROM guessed", "FROM ruled_guessed"), "ruled_guessed")

# The export with records that cannot be read.
_define(
    "tx_faults",
    """
SELECT *, o % 109 = 0 AS c FROM (
  SELECT *, s % 113 = 0 AS short, s % 101 = 0 AS q, s % 107 = 0 AS t, s % 103 = 0 AS p,
         CAST(replace(invoice, 'C', '') AS BIGINT) AS o
  FROM (SELECT *, CAST(stock_code AS BIGINT) AS s FROM tx_clean))""",
    "tx_clean",
)
_define(
    "tx_readable",
    """
SELECT invoice, stock_code, quantity, invoice_ts, price, CASE WHEN o % 50 <> 0 THEN customer_id END AS customer_id, is_return
FROM tx_faults WHERE NOT (short OR q OR t OR p OR c)""",
    "tx_faults",
)
_define(
    "readable_lines",
    "SELECT * FROM tx_readable WHERE customer_id IS NOT NULL AND NOT is_return AND quantity > 0 AND price > 0",
    "tx_readable",
)
_TX_PLAIN = "invoice, stock_code, quantity, invoice_ts, price, customer_id"

_CELLS = "ROUND(retention_pct, 6) AS retention_pct"
_RFM = "customer_id, recency, frequency, ROUND(monetary, 2) AS monetary"
_RFMT = "customer_id, frequency, recency, T, ROUND(monetary_value * 65536.0::DOUBLE) / 65536.0::DOUBLE AS monetary_value"
_TX = "invoice, stock_code, quantity, invoice_ts, price, customer_id, is_return"


def _purchase_ll(r: object, alpha: object, a: object, b: object) -> str:
    return f"""
         lgamma({r} + frequency) - lgamma({r}) + {r} * ln({alpha})
         + lgamma({a} + {b}) + lgamma({b} + frequency) - lgamma({b}) - lgamma({a} + {b} + frequency)
         + ln(({alpha} + T) ** -({r} + frequency)
              + CASE WHEN frequency > 0 THEN {a} / ({b} + frequency - 1)
                * ({alpha} + recency) ** -({r} + frequency) ELSE 0 END)"""


def _spend_ll(p: object, q: object, v: object) -> str:
    return f"""
         lgamma({p} * frequency + {q}) - lgamma({p} * frequency) - lgamma({q}) + {q} * ln({v})
         + ({p} * frequency - 1) * ln(monetary_value) + {p} * frequency * ln(frequency)
         - ({p} * frequency + {q}) * ln(frequency * monetary_value + {v})"""


def _differences(ll: str, at: dict[str, float], source: str) -> str:
    """Slope and curvature of the mean of ``ll`` from values on either side of ``at``."""
    columns = ", ".join(f"{v!r} + CASE WHEN parameter = '{n}' THEN side * h ELSE 0 END AS {n}" for n, v in at.items())
    names = ", ".join(f"('{n}', {3e-4 * v!r})" for n, v in at.items())
    return _sql(
        f"""
SELECT parameter, ROUND(SUM(side * f) / (2 * h), 4) AS slope,
       ROUND(SUM(CASE WHEN side = 0 THEN -2 ELSE 1 END * f) / (h * h), 3) AS curvature
FROM (SELECT parameter, side, h, AVG({ll}) AS f
      FROM {source}, (SELECT parameter, side, CAST(h AS DOUBLE) AS h, {columns}
                      FROM (VALUES {names}) p(parameter, h), (VALUES (-1), (0), (1)) s(side)) points
      GROUP BY parameter, side, h)
GROUP BY parameter, h""",
        source,
    )


def _caps(v: str) -> str:
    return _sql(
        f"""
SELECT 'quantity' AS column, ROUND(q_lo, 6) AS lo, ROUND(q_hi, 6) AS hi FROM caps_{v}
UNION ALL SELECT 'price', ROUND(p_lo, 6), ROUND(p_hi, 6) FROM caps_{v}""",
        f"caps_{v}",
    )


def _churn(v: str) -> str:
    return _sql(
        f"""
SELECT customer_id, recency, frequency, ROUND(monetary, 2) AS monetary, avg_order_gap, unique_products,
       return_rate, is_churn FROM churn_{v}""",
        f"churn_{v}",
    )


def _feature(name: str, places: int | None = None) -> str:
    value = name if places is None else f"ROUND({name}, {places})"
    return _sql(f"SELECT customer_id, {value} AS {name} FROM feats_clean", "feats_clean")


ORACLE_SQL: dict[str, str] = {
    "load_transactions": _sql(f"SELECT {_TX} FROM tx_clean", "tx_clean"),
    "union_extracts": _sql(
        f"""
SELECT {_TX} FROM tx_clean WHERE invoice_ts < TIMESTAMP '{EXTRACT_BOUNDARY}'
UNION ALL SELECT {_TX} FROM tx_clean WHERE invoice_ts >= TIMESTAMP '{EXTRACT_BOUNDARY}'""",
        "tx_clean",
    ),
    "row_accounting": _sql(
        """
SELECT 'raw' AS stage, COUNT(*) AS rows, 7 AS columns FROM tx_dirty
UNION ALL SELECT 'with_customer', COUNT(*), 7 FROM known_dirty
UNION ALL SELECT 'sales', COUNT(*), 8 FROM sales_dirty
UNION ALL SELECT 'observation', COUNT(*), 8 FROM obs_dirty
UNION ALL SELECT 'performance', COUNT(*), 8 FROM perf_dirty""",
        "tx_dirty", "known_dirty", "obs_dirty", "perf_dirty",
    ),
    "load_tolerant": _sql(f"SELECT {_TX_PLAIN} FROM tx_readable", "tx_readable"),
    "quarantine_counts": _sql(
        """
SELECT reason, CAST(SUM(n) AS BIGINT) AS rows FROM (
  SELECT unnest(['shape', 'quantity', 'invoice_ts', 'price', 'customer_id', 'any']) AS reason,
         unnest([short, NOT short AND q, NOT short AND t, NOT short AND p, NOT short AND c, short OR q OR t OR p OR c])::INT AS n
  FROM tx_faults) GROUP BY reason HAVING SUM(n) > 0""",
        "tx_faults",
    ),
    "row_accounting_tolerant": _sql(
        """
SELECT 'raw' AS stage, COUNT(*) AS rows, 7 AS columns FROM tx_readable
UNION ALL SELECT 'with_customer', COUNT(customer_id), 7 FROM tx_readable
UNION ALL SELECT 'sales', COUNT(*), 8 FROM readable_lines
UNION ALL SELECT 'observation', COUNT(*), 8 FROM readable_lines WHERE invoice_ts <= (SELECT MAX(invoice_ts) - INTERVAL 6 MONTH FROM readable_lines)
UNION ALL SELECT 'performance', COUNT(*), 8 FROM readable_lines WHERE invoice_ts > (SELECT MAX(invoice_ts) - INTERVAL 6 MONTH FROM readable_lines)
UNION ALL SELECT 'quarantined', COUNT(*), 7 FROM tx_faults WHERE short OR q OR t OR p OR c""",
        "tx_readable", "readable_lines", "tx_faults",
    ),
    "publish_outputs": _sql(
        """
SELECT 'rfm' AS table_name, COUNT(*) AS rows, ROUND(SUM(monetary), 1) AS total FROM rfm_clean
UNION ALL SELECT 'cohort_counts', COUNT(*), ROUND(CAST(SUM(n_customers) AS DOUBLE), 1) FROM cells
UNION ALL SELECT 'retention', COUNT(*), ROUND(SUM(retention_pct), 1) FROM retained""",
        "rfm_clean", "cells", "retained",
    ),
    "write_outputs": _sql(
        """
SELECT 'rfm' AS table_name, COUNT(*) AS rows, ROUND(SUM(monetary), 1) AS total FROM rfm_clean
UNION ALL SELECT 'rfm_scaled', COUNT(*), ROUND(SUM(ABS(z_recency)), 1) FROM scaled
UNION ALL SELECT 'rfmt', COUNT(*), CAST(SUM(T) AS DOUBLE) FROM rfmt_clean
UNION ALL SELECT 'cohort_counts', COUNT(*), CAST(SUM(n_customers) AS DOUBLE) FROM cells
UNION ALL SELECT 'retention', COUNT(*), ROUND(SUM(retention_pct), 1) FROM retained
UNION ALL SELECT 'retention_mature', COUNT(*), ROUND(SUM(retention_pct), 1) FROM mature
UNION ALL SELECT 'churn_features', COUNT(*), ROUND(SUM(monetary), 1) FROM churn_clean
UNION ALL SELECT 'elbow', 1, ROUND(COUNT(*) * (VAR_POP(z_recency) + VAR_POP(z_frequency) + VAR_POP(z_monetary)), 1) FROM scaled
UNION ALL SELECT 'silhouette', COUNT(*), ROUND(SUM(silhouette), 1) FROM scores
UNION ALL SELECT 'cluster_profile', COUNT(*), ROUND(SUM(m), 1) FROM (SELECT ROUND(AVG(recency), 2) AS m FROM clustered GROUP BY cluster)
UNION ALL SELECT 'segment_summary', COUNT(DISTINCT segment), CAST(COUNT(customer_id) AS DOUBLE) FROM segmented
UNION ALL SELECT 'quadrant_chart', COUNT(*), ROUND(SUM(CASE WHEN monetary > 0 THEN log10(monetary) END), 1) FROM segmented""",
        "rfm_clean", "rfmt_clean", "mature", "churn_clean", "scores", "clustered", "segmented",
    ),
    "drop_missing_customer": _sql(f"SELECT {_TX} FROM known_dirty", "known_dirty"),
    "flag_returns": _sql(
        """
SELECT invoice, stock_code, quantity, invoice_ts, price, customer_id, starts_with(invoice, 'C') AS is_return
FROM tx_dirty""",
        "tx_dirty",
    ),
    "drop_returns": _sql(f"SELECT {_TX} FROM tx_dirty WHERE invoice NOT LIKE 'C%'", "tx_dirty"),
    "positive_lines_nan": _sql(
        """
SELECT invoice, stock_code, quantity, invoice_ts, price, customer_id, is_return FROM tx_clean
WHERE quantity > 0 AND price > 0 AND CAST(stock_code AS BIGINT) % 53 <> 0 AND CAST(stock_code AS BIGINT) % 59 <> 0""",
        "tx_clean",
    ),
    "positive_lines": _sql(f"SELECT {_TX} FROM tx_dirty WHERE quantity > 0 AND price > 0", "tx_dirty"),
    "outlier_thresholds": _caps("clean"),
    "outlier_thresholds_dirty": _caps("dirty"),
    "outlier_thresholds_sketched": _sql(
        """
SELECT unnest(['quantity', 'price']) AS column, COUNT(*) AS n, TRUE AS lo_near, TRUE AS hi_near FROM lines_clean""",
        "lines_clean",
    ),
    "winsorize": _sql(
        """
SELECT invoice, stock_code, ROUND(quantity, 8) AS quantity, invoice_ts, ROUND(price, 8) AS price, customer_id, is_return
FROM sales_clean""",
        "sales_clean",
    ),
    "line_amount": _sql(
        "SELECT invoice, stock_code, customer_id, ROUND(amount, 4) AS amount FROM sales_clean", "sales_clean"
    ),
    "customer_return_rate": _sql("SELECT * FROM rates_clean", "rates_clean"),
    "customer_return_rate_dirty": _sql("SELECT * FROM rates_dirty", "rates_dirty"),
    "raw_snapshot": _sql(f"SELECT {_TX} FROM known_dirty", "known_dirty"),
    "analysis_date": _sql("SELECT as_of AS analysis_ts FROM as_of_clean", "as_of_clean"),
    "rfm": _sql(f"SELECT {_RFM} FROM rfm_clean", "rfm_clean"),
    "rfm_dirty": _sql(f"SELECT {_RFM} FROM rfm_dirty", "rfm_dirty"),
    "rfm_events": _sql(f"SELECT {_RFM} FROM rfm_events", "rfm_events"),
    "rfm_log": _sql(
        """
SELECT customer_id, ROUND(log_recency, 6) AS log_recency, ROUND(log_frequency, 6) AS log_frequency,
       ROUND(log_monetary, 6) AS log_monetary FROM logged""",
        "logged",
    ),
    "rfm_scaled": _sql(
        """
SELECT customer_id, ROUND(z_recency, 6) AS z_recency, ROUND(z_frequency, 6) AS z_frequency,
       ROUND(z_monetary, 6) AS z_monetary FROM scaled""",
        "scaled",
    ),
    "elbow_single_cluster": _sql(
        """
SELECT 1 AS k, ROUND(SUM((z_recency - m1) ** 2 + (z_frequency - m2) ** 2 + (z_monetary - m3) ** 2), 4) AS wcss
FROM scaled, (SELECT AVG(z_recency) AS m1, AVG(z_frequency) AS m2, AVG(z_monetary) AS m3 FROM scaled) means""",
        "scaled",
    ),
    "kmeans_step": _sql(
        """
SELECT k, cluster, COUNT(customer_id) AS n, ROUND(SUM(d), 3) AS wcss, ROUND(AVG(z_recency), 5) AS next_recency,
       ROUND(AVG(z_frequency), 5) AS next_frequency, ROUND(AVG(z_monetary), 5) AS next_monetary
FROM (SELECT k, cluster, customer_id, z_recency, z_frequency, z_monetary,
             (z_recency - (-1.5 + 3.0 * (cluster + 0.5) / k)) ** 2 + z_frequency ** 2 + z_monetary ** 2 AS d
      FROM labelled JOIN scaled USING (customer_id))
GROUP BY k, cluster""",
        "labelled",
        "scaled",
    ),
    "silhouette": _sql("SELECT k, ROUND(silhouette, 6) AS silhouette FROM scores", "scores"),
    "silhouette_grid": _sql("SELECT k, ROUND(silhouette, 6) AS silhouette FROM grid_scores", "grid_scores"),
    "silhouette_tree": _sql("SELECT k, ROUND(silhouette, 4) AS silhouette, TRUE AS near FROM scores", "scores"),
    "select_k": _sql("SELECT k AS best_k FROM scores ORDER BY silhouette DESC, k LIMIT 1", "scores"),
    "assign_clusters": _sql("SELECT customer_id, cluster FROM assigned", "assigned"),
    "cluster_profile": _sql(
        """
SELECT cluster, ROUND(AVG(recency), 2) AS recency_mean, ROUND(AVG(frequency), 2) AS frequency_mean,
       ROUND(AVG(monetary), 2) AS monetary_mean, COUNT(customer_id) AS n
FROM clustered GROUP BY cluster""",
        "clustered",
    ),
    "rfm_cluster_preview": _sql(f"SELECT {_RFM}, cluster FROM clustered ORDER BY customer_id LIMIT 10", "clustered"),
    "rfmt_summary": _sql(f"SELECT {_RFMT} FROM rfmt_clean", "rfmt_clean"),
    "rfmt_events": _sql(f"SELECT {_RFMT} FROM rfmt_events", "rfmt_events"),
    "bgnbd_loglik": _sql(
        f"SELECT COUNT(*) AS n, ROUND(SUM({_purchase_ll(_B.r, _B.alpha, _B.a, _B.b)}), 4) AS loglik FROM rfmt_clean",
        "rfmt_clean",
    ),
    "bgnbd_slopes": _differences(
        _purchase_ll("r", "alpha", "a", "b"), {"r": _B.r, "alpha": _B.alpha, "a": _B.a, "b": _B.b}, "rfmt_clean"
    ),
    "bgnbd_predict": _sql("SELECT customer_id, ROUND(e, 6) AS expected_purchases_6m FROM expected_clean", "expected_clean"),
    "bgnbd_predict_events": _sql(
        "SELECT customer_id, ROUND(e, 6) AS expected_purchases_6m FROM expected_events", "expected_events"
    ),
    "top_expected_purchases": _sql(
        f"SELECT {_RFMT}, ROUND(e, 4) AS expected_purchases_6m FROM expected_clean ORDER BY e DESC, customer_id LIMIT 10",
        "expected_clean",
    ),
    "repeat_customers": _sql(f"SELECT {_RFMT} FROM repeat", "repeat"),
    "gg_loglik": _sql(
        f"SELECT COUNT(*) AS n, ROUND(SUM({_spend_ll(_G.p, _G.q, _G.v)}), 2) AS loglik FROM repeat", "repeat"
    ),
    "gg_slopes": _differences(_spend_ll("p", "q", "v"), {"p": _G.p, "q": _G.q, "v": _G.v}, "repeat"),
    "gg_expected_profit": _sql(
        f"SELECT customer_id, ROUND({_PROFIT}, 2) AS expected_avg_profit FROM repeat", "repeat"
    ),
    "clv_discounted": _sql("SELECT customer_id, ROUND(clv_6m, 2) AS clv_6m FROM valued", "valued"),
    "clv_discounted_modelled_spend": _sql(
        f"""
SELECT customer_id, ROUND({_PROFIT} * weighted, 2) AS clv_6m
FROM repeat JOIN flows USING (customer_id)""",
        "repeat", "flows",
    ),
    "rfm_with_clv": _sql(
        f"""
SELECT {_RFM}, cluster, ROUND(clv_6m, 2) AS clv_6m, ROUND(expected_purchases_6m, 4) AS expected_purchases_6m,
       ROUND(expected_avg_profit, 2) AS expected_avg_profit FROM rfm_clv""",
        "rfm_clv",
    ),
    "top_clv": _sql(
        f"SELECT {_RFM}, cluster, ROUND(clv_6m, 2) AS clv_6m FROM rfm_clv ORDER BY rfm_clv.clv_6m DESC NULLS LAST, customer_id LIMIT 10",
        "rfm_clv",
    ),
    "clv_by_cluster": _sql(
        "SELECT cluster, ROUND(AVG(clv_6m), 2) AS avg_clv_6m FROM rfm_clv GROUP BY cluster", "rfm_clv"
    ),
    "invoice_month": _sql("SELECT invoice, stock_code, invoice_month FROM dated", "dated"),
    "cohort_month": _sql("SELECT customer_id, invoice, invoice_month, cohort_month FROM cohorts", "cohorts"),
    "cohort_index": _sql("SELECT customer_id, invoice, cohort_index FROM cohorts", "cohorts"),
    "cohort_counts": _sql("SELECT * FROM cells", "cells"),
    "cohort_pivot": _sql(
        "SELECT cohort_month, "
        + ", ".join(f"MAX(CASE WHEN cohort_index = {i} THEN n_customers END) AS m_{i}" for i in range(PIVOT_MONTHS))
        + " FROM cells GROUP BY cohort_month",
        "cells",
    ),
    "retention_pct": _sql(f"SELECT cohort_month, cohort_index, {_CELLS} FROM retained", "retained"),
    "mature_cohorts": _sql(f"SELECT cohort_month, cohort_index, {_CELLS} FROM mature", "mature"),
    "early_vs_late_retention": _sql(
        "SELECT ROUND(early_avg, 6) AS early_avg, ROUND(late_avg, 6) AS late_avg FROM averages", "averages"
    ),
    "retention_verdict": _sql(
        """
SELECT CASE WHEN late_avg > early_avg THEN 'improving' WHEN late_avg < early_avg THEN 'declining' ELSE 'stable' END AS verdict
FROM averages""",
        "averages",
    ),
    "retention_heatmap_data": _sql(
        f"SELECT cohort_month, cohort_index, {_CELLS} FROM mature ORDER BY cohort_month, cohort_index", "mature"
    ),
    "retention_preview": _sql(
        """
SELECT cohort_month, cohort_index, ROUND(retention_pct, 1) AS retention_pct FROM retained
WHERE cohort_month IN (SELECT DISTINCT cohort_month FROM retained ORDER BY cohort_month LIMIT 5)""",
        "retained",
    ),
    "reference_date": _sql("SELECT ref AS reference_ts FROM ref_clean", "ref_clean"),
    "window_split": _sql(
        """
SELECT 'observation' AS part, invoice, stock_code, customer_id, ROUND(amount, 4) AS amount FROM obs_clean
UNION ALL SELECT 'performance', invoice, stock_code, customer_id, ROUND(amount, 4) FROM perf_clean""",
        "obs_clean", "perf_clean",
    ),
    "eligible_customers": _sql("SELECT DISTINCT customer_id FROM obs_clean", "obs_clean"),
    "active_after": _sql(
        """
SELECT DISTINCT customer_id FROM perf_clean WHERE customer_id IN (SELECT customer_id FROM obs_clean)""",
        "obs_clean", "perf_clean",
    ),
    "churn_labels": _sql("SELECT customer_id, is_churn FROM labels_clean", "labels_clean"),
    "churn_distribution": _sql(
        "SELECT is_churn, COUNT(*) AS n FROM labels_clean GROUP BY is_churn ORDER BY n DESC, is_churn", "labels_clean"
    ),
    "feat_recency": _feature("recency"),
    "feat_frequency": _feature("frequency"),
    "feat_monetary": _feature("monetary", 2),
    "feat_timespan": _feature("timespan"),
    "feat_avg_order_gap": _feature("avg_order_gap"),
    "feat_unique_products": _feature("unique_products"),
    "feat_return_rate": _sql("SELECT customer_id, return_rate FROM obs_rates_clean", "obs_rates_clean"),
    "churn_features": _churn("clean"),
    "churn_features_dirty": _churn("dirty"),
    "stratified_split": _sql("SELECT customer_id, is_churn, is_test FROM split", "split"),
    "classification_report": _sql(
        """
SELECT label, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM classes
UNION ALL SELECT 'accuracy', NULL, NULL, ROUND(AVG(CASE WHEN is_churn = g THEN 1.0 ELSE 0.0 END), 6), COUNT(*) FROM guessed
UNION ALL SELECT 'macro avg', ROUND(AVG(p), 6), ROUND(AVG(r), 6), ROUND(AVG(f), 6), CAST(SUM(s) AS BIGINT) FROM classes
UNION ALL SELECT 'weighted avg', ROUND(SUM(p * s) / SUM(s), 6), ROUND(SUM(r * s) / SUM(s), 6),
                 ROUND(SUM(f * s) / SUM(s), 6), CAST(SUM(s) AS BIGINT) FROM classes""",
        "classes", "guessed",
    ),
    "rf_classification_report_pinned": _sql(
        """
SELECT label, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM ruled_classes
UNION ALL SELECT 'accuracy', NULL, NULL, ROUND(AVG(CASE WHEN is_churn = g THEN 1.0 ELSE 0.0 END), 6), COUNT(*) FROM ruled_guessed
UNION ALL SELECT 'macro avg', ROUND(AVG(p), 6), ROUND(AVG(r), 6), ROUND(AVG(f), 6), CAST(SUM(s) AS BIGINT) FROM ruled_classes
UNION ALL SELECT 'weighted avg', ROUND(SUM(p * s) / SUM(s), 6), ROUND(SUM(r * s) / SUM(s), 6),
                 ROUND(SUM(f * s) / SUM(s), 6), CAST(SUM(s) AS BIGINT) FROM ruled_classes""",
        "ruled_classes", "ruled_guessed",
    ),
    "rf_predict_pinned": _sql(
        "SELECT customer_id, is_churn, CAST(churn_probability > 0.5 AS INTEGER) AS prediction FROM ruled_scored", "ruled_scored"
    ),
    "churn_probability_pinned": _sql(
        """
SELECT customer_id, is_test, ROUND(churn_probability, 6) AS churn_probability FROM split JOIN ruled_chances USING (customer_id)""",
        "split", "ruled_chances",
    ),
    "feature_importance_pinned": _sql(
        f"""
SELECT feature, ROUND(COALESCE(SUM(share) / SUM(SUM(share)) OVER (), 0), 6) AS importance
FROM (SELECT tree, CASE feature {" ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(CHURN_FEATURES))} END AS feature,
             CAST(gain AS DOUBLE) * (n0 + n1) / SUM(CAST(gain AS DOUBLE) * (n0 + n1)) OVER (PARTITION BY tree) AS share
      FROM ruled_nodes WHERE node < {1 << RULED_DEPTH})
GROUP BY feature""",
        "ruled_nodes",
    ),
    "action_summary_pinned": _sql(
        """
SELECT segment, COUNT(customer_id) AS customer_count, ROUND(AVG(churn_probability), 2) AS avg_churn_prob,
       ROUND(AVG(monetary), 2) AS avg_monetary, ROUND(SUM(monetary), 2) AS total_monetary
FROM ruled_segmented GROUP BY segment""",
        "ruled_segmented",
    ),
    "action_matrix": _sql(
        "SELECT customer_id, ROUND(churn_probability, 6) AS churn_probability, ROUND(monetary, 2) AS monetary FROM scored",
        "scored",
    ),
    "rf_scored_rows": _sql("SELECT customer_id, is_churn FROM split WHERE is_test", "split"),
    "action_medians": _sql("SELECT ROUND(median_p, 6) AS median_p, ROUND(median_m, 2) AS median_m FROM medians", "medians"),
    "assign_segment": _sql("SELECT customer_id, segment FROM segmented", "segmented"),
    "segment_summary": _sql(
        """
SELECT segment, COUNT(customer_id) AS customer_count, ROUND(AVG(churn_probability), 2) AS avg_churn_prob,
       ROUND(AVG(monetary), 2) AS avg_monetary, ROUND(SUM(monetary), 2) AS total_monetary
FROM segmented GROUP BY segment""",
        "segmented",
    ),
    "revenue_at_risk": _sql(
        """
SELECT ROUND(COALESCE(SUM(monetary), 0), 2) AS revenue_at_risk FROM segmented WHERE segment = 'Top Priority Customer'""",
        "segmented",
    ),
    "quadrant_chart_data": _sql(
        """
SELECT customer_id, ROUND(churn_probability, 6) AS churn_probability, ROUND(monetary, 2) AS monetary, segment,
       ROUND(log10(monetary), 6) AS log_monetary, ROUND(median_p, 6) AS median_probability, ROUND(median_m, 2) AS median_monetary
FROM segmented""",
        "segmented",
    ),
}
