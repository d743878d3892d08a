"""One SQL text per registered query, assembled from shared common table expressions.

The text starts from the flat form of the events and never touches the Spark code; ranks use one plain window, which is
what the Spark side must reproduce without one.
"""

from __future__ import annotations

import hashlib
from math import exp, factorial

ATTRIBUTES = ["traffic_source", "traffic_medium", "device_category", "operating_system", "country"]
FEATURES = ["day_of_week", "is_weekend"] + ATTRIBUTES
COUNTERS = {
    "page_views": "page_view", "product_views": "view_item", "add_to_cart_events": "add_to_cart",
    "checkout_events": "begin_checkout", "shipping_events": "add_shipping_info", "payment_events": "add_payment_info",
    "purchase_events": "purchase",
}
FLAGS = {
    "viewed_product": "view_item", "added_to_cart": "add_to_cart", "began_checkout": "begin_checkout",
    "added_shipping_info": "add_shipping_info", "added_payment_info": "add_payment_info", "converted": "purchase",
}
EARLY_COUNTERS = {
    "early_page_views": "page_view", "early_product_views": "view_item", "early_searches": "view_search_results",
    "early_scrolls": "scroll", "early_promotion_views": "view_promotion", "early_add_to_cart": "add_to_cart",
}
STAGES = {
    "Visit": None, "Product View": "viewed_product", "Add to Cart": "added_to_cart", "Begin Checkout": "began_checkout",
    "Payment Info": "added_payment_info", "Purchase": "converted",
}
TRANSITIONS = ["Visit → Product View", "Product View → Add to Cart", "Add to Cart → Begin Checkout",
               "Begin Checkout → Payment", "Payment → Purchase"]
SESSION_COLUMNS = (
    ["session_id", "user_pseudo_id", "ga_session_id", "session_date", "day_of_week", "is_weekend"] + ATTRIBUTES
    + ["total_events", "distinct_event_types"] + list(COUNTERS) + list(FLAGS)
    + ["transaction_count", "revenue", "session_duration_seconds", "engagement_time_seconds"])
START_WORDS = "page|product|cart|checkout|shipping|payment|purchase|revenue|transaction|duration|engagement|event"
CUTOFF = "DATE '2024-01-22'"

NESTED = """
raw AS (
  SELECT e.*, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, c_mktsegment, n_name
  FROM events e LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey
), flat_all AS (
  SELECT CAST(user_id AS VARCHAR) AS user_pseudo_id,
    CASE WHEN k <> 99 THEN CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) END AS ga_session_id,
    CASE WHEN k % 2 = 0 THEN CAST(k * 100 AS BIGINT) END AS engagement_time_msec,
    strftime(ts, '%Y%m%d') AS event_date, epoch_us(ts) AS event_timestamp, event_id,
    CASE event_type
      WHEN 'click' THEN CASE WHEN k < 50 THEN 'page_view' WHEN k < 70 THEN 'scroll'
                             WHEN k < 85 THEN 'view_search_results' ELSE 'view_promotion' END
      WHEN 'view' THEN 'view_item'
      WHEN 'signup' THEN CASE WHEN k < 60 THEN 'add_to_cart' WHEN k < 95 THEN 'session_start' ELSE 'refund' END
      WHEN 'error' THEN CASE WHEN k < 50 THEN 'begin_checkout' WHEN k < 75 THEN 'add_shipping_info'
                             ELSE 'add_payment_info' END
      WHEN 'purchase' THEN CASE WHEN k < 25 THEN 'purchase' ELSE 'page_view' END END AS event_name,
    CASE WHEN k >= 3 THEN c_mktsegment END AS traffic_source,
    CASE k % 4 WHEN 0 THEN 'organic' WHEN 1 THEN 'cpc' WHEN 2 THEN 'referral' END AS traffic_medium,
    CASE k % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device_category,
    CASE WHEN k % 5 <> 4 THEN 'OS_' || (k % 5) END AS operating_system,
    n_name AS country,
    'T' || (event_id % 7) AS transaction_id,
    CASE WHEN k % 10 <> 0 THEN value END AS purchase_revenue
  FROM raw
), flat AS (SELECT * FROM flat_all WHERE ga_session_id IS NOT NULL)"""


def _first(column: str) -> str:
    return f"arg_min({column}, (event_timestamp, event_id)) FILTER (WHERE {column} IS NOT NULL)"


def _count(event: str) -> str:
    return f"CAST(count(*) FILTER (WHERE event_name = '{event}') AS BIGINT)"


SESSIONS = NESTED + f""", grouped AS (
  SELECT user_pseudo_id || '-' || ga_session_id AS session_id, user_pseudo_id, ga_session_id,
    CAST(strptime(min(event_date), '%Y%m%d') AS DATE) AS session_date,
    {', '.join(f"coalesce({_first(a)}, '<MISSING>') AS {a}" for a in ATTRIBUTES)},
    count(*) AS total_events, count(DISTINCT event_name) AS distinct_event_types,
    {', '.join(f"{_count(e)} AS {c}" for c, e in COUNTERS.items())},
    {', '.join(f"CAST(max(CASE WHEN event_name = '{e}' THEN 1 ELSE 0 END) AS INTEGER) AS {c}" for c, e in FLAGS.items())},
    count(DISTINCT CASE WHEN event_name = 'purchase' THEN transaction_id END) AS transaction_count,
    sum(CASE WHEN event_name = 'purchase' THEN coalesce(purchase_revenue, 0) ELSE 0 END) AS revenue,
    (max(event_timestamp) - min(event_timestamp)) / CAST(1000000 AS DOUBLE) AS session_duration_seconds,
    CAST(sum(coalesce(engagement_time_msec, 0)) AS DOUBLE) / 1000 AS engagement_time_seconds
  FROM flat GROUP BY user_pseudo_id, ga_session_id
), sessions AS (
  SELECT *, CAST(dayofweek(session_date) + 1 AS INTEGER) AS day_of_week,
    CASE WHEN dayofweek(session_date) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend
  FROM grouped)"""

FEATURE_ROWS = SESSIONS + f""", features AS (
  SELECT session_id, session_date, converted, {', '.join(FEATURES)} FROM sessions
), train AS (SELECT * FROM features WHERE session_date < {CUTOFF}),
test AS (SELECT * FROM features WHERE session_date >= {CUTOFF})"""


def _unpivot(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT session_id, converted, '{f}' AS col, CAST({f} AS VARCHAR) AS val FROM {table}" for f in FEATURES)


def _nb(alpha: int) -> str:
    return FEATURE_ROWS + f""", train_long AS ({_unpivot('train')}), test_long AS ({_unpivot('test')}),
counts AS (
  SELECT col, val, count(*) FILTER (WHERE converted = 0) AS n0, count(*) FILTER (WHERE converted = 1) AS n1
  FROM train_long GROUP BY col, val
), sizes AS (
  SELECT col, CAST(sum(n0) AS DOUBLE) AS t0, CAST(sum(n1) AS DOUBLE) AS t1, count(*) + 1 AS v FROM counts GROUP BY col
), params AS (
  SELECT col, val, n0, n1, (n0 + {alpha}) / (t0 + {alpha}.0::DOUBLE * v) AS p0, (n1 + {alpha}) / (t1 + {alpha}.0::DOUBLE * v) AS p1
  FROM counts JOIN sizes USING (col)
), defaults AS (
  SELECT col, {alpha} / (t0 + {alpha}.0::DOUBLE * v) AS d0, {alpha} / (t1 + {alpha}.0::DOUBLE * v) AS d1, (t1 + {alpha}) / (t0 + t1 + 2 * {alpha}) AS prior
  FROM sizes
), logits AS (
  SELECT l.session_id, max(ln(prior) - ln(1 - prior))
    + sum(ln(coalesce(p1, d1)) - ln(coalesce(p0, d0))) AS logit
  FROM test_long l JOIN defaults USING (col) LEFT JOIN params p ON p.col = l.col AND p.val = l.val
  GROUP BY l.session_id
), scored AS (
  SELECT t.*, 1 / (1 + exp(-greatest(-35, least(35, logit)))) AS p FROM test t JOIN logits USING (session_id))"""


NB = _nb(10)


def _ranked(group: str = "", source: str = "scored") -> str:
    part, same_score = (f"PARTITION BY {group} ", f"{group}, s") if group else ("", "s")
    return f""", keyed AS (SELECT *, round(p, 9) AS s FROM {source}),
numbered AS (
  SELECT *, row_number() OVER ({part}ORDER BY s DESC, session_id) - 1 AS i,
    row_number() OVER ({part}ORDER BY s, session_id) - 1 AS i_asc,
    count(*) OVER ({part}) AS n, CAST(sum(converted) OVER ({part}) AS BIGINT) AS n1
  FROM keyed
), placed AS (
  SELECT *, sum(converted) OVER ({part}ORDER BY i) AS found, avg(n - i) OVER (PARTITION BY {same_score}) AS mean_rank,
    i < greatest(1, ceil(CAST(0.1 AS DOUBLE) * n)) AS top FROM numbered)"""


RANKED = NB + _ranked()
_CLIPPED = "greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, p))"
AP = "sum(CASE WHEN converted = 1 THEN found / CAST(i + 1 AS DOUBLE) END) / nullif(max(n1), 0)"
AUC = ("(sum(CASE WHEN converted = 1 THEN mean_rank ELSE 0 END) - max(n1) * (max(n1) + 1) / 2.0::DOUBLE)"
       " / nullif(CAST(max(n1) AS DOUBLE) * (max(n) - max(n1)), 0)")
LOSS = f"avg(-(converted * ln({_CLIPPED}) + (1 - converted) * ln(1 - {_CLIPPED})))"
BRIER = "avg(power(p - converted, 2))"
FOUND = "CAST(sum(CASE WHEN top THEN converted ELSE 0 END) AS DOUBLE)"
RECALL = f"{FOUND} / nullif(max(n1), 0)"
RATE = f"{FOUND} / count(*) FILTER (WHERE top)"
LIFT = f"({RATE}) / nullif(CAST(max(n1) AS DOUBLE) / max(n), 0)"
METRICS = {"pr_auc": AP, "roc_auc": AUC, "log_loss": LOSS, "brier_score": BRIER, "recall_at_top_10pct": RECALL,
           "conversion_rate_top_10pct": RATE, "lift_top_10pct": LIFT}
NB_NAME = "'categorical_naive_bayes' AS model"
DECILE = "CAST(least(10, (i * 10) // n + 1) AS INTEGER)"
BAND_ASC = "CAST(least(10, (i_asc * 10) // n + 1) AS INTEGER)"
PURCHASES = "CAST(sum(converted) AS BIGINT)"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0::DOUBLE AS {name}"


def q(prefix: str, body: str) -> str:
    return f"WITH {prefix.strip()}\n{body.strip()}"


def _metric_columns(digits: int = 6, names=tuple(METRICS)) -> str:
    return ", ".join(r(METRICS[m], m, digits) for m in names)


def _lift_table(band: str) -> str:
    return f"""SELECT {band} AS score_decile, count(*) AS sessions, {PURCHASES} AS purchases, {r('avg(p)', 'avg_score')},
  {r('avg(converted)', 'observed_rate')}, {r('avg(converted) / (CAST(max(n1) AS DOUBLE) / max(n))', 'lift_vs_average')}
FROM numbered GROUP BY 1"""


_SESSION = "PARTITION BY user_pseudo_id, ga_session_id"
_LATE = "('purchase', 'refund', 'add_payment_info', 'add_shipping_info', 'begin_checkout')"


def _early(seconds: int) -> str:
    """Each event with the time since its session's first one, then one conditional aggregate for each session."""
    inside = f"(since <= {seconds}000000 AND event_name NOT IN {_LATE})"
    first = ", ".join(f"arg_min({a}, (since, event_id)) FILTER (WHERE {a} IS NOT NULL AND {inside}) AS {a}" for a in ATTRIBUTES)
    counters = ", ".join(f"count(*) FILTER (WHERE {inside} AND event_name = '{e}') AS {c}" for c, e in EARLY_COUNTERS.items())
    return q(NESTED + f""", clocked AS (
  SELECT *, event_timestamp - min(event_timestamp) OVER ({_SESSION}) AS since FROM flat
), summed AS (
  SELECT concat_ws('-', user_pseudo_id, ga_session_id) AS session_id,
    strptime(min(event_date) FILTER (WHERE {inside}), '%Y%m%d')::DATE AS session_date,
    bool_or(event_name = 'purchase' AND since > {seconds}000000)::INTEGER AS converted,
    count(*) FILTER (WHERE {inside}) AS early_event_count,
    count(DISTINCT event_name) FILTER (WHERE {inside}) AS early_distinct_event_types, {counters},
    {r(f"coalesce(sum(engagement_time_msec) FILTER (WHERE {inside}), 0)::DOUBLE / 1000", 'early_engagement_seconds', 4)},
    {first}, ((min(event_timestamp) // 3600000000) % 24)::INTEGER AS session_hour
  FROM clocked GROUP BY user_pseudo_id, ga_session_id)""", """
SELECT *, (isodow(session_date) % 7 + 1)::INTEGER AS day_of_week, (isodow(session_date) > 5)::INTEGER AS is_weekend
FROM summed WHERE early_event_count > 0""")


def _populated(columns, name: str = "column_name", extra: str = "") -> str:
    if not columns:
        return "SELECT CAST(NULL AS VARCHAR) AS column_name, CAST(NULL AS BIGINT) AS populated_rows WHERE false"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS {name}, {extra.format(c) if extra else ''}count({c}) AS populated_rows FROM sessions"
        for c in columns)


def _words(pattern: str, label: str | None = None) -> list[str]:
    words = pattern.split("|")
    return [c for c in SESSION_COLUMNS if c != label and any(w in c for w in words)]


def _funnel_union(select: str) -> str:
    parts = []
    names = list(STAGES)
    for number, (stage, flag) in enumerate(STAGES.items(), 1):
        count = "count(*)" if flag is None else f"CAST(sum({flag}) AS BIGINT)"
        previous = "CAST(NULL AS BIGINT)" if number == 1 else (
            "count(*)" if STAGES[names[number - 2]] is None else f"CAST(sum({STAGES[names[number - 2]]}) AS BIGINT)")
        parts.append(f"SELECT CAST({number} AS INTEGER) AS stage_no, '{stage}' AS stage, {count} AS sessions, "
                     f"{previous} AS previous FROM sessions")
    return SESSIONS + f", stages AS ({' UNION ALL '.join(parts)})", select


PROHIBITED = ["user_pseudo_id", "ga_session_id", "total_events", "distinct_event_types", "page_views", "product_views",
              "add_to_cart_events", "checkout_events", "shipping_events", "payment_events", "purchase_events",
              "viewed_product", "added_to_cart", "began_checkout", "added_shipping_info", "added_payment_info",
              "transaction_count", "revenue", "session_duration_seconds", "engagement_time_seconds"]
NULLS = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ["session_id", "session_date", "converted"] + FEATURES)
KPI_ROWS = {
    "Events analyzed": "sum(total_events)", "Unique users": "count(DISTINCT user_pseudo_id)", "Sessions": "count(*)",
    "Purchases": "sum(converted)", "Conversion rate": "avg(converted)", "Recorded revenue": "sum(revenue)",
    "Revenue per session": "sum(revenue) / count(*)",
}
CONTROLS = {
    "Chronological split": (
        "'Train through ' || (SELECT strftime(max(session_date), '%b %-d') FROM train) || '; test ' || "
        "(SELECT strftime(min(session_date), '%b %-d') || '–' || CASE WHEN strftime(min(session_date), '%Y%m') = "
        "strftime(max(session_date), '%Y%m') THEN strftime(max(session_date), '%-d') "
        "ELSE strftime(max(session_date), '%b %-d') END FROM test)", "'Passed'"),
    "Leakage audit": ("'Full-session behavior and outcomes excluded'", "'Passed'"),
    "Primary metric": ("'PR-AUC on ' || (SELECT format('{:,}', count(*)) FROM test) || ' future sessions'",
                       "(SELECT printf('%.4f', pr_auc) FROM m)"),
    "Capacity metric": ("'Recall and lift at highest-score 10%'",
                        "(SELECT printf('%.1f%% / %.2f×', recall * 100, lift) FROM m)"),
    "Deployment gate": ("'Requires prospective controlled experiment'", "'Experiment only'"),
}
PERIODS = FEATURE_ROWS + f""", train_values AS (SELECT col, val, count(*) AS n FROM ({_unpivot('train')}) GROUP BY ALL),
test_values AS (SELECT col, val, count(*) AS n FROM ({_unpivot('test')}) GROUP BY ALL),
periods AS (
  SELECT coalesce(a.col, b.col) AS col, coalesce(a.val, b.val) AS val, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b
  FROM train_values a FULL JOIN test_values b ON a.col = b.col AND a.val = b.val)"""
ARMS = RANKED + f""", assigned AS (
  SELECT session_id, {DECILE} AS score_band,
    CAST(CAST('0x' || substr(md5('experiment:' || session_id), 1, 8) AS BIGINT) % 2 AS INTEGER) AS arm
  FROM numbered)"""



def _bucket_rows() -> str:
    """Bucket of every value the features can take in the test tables."""
    known = {
        "day_of_week": [str(d) for d in range(1, 8)], "is_weekend": ["0", "1"],
        "traffic_source": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
        "traffic_medium": ["organic", "cpc", "referral"], "device_category": ["desktop", "mobile", "tablet"],
        "operating_system": [f"OS_{i}" for i in range(4)], "country": [f"NATION_{i}" for i in range(25)],
    }
    return ", ".join(
        "('{}', '{}', {})".format(c, v, int.from_bytes(
            hashlib.blake2b(f"{c}={v}".encode(), digest_size=8).digest(), "little") % 2048)
        for c, values in known.items() for v in [*values, "<MISSING>"])


ORACLES = {
    "hash_encode": q(FEATURE_ROWS + f", buckets(col, val, bucket) AS (VALUES {_bucket_rows()})", "SELECT session_id, "
                     + ", ".join(f"(SELECT CAST(bucket AS INTEGER) FROM buckets WHERE col = '{f}' AND "
                                 f"val = CAST({f} AS VARCHAR)) AS {f}_bucket" for f in FEATURES) + " FROM features"),
    "funnel": q(*_funnel_union(f"""
SELECT stage_no, stage, sessions, {r("CASE WHEN stage_no = 1 THEN 1 ELSE sessions / CAST(previous AS DOUBLE) END",
                                     'stage_conversion')}, previous - sessions AS drop_off FROM stages""")),
    "funnel_transitions": q(*_funnel_union(
        "SELECT CASE stage_no " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TRANSITIONS, 2))
        + " END AS transition, round(sessions / CAST(previous AS DOUBLE), 4) AS conversion_rate"
          " FROM stages WHERE stage_no > 1")),
    "dashboard_funnel": q(*_funnel_union("SELECT stage, sessions FROM stages")),
    "funnel_wide": q(SESSIONS, """
SELECT count(*) AS visit_sessions, count(*) FILTER (WHERE viewed_product = 1) AS product_view_sessions,
  count(*) FILTER (WHERE added_to_cart = 1) AS add_to_cart_sessions,
  count(*) FILTER (WHERE began_checkout = 1) AS checkout_sessions,
  count(*) FILTER (WHERE added_payment_info = 1) AS payment_sessions,
  count(*) FILTER (WHERE converted = 1) AS purchase_sessions FROM sessions"""),
    "sessionize": q(SESSIONS, "SELECT * REPLACE (" + ", ".join(r(c, c) for c in (
        "revenue", "session_duration_seconds", "engagement_time_seconds")) + ") FROM sessions"),
    "first_sessions": q(SESSIONS, "SELECT * REPLACE (" + ", ".join(r(c, c) for c in (
        "revenue", "session_duration_seconds", "engagement_time_seconds")) + ") FROM sessions ORDER BY session_id LIMIT 5"),
    "core_totals": q(SESSIONS, f"""
SELECT count(*) AS total_sessions, count(DISTINCT user_pseudo_id) AS unique_users,
  CAST(sum(total_events) AS BIGINT) AS total_events, {PURCHASES} AS converted_sessions,
  {r('avg(converted)', 'conversion_rate')}, {r('sum(revenue)', 'total_revenue')} FROM sessions"""),
    "kpis": q(SESSIONS, " UNION ALL ".join(
        f"SELECT '{k}' AS kpi, {r(f'CAST({e} AS DOUBLE)', 'value')} FROM sessions" for k, e in KPI_ROWS.items())),
    "dashboard_kpis": q(SESSIONS, f"""
SELECT count(*) AS sessions, {r('avg(converted)', 'conversion_rate')}, {r('sum(revenue)', 'revenue')},
  {r('sum(revenue) / count(*)', 'revenue_per_session')} FROM sessions"""),
    "scan_event_days": q(NESTED, """
SELECT event_date, event_name, count(*) AS events FROM flat WHERE event_date BETWEEN '20240108' AND '20240121'
GROUP BY ALL"""),
    "session_table_by_date": q(SESSIONS, f"""
SELECT session_date, count(*) AS sessions, {PURCHASES} AS purchases, {r('sum(revenue)', 'revenue', 4)}
FROM sessions WHERE session_date >= {CUTOFF} GROUP BY session_date"""),
    "session_csv": q(SESSIONS, f"""
SELECT count(*) AS sessions, {r('avg(converted)', 'conversion_rate', 4)}, {r('sum(revenue)', 'revenue', 4)}
FROM sessions"""),
    "column_catalog": q(SESSIONS, _populated(SESSION_COLUMNS)),
    "quality_report": q(SESSIONS, f"""
SELECT 'Required columns missing' AS "check", '[]' AS result
UNION ALL SELECT 'Missing values', CAST({NULLS} AS VARCHAR) FROM sessions
UNION ALL SELECT 'Duplicate session IDs', CAST(count(*) - count(DISTINCT session_id) AS VARCHAR) FROM sessions
UNION ALL SELECT 'Start date', CAST(min(session_date) AS VARCHAR) FROM sessions
UNION ALL SELECT 'End date', CAST(max(session_date) AS VARCHAR) FROM sessions"""),
    "leakage_audit_regex": q(SESSIONS, _populated(_words(START_WORDS, "converted"))),
    "leakage_audit_tokens": q(SESSIONS, """
SELECT 'Score-time feature count' AS control, '7' AS result
UNION ALL SELECT 'Post-session or outcome feature matches', '[]'
UNION ALL SELECT 'Label definition', CASE WHEN bool_and((converted = 1) = (purchase_events > 0)) THEN 'Any purchase within the session'
  ELSE 'Violated' END FROM sessions
UNION ALL SELECT 'Sessions with every feature', CAST(count(*) AS VARCHAR) FROM sessions WHERE """
                              + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
                              + " UNION ALL SELECT 'Feature contract', 'Passed'"),
    "leakage_audit_columns": q(SESSIONS, " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{'feature' if c in FEATURES else 'present but excluded'}' AS role, "
        f"count({c}) AS populated_rows FROM sessions" for c in SESSION_COLUMNS if c in FEATURES + PROHIBITED)),
    "uniqueness_audit": q(SESSIONS, """
SELECT count(*) AS rows, count(DISTINCT session_id) AS unique_sessions,
  count(*) - count(DISTINCT session_id) AS duplicate_sessions FROM sessions"""),
    "split_summary": q(SESSIONS, f"""
SELECT CASE WHEN session_date < {CUTOFF} THEN 'Train' ELSE 'Test' END AS sample, min(session_date) AS start_date,
  max(session_date) AS end_date, count(*) AS sessions, {PURCHASES} AS purchases, {r('avg(converted)', 'conversion_rate')}
FROM sessions GROUP BY 1"""),
    "reconcile": q(*_funnel_union("""
SELECT stage AS "check", CAST(sessions AS DOUBLE) AS actual, CAST(sessions AS DOUBLE) AS expected, true AS passed
FROM stages""")),
    "start_features": q(FEATURE_ROWS, "SELECT * FROM features"),
    "nb_params": q(NB, f"""
SELECT col AS "column", val AS value, n0, n1, {r('p0', 'p0', 9)}, {r('p1', 'p1', 9)} FROM params"""),
    "nb_defaults": q(NB, f"""
SELECT col AS "column", {r('d0', 'd0', 9)}, {r('d1', 'd1', 9)}, {r('prior', 'prior', 9)} FROM defaults"""),
    "nb_scores": q(NB, f"SELECT session_id, session_date, converted, {r('p', 'predicted_probability')} FROM scored"),
    "scores_export": q(NB, f"""
SELECT session_id, strftime(session_date, '%Y-%m-%d') AS session_date, converted, {r('p', 'predicted_probability')}
FROM scored"""),
    "average_precision_nb": q(RANKED, f"SELECT {NB_NAME}, {_metric_columns(8, ['pr_auc'])} FROM placed"),
    "roc_auc_nb": q(RANKED, f"SELECT {NB_NAME}, {_metric_columns(8, ['roc_auc'])} FROM placed"),
    "log_loss_brier_nb": q(NB, f"SELECT {NB_NAME}, {_metric_columns(8, ['log_loss', 'brier_score'])} FROM scored"),
    "topk_nb": q(RANKED, f"""SELECT {NB_NAME}, {_metric_columns(8, [
        'recall_at_top_10pct', 'conversion_rate_top_10pct', 'lift_top_10pct'])} FROM placed"""),
    "model_metrics_nb": q(RANKED, f"SELECT {NB_NAME}, {_metric_columns()} FROM placed"),
    "metrics_payload": q(RANKED + f", m AS (SELECT {', '.join(f'{e} AS {n}' for n, e in METRICS.items())} FROM placed)",
                         " UNION ALL ".join(
                             [f"SELECT {NB_NAME}, '{n}' AS metric, {r(n, 'value')} FROM m" for n in METRICS]
                             + [f"SELECT 'data', '{side}_{n}', {r(f'CAST({e} AS DOUBLE)', 'value')} FROM {side}"
                                for side in ("train", "test") for n, e in (
                                    ("rows", "count(*)"), ("purchases", "sum(converted)"),
                                    ("conversion_rate", "avg(converted)"))]
                             + ["SELECT 'data', 'rows', CAST(count(*) AS DOUBLE) FROM features"])),
    "decile_lift_nb": q(RANKED, _lift_table(DECILE)),
    "lift_ntile_nb": q(RANKED + """, tiled AS (
  SELECT *, CAST(ntile(10) OVER (ORDER BY s DESC, session_id) AS INTEGER) AS tile FROM numbered)""",
                       _lift_table("tile").replace("FROM numbered", "FROM tiled")),
    "calibration_nb": q(RANKED, f"""
SELECT {BAND_ASC} AS risk_band, count(*) AS sessions, {r('avg(p)', 'predicted_rate')},
  {r('avg(converted)', 'observed_rate')} FROM numbered GROUP BY 1"""),
    "calibration_fixed_width_nb": q(NB, f"""
SELECT CAST(least(9, floor(p * 10)) AS INTEGER) AS probability_band, count(*) AS sessions,
  {r('avg(p)', 'avg_predicted_rate')}, {r('avg(converted)', 'observed_rate')} FROM scored GROUP BY 1"""),
    "early_features": _early(300),
    "early_features_wide": _early(14400),
    "label_after_horizon": q(NESTED + f""", clocked AS (
  SELECT *, event_timestamp - min(event_timestamp) OVER ({_SESSION}) AS since FROM flat)""", """
SELECT concat_ws('-', user_pseudo_id, ga_session_id) AS session_id,
  bool_or(event_name = 'purchase' AND since > 300000000)::INTEGER AS converted
FROM clocked GROUP BY user_pseudo_id, ga_session_id"""),
    "dashboard_model_kpis": q(RANKED, f"""
SELECT {r(AP, 'pr_auc')}, {r(AUC, 'roc_auc')}, {r(LIFT, 'top_decile_lift')}, {r(RECALL, 'top_10_recall')}
FROM placed"""),
    "dashboard_lift_deciles": q(RANKED, f"""
SELECT CAST({DECILE} AS VARCHAR) AS decile, {r('avg(converted) / (CAST(max(n1) AS DOUBLE) / max(n))', 'lift')},
  count(*) AS sessions, {PURCHASES} AS purchases FROM numbered GROUP BY 1"""),
    "dashboard_calibration_tidy": q(RANKED + f""", bands AS (
  SELECT CAST({BAND_ASC} AS VARCHAR) AS risk_band, avg(p) AS predicted, avg(converted) AS observed
  FROM numbered GROUP BY 1)""", f"""
SELECT risk_band, 'Predicted' AS series, {r('predicted', 'rate')} FROM bands
UNION ALL SELECT risk_band, 'Observed', {r('observed', 'rate')} FROM bands"""),
    "dashboard_model_controls": q(
        RANKED + f", m AS (SELECT {AP} AS pr_auc, {RECALL} AS recall, {LIFT} AS lift FROM placed)",
        " UNION ALL ".join(f"SELECT '{c}' AS control, {i} AS implementation, {s} AS status"
                           for c, (i, s) in CONTROLS.items())),
    "input_coverage": q(PERIODS, f"""
SELECT col AS "column", CAST(sum(b) AS BIGINT) AS sessions,
  {r("sum(CASE WHEN val = '<MISSING>' THEN b ELSE 0 END) / CAST(sum(b) AS DOUBLE)", 'missing_rate')},
  {r("sum(CASE WHEN a = 0 THEN b ELSE 0 END) / CAST(sum(b) AS DOUBLE)", 'unseen_rate')}
FROM periods GROUP BY col"""),
    "feature_drift": q(PERIODS + """, shares AS (
  SELECT col, greatest(1e-6::DOUBLE, a / CAST(sum(a) OVER (PARTITION BY col) AS DOUBLE)) AS pa,
    greatest(1e-6::DOUBLE, b / CAST(sum(b) OVER (PARTITION BY col) AS DOUBLE)) AS pb FROM periods)""", f"""
SELECT col AS "column", {r('sum((pb - pa) * ln(pb / pa))', 'stability_index')}, count(*) AS distinct_values
FROM shares GROUP BY col"""),
    "score_distribution": q(NB, f"""
SELECT {NB_NAME}, CAST(least(19, floor(p * 20)) AS INTEGER) AS score_bin, count(*) AS sessions,
  {r('min(p)', 'lowest')}, {r('max(p)', 'highest')} FROM scored GROUP BY 2"""),
    "segment_metrics": q(NB + _ranked("device_category"), f"""
SELECT {NB_NAME}, device_category, {_metric_columns()} FROM placed GROUP BY device_category"""),
    "experiment_assignment": q(ARMS, "SELECT session_id, score_band, arm FROM assigned"),
    "experiment_outcomes": q(ARMS + """, outcomes AS (
  SELECT score_band, arm, count(*) AS eligible_sessions, avg(converted) AS rate, avg(revenue) AS revenue,
    stddev_samp(revenue) AS spread
  FROM assigned JOIN sessions USING (session_id) GROUP BY score_band, arm)""", f"""
SELECT o.score_band, o.arm, o.eligible_sessions, {r('o.rate', 'conversion_rate', 5)},
  {r('o.revenue', 'revenue_per_session', 5)}, {r('o.spread', 'revenue_stddev', 5)},
  {r('o.rate - c.rate', 'conversion_difference', 5)}, {r('o.revenue - c.revenue', 'revenue_difference', 5)}
FROM outcomes o LEFT JOIN outcomes c ON c.score_band = o.score_band AND c.arm = 0"""),
}

_MODELS = {f"alpha_{a}": _nb(a) + _ranked() for a in (10, 1)}


def _of_models(columns: str, tail: str = "FROM placed") -> str:
    """The same columns for both models, one row each."""
    return " UNION ALL ".join(f"SELECT '{name}' AS model, {columns} FROM ({q(sql, 'SELECT * ' + tail)})" for name, sql in _MODELS.items())


_PRECISION = "sum(CASE WHEN s >= 0.12::DOUBLE THEN converted END) / nullif(CAST(count(*) FILTER (WHERE s >= 0.12::DOUBLE) AS DOUBLE), 0)"
_RECALL_AT = "sum(CASE WHEN s >= 0.12::DOUBLE THEN converted ELSE 0 END) / CAST(sum(converted) AS DOUBLE)"
_TYPES = {"session_date": "date", "revenue": "double", "session_duration_seconds": "double", "engagement_time_seconds": "double"} | {
    c: "string" for c in ["session_id", "user_pseudo_id", *ATTRIBUTES]} | {c: "int" for c in ["day_of_week", "is_weekend", *FLAGS]}
ORACLES |= {
    "segment_metrics_nulls": q(
        NB + ", segmented AS (SELECT *, nullif(device_category, 'mobile') AS segment FROM scored)" + _ranked("segment", "segmented"),
        f"SELECT {NB_NAME}, segment, {_metric_columns()} FROM placed GROUP BY segment"),
    "nb_comparison": f"SELECT *, pr_auc = max(pr_auc) OVER () AS selected FROM ({_of_models(_metric_columns())})",
    "nb_selected": f"SELECT arg_max(model, pr_auc) AS selected_by_pr_auc, max(pr_auc) AS pr_auc FROM ({_of_models(_metric_columns())})",
    "nb_dashboard_comparison": " UNION ALL ".join(
        f"SELECT model, '{text}' AS metric, {m} AS value FROM ({_of_models(_metric_columns())})"
        for text, m in (("PR-AUC", "pr_auc"), ("ROC-AUC", "roc_auc"))),
    "nb_evaluation": f"SELECT model, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('accuracy', 'accuracy')}, "
                     f"{r('2 * precision * recall / nullif(precision + recall, 0)', 'f1_score')}, log_loss, roc_auc FROM ("
                     + _of_models(f"{_PRECISION} AS precision, {_RECALL_AT} AS recall, "
                                  "avg(CASE WHEN (s >= 0.12::DOUBLE) = (converted = 1) THEN 1 ELSE 0 END) AS accuracy, "
                                  + _metric_columns(6, ["log_loss", "roc_auc"])) + ")",
    "class_weights": q(f"early_rows AS ({_early(14400)})", f"""
SELECT converted, count(*) AS sessions, {r('sum(count(*)) OVER () / (2.0::DOUBLE * count(*))', 'class_weight')}
FROM early_rows WHERE session_date < {CUTOFF} GROUP BY converted"""),
    "nb_reloaded_scores": ORACLES["nb_scores"],
    "logistic_certificate": q(FEATURE_ROWS + f", train_long AS ({_unpivot('train')}), buckets(col, val, bucket) AS "
                              f"(VALUES {_bucket_rows()})", """
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS hits, true AS optimal
FROM train_long JOIN buckets USING (col, val) GROUP BY bucket"""),
    "lift_csv": ORACLES["decile_lift_nb"],
    "session_catalog": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{_TYPES.get(c, 'bigint')}' AS data_type" for c in SESSION_COLUMNS),
}


def _target_rates() -> str:
    """Rates by plain sums over all rows of a value outside the fold, for each training row's fold and for later rows."""
    folds, smoothing = 5, "20.0::DOUBLE"
    long = " UNION ALL ".join(
        f"SELECT session_id, converted, fold, '{a}' AS col, coalesce({a}, '<MISSING>') AS val FROM train_rows" for a in ATTRIBUTES)
    rates = ", ".join(
        f"round(max(CASE WHEN w.col = '{a}' THEN coalesce(rate, 0) END), 9) + 0.0::DOUBLE AS {a}_rate" for a in ATTRIBUTES)
    wanted = " UNION ALL ".join(
        f"SELECT session_id, sample, fold, '{a}' AS col, coalesce({a}, '<MISSING>') AS val FROM both_samples" for a in ATTRIBUTES)
    return q(f"""early_rows AS ({_early(14400)}), train_rows AS (
  SELECT *, CAST(CAST('0x' || substr(md5('fold:' || session_id), 1, 8) AS BIGINT) % {folds} AS INTEGER) AS fold
  FROM early_rows WHERE session_date < {CUTOFF}
), both_samples AS (
  SELECT 'train' AS sample, session_id, fold, {', '.join(ATTRIBUTES)} FROM train_rows
  UNION ALL SELECT 'test', session_id, -1, {', '.join(ATTRIBUTES)} FROM early_rows WHERE session_date >= {CUTOFF}
), long_rows AS ({long}), left_out AS (SELECT unnest(range(-1, {folds}))::INTEGER AS out),
outside AS (SELECT out, count(*) AS all_n, sum(converted) AS all_positives FROM train_rows, left_out WHERE fold <> out GROUP BY out),
rates AS (
  SELECT out, col, val, CAST(sum(converted) * max(all_n) - count(*) * max(all_positives) AS DOUBLE) / max(all_n) / (count(*) + {smoothing}) AS rate
  FROM long_rows JOIN outside ON fold <> out GROUP BY out, col, val
), wanted AS ({wanted})""", f"""
SELECT w.session_id, sample, {rates} FROM wanted w
  LEFT JOIN rates r ON r.out = w.fold AND r.col = w.col AND r.val = w.val GROUP BY w.session_id, sample""")


ORACLES |= {
    "early_target_rates": _target_rates(),
    "early_attribution_check": q(f"early_rows AS ({_early(14400)})", f"""
SELECT model, session_id, true AS adds_up, true AS is_the_score
FROM early_rows, (SELECT unnest(['logistic', 'boosted_tree']) AS model) WHERE session_date >= {CUTOFF}"""),
}


def _period_drift() -> str:
    pairs = {"split": ("2024-01-01", "2024-01-21", "2024-01-22", "2024-01-31"), "weeks": ("2024-01-01", "2024-01-10", "2024-01-08", "2024-01-14"),
             "days": ("2024-01-29", "2024-01-29", "2024-01-02", "2024-01-02")}
    values = " UNION ALL ".join(f"SELECT session_date, '{f}' AS col, CAST({f} AS VARCHAR) AS val FROM features" for f in FEATURES)
    listed = ", ".join(f"('{name}', DATE '{a}', DATE '{b}', DATE '{c}', DATE '{d}')" for name, (a, b, c, d) in pairs.items())
    return q(FEATURE_ROWS + f""", long_rows AS ({values}), pairs(periods, a, b, c, d) AS (VALUES {listed}),
counts AS (
  SELECT periods, col, val, count(*) FILTER (WHERE session_date BETWEEN a AND b) AS x,
    count(*) FILTER (WHERE session_date BETWEEN c AND d) AS y
  FROM long_rows, pairs WHERE session_date BETWEEN a AND b OR session_date BETWEEN c AND d GROUP BY periods, col, val
), shares AS (
  SELECT *, greatest(1e-6::DOUBLE, x / CAST(sum(x) OVER (PARTITION BY periods, col) AS DOUBLE)) AS px,
    greatest(1e-6::DOUBLE, y / CAST(sum(y) OVER (PARTITION BY periods, col) AS DOUBLE)) AS py FROM counts)""", f"""
SELECT periods, col AS "column", CAST(sum(y) AS BIGINT) AS sessions,
  {r("sum(CASE WHEN val = '<MISSING>' THEN y ELSE 0 END) / CAST(sum(y) AS DOUBLE)", 'missing_rate')},
  {r("sum(CASE WHEN x = 0 THEN y ELSE 0 END) / CAST(sum(y) AS DOUBLE)", 'unseen_rate')},
  {r('sum((py - px) * ln(py / px))', 'stability_index')}, count(*) AS distinct_values
FROM shares GROUP BY periods, col""")


ORACLES |= {"period_drift": _period_drift(), "sessions_by_days": ORACLES["sessionize"]}


def _payload_document() -> str:
    measured = _of_models(_metric_columns())
    sides = {"train": "train", "test": "test"}
    none = "CAST(NULL AS DOUBLE) AS number"
    lines = ["SELECT 'data' AS section, 'rows' AS name, CAST(count(*) AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text FROM features"]
    for side in sides:
        lines += [f"SELECT 'data', '{side}_{n}', {r(f'CAST({e} AS DOUBLE)', 'number')}, NULL FROM {side}" for n, e in (
            ("rows", "count(*)"), ("purchases", "sum(converted)"), ("conversion_rate", "avg(converted)"))]
        lines += [f"SELECT 'split', '{side}_{n}', {none}, strftime({f}(session_date), '%Y-%m-%d') FROM {side}" for n, f in (
            ("start", "min"), ("end", "max"))]
    lines += [f"SELECT 'feature_contract', '{n}', {none}, '{text}'" for n, text in (
        ("safe_features", ",".join(FEATURES)), ("prohibited_columns_present_but_excluded", ",".join(sorted(PROHIBITED))), ("status", "passed"))]
    lines += [f"SELECT model, '{m}', {m}, NULL FROM ({measured})" for m in METRICS]
    lines += [f"SELECT 'selected_by_pr_auc', 'model', {none}, arg_max(model, pr_auc) FROM ({measured})",
              "SELECT 'training_loss', 'iterations', 0.0::DOUBLE, NULL"]
    return q(FEATURE_ROWS, " UNION ALL ".join(lines))


_EARLY_COLUMNS = (["session_id", "session_date", "converted", "early_event_count", "early_distinct_event_types"] + list(EARLY_COUNTERS)
                  + ["early_engagement_seconds"] + ATTRIBUTES + ["day_of_week", "is_weekend", "session_hour"])
ORACLES |= {
    "leakage_audit_early": q(f"early_rows AS ({_early(14400)})", " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, regexp_matches('{c}', 'purchase|revenue|transaction|payment|checkout|duration|total_events') AS forbidden, "
        f"count({c}) AS populated_rows FROM early_rows" for c in _EARLY_COLUMNS)),
    "payload_document": _payload_document(),
    "logistic_history_check": "SELECT true AS falls, true AS converged, true AS ends_at_the_objective",
}

_PERIOD_DAYS = {"all": ("2024-01-22", "2024-01-31"), "days": ("2024-01-23", "2024-01-25"), "day": ("2024-01-30", "2024-01-30")}
ORACLES |= {
    "score_quantiles": q(FEATURE_ROWS, " UNION ALL ".join(
        f"SELECT {NB_NAME}, '{name}' AS period, count(*) AS sessions, {p}::DOUBLE AS probability, true AS within_bound "
        f"FROM test WHERE session_date BETWEEN DATE '{a}' AND DATE '{b}' HAVING count(*) > 0"
        for name, (a, b) in _PERIOD_DAYS.items() for p in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99))),
    "table_difference": q(SESSIONS, """
SELECT session_id, session_date, converted, 'actual only' AS side FROM sessions WHERE md5(session_id) LIKE 'ff%'
UNION ALL SELECT session_id, session_date, 1 - converted, 'expected only' FROM sessions WHERE md5(session_id) LIKE 'ff%'
UNION ALL SELECT session_id, session_date, converted, 'expected only' FROM sessions WHERE md5(session_id) LIKE '00%'"""),
    "experiment_by_user": q(RANKED + f""", chosen AS (
  SELECT user_pseudo_id, {DECILE} AS band, CAST(CAST('0x' || substr(md5('experiment:' || user_pseudo_id), 1, 8) AS BIGINT) % 2 AS INTEGER) AS arm,
    CAST(s.converted AS DOUBLE) AS converted, revenue
  FROM numbered JOIN sessions s USING (session_id)
), long_rows AS (
  SELECT 'converted' AS metric, user_pseudo_id, band, arm, converted AS y FROM chosen
  UNION ALL SELECT 'revenue', user_pseudo_id, band, arm, revenue FROM chosen
), centred AS (
  SELECT *, avg(y) OVER (PARTITION BY metric, band, arm) AS mean, count(*) OVER (PARTITION BY metric, band, arm) AS n,
    count(*) OVER (PARTITION BY metric, band) / CAST(count(*) OVER (PARTITION BY metric) AS DOUBLE) AS share,
    min(arm) OVER (PARTITION BY metric, band) <> max(arm) OVER (PARTITION BY metric, band) AS whole
  FROM long_rows
), kept AS (
  SELECT *, share / (SELECT sum(share) FROM (SELECT DISTINCT metric AS m, band, share FROM centred WHERE whole) WHERE m = metric) AS w
  FROM centred WHERE whole
), users AS (
  SELECT metric, user_pseudo_id, sum((2 * arm - 1) * w * (y - mean) / n) AS u, count(*) AS sessions FROM kept GROUP BY ALL
), shifts AS (
  SELECT metric, sum((2 * arm - 1) * w * mean) AS difference FROM (SELECT DISTINCT metric, band, arm, w, mean FROM kept) GROUP BY metric)""", f"""
SELECT u.metric, CAST(sum(sessions) AS BIGINT) AS sessions, count(*) AS users, {r('max(difference)', 'difference')},
  {r('sqrt(count(*) / CAST(count(*) - 1 AS DOUBLE) * sum(u * u))', 'standard_error')}
FROM users u JOIN shifts s ON s.metric = u.metric GROUP BY u.metric"""),
}

# Draws by the 32-bit numbers of an MD5 digest; each number of draws has its Poisson(1) share of them.
_LIMITS = [int(2 ** 32 * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(13)]
_DRAWN = " + ".join(f"CAST(u >= {limit} AS INTEGER)" for limit in _LIMITS)
_REPLICATES = f"""ranks AS ({_of_models('session_id, converted, i')}
), numbers AS (
  SELECT model, session_id, converted, i, CAST(t.replicate AS INTEGER) AS replicate,
    CAST('0x' || substr(md5('resample:' || session_id || ':' || ((t.replicate - 1) // 4)), (t.replicate - 1) % 4 * 8 + 1, 8) AS BIGINT) AS u
  FROM ranks CROSS JOIN range(1, 201) t(replicate)
), weighted AS (
  SELECT model, converted, i, replicate, {_DRAWN} AS w FROM numbers
  UNION ALL SELECT model, converted, i, 0, 1 FROM ranks
), running AS (
  SELECT model, replicate, w * converted AS found, sum(w * converted) OVER upto / CAST(nullif(sum(w) OVER upto, 0) AS DOUBLE) AS precise
  FROM weighted WINDOW upto AS (PARTITION BY model, replicate ORDER BY i)
), replicates AS (
  SELECT model, replicate, sum(found * precise) / CAST(nullif(sum(found), 0) AS DOUBLE) AS pr_auc FROM running GROUP BY model, replicate
)"""
ORACLES |= {
    "early_features_stored": ORACLES["early_features_wide"],
    "nb_resampled_precision": q(_REPLICATES, f"SELECT model, replicate, {r('pr_auc', 'pr_auc')} FROM replicates"),
    "nb_selection_certainty": q(_REPLICATES + """, best AS (
  SELECT model FROM replicates WHERE replicate = 0 ORDER BY pr_auc DESC, model LIMIT 1
), gaps AS (
  SELECT a.model AS selected, b.model, a.replicate, a.pr_auc AS x, b.pr_auc AS y, a.pr_auc - b.pr_auc AS gap
  FROM replicates a JOIN replicates b ON a.replicate = b.replicate AND a.model <> b.model WHERE a.model = (SELECT model FROM best))""", f"""
SELECT selected, model, {r('max(x) FILTER (WHERE replicate = 0)', 'selected_pr_auc')}, {r('max(y) FILTER (WHERE replicate = 0)', 'pr_auc')},
  {r('max(gap) FILTER (WHERE replicate = 0)', 'difference')}, {r('stddev_samp(gap) FILTER (WHERE replicate > 0)', 'standard_error')},
  {r('quantile_cont(gap, 0.025) FILTER (WHERE replicate > 0)', 'low')}, {r('quantile_cont(gap, 0.975) FILTER (WHERE replicate > 0)', 'high')},
  {r('avg(CAST(gap > 0 AS INTEGER)) FILTER (WHERE replicate > 0)', 'share_ahead')}
FROM gaps GROUP BY selected, model"""),
}
