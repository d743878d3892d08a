"""What the engine needs to know about one tracker, kept as data.

Operators take a ``SessionSpec`` instead of hard-coding event or column names, so another tracker is another spec.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# ---------------------------------------------------------------------------------------------------------------------
# Names, labels, word lists and constants that results depend on.
# ---------------------------------------------------------------------------------------------------------------------
MISSING = "<MISSING>"

KEY = "session_id"
DATE = "session_date"
LABEL = "converted"

ATTRIBUTES = ("traffic_source", "traffic_medium", "device_category", "operating_system", "country")

START_FEATURES = ("day_of_week", "is_weekend") + ATTRIBUTES

# Counter column -> event name
EVENT_COUNTERS = (
    ("page_views", "page_view"),
    ("product_views", "view_item"),
    ("add_to_cart_events", "add_to_cart"),
    ("checkout_events", "begin_checkout"),
    ("shipping_events", "add_shipping_info"),
    ("payment_events", "add_payment_info"),
    ("purchase_events", "purchase"),
)

# Flag column -> event name
EVENT_FLAGS = (
    ("viewed_product", "view_item"),
    ("added_to_cart", "add_to_cart"),
    ("began_checkout", "begin_checkout"),
    ("added_shipping_info", "add_shipping_info"),
    ("added_payment_info", "add_payment_info"),
    ("converted", "purchase"),
)

# Stage label, flag column (None: every session), output column of the one-row funnel
FUNNEL_STAGES = (
    ("Visit", None, "visit_sessions"),
    ("Product View", "viewed_product", "product_view_sessions"),
    ("Add to Cart", "added_to_cart", "add_to_cart_sessions"),
    ("Begin Checkout", "began_checkout", "checkout_sessions"),
    ("Payment Info", "added_payment_info", "payment_sessions"),
    ("Purchase", "converted", "purchase_sessions"),
)

FUNNEL_TRANSITIONS = (
    "Visit → Product View",
    "Product View → Add to Cart",
    "Add to Cart → Begin Checkout",
    "Begin Checkout → Payment",
    "Payment → Purchase",
)

EARLY_COUNTERS = (
    ("early_page_views", "page_view"),
    ("early_product_views", "view_item"),
    ("early_searches", "view_search_results"),
    ("early_scrolls", "scroll"),
    ("early_promotion_views", "view_promotion"),
    ("early_add_to_cart", "add_to_cart"),
)

EARLY_EXCLUDED_EVENTS = ("purchase", "refund", "add_payment_info", "add_shipping_info", "begin_checkout")

# Three separate leakage policies: a word pattern for the session-start table, a shorter one for the early-window table,
# and a list of exact names for training.
START_LEAKAGE_WORDS = (
    "page", "product", "cart", "checkout", "shipping", "payment",
    "purchase", "revenue", "transaction", "duration", "engagement", "event",
)
EARLY_LEAKAGE_WORDS = ("purchase", "revenue", "transaction", "payment", "checkout", "duration", "total_events")
PROHIBITED_COLUMNS = (
    "user_pseudo_id", "ga_session_id", "total_events", "distinct_event_types", "page_views", "product_views",
    "add_to_cart_events", "checkout_events", "shipping_events", "payment_events", "purchase_events", "viewed_product",
    "added_to_cart", "began_checkout", "added_shipping_info", "added_payment_info", "transaction_count", "revenue",
    "session_duration_seconds", "engagement_time_seconds",
)

KPI_NAMES = ("Events analyzed", "Unique users", "Sessions", "Purchases", "Conversion rate", "Recorded revenue",
             "Revenue per session")
QUALITY_CHECKS = ("Required columns missing", "Missing values", "Duplicate session IDs", "Start date", "End date")
CONTRACT_CONTROLS = ("Score-time feature count", "Post-session or outcome feature matches", "Label definition",
                     "Sessions with every feature", "Feature contract")
LABEL_DEFINITION = "Any purchase within the session"
# Control, implementation, status; the marks are filled from the data.
SPLIT_CONTROL = ("Chronological split", "Train through %s; test %s–%s", "Passed")
LEAKAGE_CONTROL = ("Leakage audit", "Full-session behavior and outcomes excluded", "Passed")
METRIC_CONTROL = ("Primary metric", "PR-AUC on %s future sessions", "%.4f")
CAPACITY_CONTROL = ("Capacity metric", "Recall and lift at highest-score 10%", "%.1f%% / %.2f×")
GATE_CONTROL = ("Deployment gate", "Requires prospective controlled experiment", "Experiment only")

HASH_BUCKETS = 2048
LOGISTIC_L2 = 1e-5
NAIVE_BAYES_ALPHA = 10.0
LOGIT_LIMIT = 35.0
PROBABILITY_FLOOR = 1e-12
BANDS = 10
CAPACITY = 0.10
EARLY_WINDOW_SECONDS = 300

LOGISTIC = "hashed_logistic_regression"
NAIVE_BAYES = "categorical_naive_bayes"
MODEL_LABELS = ((LOGISTIC, "Hashed logistic regression"), (NAIVE_BAYES, "Categorical Naive Bayes"))
# ---------------------------------------------------------------------------------------------------------------------

REQUIRED_COLUMNS = (KEY, DATE, LABEL) + START_FEATURES


@dataclass(frozen=True)
class SessionSpec:
    """Event names, stages, features and limits of one tracker."""

    cutoff: dt.date = dt.date(2021, 1, 11)
    session_param: str = "ga_session_id"
    engagement_param: str = "engagement_time_msec"
    purchase_event: str = "purchase"
    attributes: tuple = ATTRIBUTES
    counters: tuple = EVENT_COUNTERS
    flags: tuple = EVENT_FLAGS
    stages: tuple = FUNNEL_STAGES
    transitions: tuple = FUNNEL_TRANSITIONS
    features: tuple = START_FEATURES
    early_counters: tuple = EARLY_COUNTERS
    early_excluded: tuple = EARLY_EXCLUDED_EVENTS
    early_window_seconds: int = EARLY_WINDOW_SECONDS
    prohibited: tuple = PROHIBITED_COLUMNS


DEFAULT_SPEC = SessionSpec()
