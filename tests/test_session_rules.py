"""One hand-made case per rule of the session table."""

import datetime as dt

import pytest
from frames import SECOND, event, flat

from visitloom.operators.early import early_features, label_after_horizon
from visitloom.operators.funnel import funnel, funnel_transitions, funnel_wide
from visitloom.operators.sessions import core_totals, kpis, sessionize


def one(spark, *events):
    rows = sessionize(flat(spark, *events)).collect()
    assert len(rows) == 1
    return rows[0]


def test_first_non_null_attribute_wins(spark):
    row = one(spark, event("page_view", 0, source=None, country="B"), event("scroll", 5, source="ads", country="C"))
    assert (row.traffic_source, row.country) == ("ads", "B")
    assert row.traffic_medium == "<MISSING>"


def test_equal_timestamps_are_ordered_by_event_id(spark):
    row = one(spark, event("page_view", 0, event_id=2, source="late"), event("scroll", 0, event_id=1, source="early"))
    assert row.traffic_source == "early"


def test_events_without_session_id_are_dropped(spark):
    row = one(spark, event("page_view"), event("page_view", session=None), event("page_view", params=None, session=None))
    assert row.total_events == 1


def test_transactions_are_distinct_but_revenue_is_not(spark):
    row = one(spark, event("purchase", 0, transaction="T", revenue=3.0), event("purchase", 1, transaction="T", revenue=4.0),
              event("purchase", 2, transaction=None, revenue=None), event("page_view", 3, transaction="X", revenue=9.0))
    assert (row.transaction_count, row.revenue, row.purchase_events, row.distinct_event_types) == (1, 7.0, 3, 2)


def test_many_transactions_and_types_are_counted_exactly(spark):
    events = [event("purchase", i, event_id=i, transaction=f"T{i % 40}", revenue=1.0) for i in range(200)]
    events += [event(f"custom_{i % 25}", 1000 + i, event_id=1000 + i) for i in range(100)]
    row = one(spark, *events)
    assert (row.transaction_count, row.distinct_event_types, row.total_events, row.revenue) == (40, 26, 300, 200.0)


def test_missing_event_name_is_an_event_but_not_a_type(spark):
    row = one(spark, event(None), event("scroll", 1))
    assert (row.total_events, row.distinct_event_types) == (2, 1)


def test_duration_and_engagement_in_seconds(spark):
    row = one(spark, event("page_view", 0, engagement=1500), event("scroll", 2_500_000, engagement=None))
    assert (row.session_duration_seconds, row.engagement_time_seconds) == (2.5, 1.5)


def test_first_matching_parameter_wins(spark):
    twice = [("other", (5,)), ("ga_session_id", (7,)), ("ga_session_id", (8,))]
    assert one(spark, event("page_view", params=twice)).ga_session_id == 7


def test_parameter_array_may_be_null(spark):
    from visitloom.sources.events import EVENT_SCHEMA, flatten_events
    row = list(event("page_view"))
    row[5] = None
    assert flatten_events(spark.createDataFrame([tuple(row)], EVENT_SCHEMA)).count() == 0


@pytest.mark.parametrize("day, number, weekend", [("20231112", 1, 1), ("20231113", 2, 0), ("20231118", 7, 1)])
def test_weekend_is_sunday_and_saturday(spark, day, number, weekend):
    row = one(spark, event("page_view", day=day))
    assert (row.day_of_week, row.is_weekend) == (number, weekend)


def test_session_over_midnight_belongs_to_its_first_day(spark):
    row = one(spark, event("page_view", 0, day="20231114"), event("scroll", 9, day="20231115"))
    assert row.session_date == dt.date(2023, 11, 14)


def test_funnel_is_open(spark):
    sessions = sessionize(flat(
        spark, event("purchase", user="a"), event("purchase", user="b"), event("add_payment_info", user="a"),
        event("add_shipping_info", user="c")))
    rows = {r.stage: r for r in funnel(sessions).collect()}
    assert [rows[s].sessions for s in ("Visit", "Product View", "Payment Info", "Purchase")] == [3, 0, 1, 2]
    assert rows["Purchase"].stage_conversion == 2.0
    assert rows["Visit"].stage_conversion == 1.0 and rows["Visit"].drop_off is None
    assert rows["Add to Cart"].stage_conversion is None  # nothing reached the stage before
    assert rows["Purchase"].drop_off == -1
    assert funnel_transitions(sessions).count() == 5
    assert funnel_wide(sessions).first().visit_sessions == 3


def test_totals_of_an_empty_table(spark):
    sessions = sessionize(flat(spark, event("page_view", session=None)))
    row = core_totals(sessions).first()
    assert row.total_sessions == 0 and row.conversion_rate is None
    assert {r.kpi: r.value for r in kpis(sessions).collect()}["Sessions"] == 0.0


def test_purchase_at_the_end_of_the_window_is_not_a_late_purchase(spark):
    at = label_after_horizon(flat(spark, event("page_view"), event("purchase", 300 * SECOND))).first()
    after = label_after_horizon(flat(spark, event("page_view"), event("purchase", 300 * SECOND + 1))).first()
    assert (at.converted, after.converted) == (0, 1)


def test_early_window_includes_both_ends(spark):
    row = early_features(flat(
        spark, event("page_view", 0), event("scroll", 300 * SECOND, engagement=2000),
        event("scroll", 300 * SECOND + 1, engagement=9000))).first()
    assert (row.early_event_count, row.early_scrolls, row.early_engagement_seconds, row.session_hour) == (2, 1, 2.0, 22)


def test_session_without_allowed_early_events_has_no_row(spark):
    assert early_features(flat(spark, event("purchase"), event("page_view", 400 * SECOND))).count() == 0


def test_window_starts_with_an_excluded_event(spark):
    row = early_features(flat(spark, event("begin_checkout", 0), event("page_view", 200 * SECOND),
                              event("page_view", 301 * SECOND))).first()
    assert row.early_event_count == 1


def test_early_attributes_stay_null_and_skip_nulls(spark):
    row = early_features(flat(spark, event("page_view", 0, country=None), event("scroll", 1, country="C"))).first()
    assert row.country == "C" and row.device_category is None


def test_sessions_with_the_same_text_id_stay_apart(spark):
    rows = early_features(flat(spark, event("page_view", 0, user="a", session=-2),
                               event("page_view", 900 * SECOND, user="a-", session=2))).collect()
    assert [(r.session_id, r.early_event_count) for r in rows] == [("a--2", 1)] * 2


def test_input_order_does_not_matter(spark):
    events = [event("page_view", i % 3, user=f"u{i % 4}", event_id=i, source=f"s{i % 5}" if i % 2 else None)
              for i in range(60)]
    forward = sessionize(flat(spark, *events)).collect()
    backward = sessionize(flat(spark, *events[::-1]).repartition(5)).collect()
    assert sorted(forward) == sorted(backward)
