"""Sessions and profiles that grow by days, against one run over everything."""

import datetime as dt
import os

import pytest
from frames import SECOND, event, flat
from pyspark.sql import functions as F

from visitloom.operators import monitoring
from visitloom.operators.incremental import SessionStore
from visitloom.operators.sessions import sessionize

DAY = 86_400 * SECOND
DAYS = ["20231114", "20231115", "20231116"]


def log():
    """Per day, its events. Session 1 of u runs over midnight, session 2 over three days; a user is null."""
    first = [event("page_view", 0, event_id=1, source="a", engagement=5), event("purchase", 10, event_id=2, transaction="T1", revenue=2.5),
             event("page_view", 20, "v", event_id=3), event("scroll", 5, session=2, event_id=4), event("scroll", 6, None, event_id=5)]
    second = [event("purchase", DAY, event_id=6, transaction="T1", revenue=1.0, country="C", day=DAYS[1]),
              event("view_item", DAY + 5, session=2, event_id=7, source="late", day=DAYS[1]),
              event("page_view", DAY + 9, "w", event_id=8, day=DAYS[1])]
    third = [event("add_to_cart", 2 * DAY, session=2, event_id=9, medium="m", day=DAYS[2]),
             event("page_view", 2 * DAY, "x", event_id=10, day=DAYS[2])]
    return dict(zip(DAYS, (first, second, third)))


def rows(df):
    return sorted(map(str, df.collect()))


def update(spark, store, events, days):
    store.update(flat(spark, *[e for d in days for e in events[d]]) if any(events[d] for d in days)
                 else flat(spark, event("page_view")).limit(0), days)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_days_one_by_one_equal_one_run(spark, tmp_path, order):
    events, store = log(), SessionStore(spark, str(tmp_path / "store"))
    for n in order:
        update(spark, store, events, [DAYS[n]])
    want = rows(sessionize(flat(spark, *[e for d in DAYS for e in events[d]])).select(*store.read().columns))
    assert rows(store.read()) == want and len(want) == 6
    update(spark, store, events, [DAYS[1]])  # again
    assert rows(store.read()) == want


def test_events_that_come_late_or_go(spark, tmp_path):
    events, store = log(), SessionStore(spark, str(tmp_path / "store"))
    update(spark, store, events, DAYS[1:])
    assert {str(r.session_date) for r in store.read().collect()} == {"2023-11-15", "2023-11-16"}
    events[DAYS[0]].append(event("page_view", 1, "w", event_id=11))
    update(spark, store, events, DAYS[:1])  # every session of the 15th turns out to have begun on the 14th
    assert not os.path.exists(tmp_path / "store/sessions/session_date=2023-11-15")
    everything = [e for d in DAYS for e in events[d]]
    assert rows(store.read()) == rows(sessionize(flat(spark, *everything)).select(*store.read().columns))
    events[DAYS[2]] = []  # the day is run again and holds nothing any more
    update(spark, store, events, DAYS[2:])
    assert rows(store.read()) == rows(sessionize(flat(spark, *events[DAYS[0]], *events[DAYS[1]])).select(*store.read().columns))
    with pytest.raises(ValueError, match="other days"):
        update(spark, store, {DAYS[0]: events[DAYS[1]]}, DAYS[:1])


def test_update_leaves_other_folders_alone(spark, tmp_path):
    events, store = log(), SessionStore(spark, str(tmp_path / "store"))
    update(spark, store, events, DAYS[:2])
    folder = tmp_path / "store/sessions/session_date=2023-11-14"
    before = sorted(os.listdir(folder))
    alone = {"20231120": [event("page_view", 6 * DAY, "z", event_id=20, day="20231120")]}
    update(spark, store, alone, ["20231120"])
    assert sorted(os.listdir(folder)) == before and store.read().count() == 6


def test_any_two_periods_from_one_profile(spark, tmp_path):
    days = [dt.date(2024, 1, 1 + i) for i in range(6)]
    table = spark.createDataFrame([(days[i % 6], ["x", "y", None][i % 3 if i % 6 < 3 else i % 2], i % 2) for i in range(200)],
                                  "session_date date, a string, b int")
    path = str(tmp_path / "profile")
    for some in (days[4:], days[:2], days[2:4], days[1:5]):
        monitoring.write_profile(monitoring.daily_profile(table.where(F.col("session_date").isin(*some)), ("a", "b")), path, some)
    for before, after in ((0, 2), (3, 5)), ((0, 5), (0, 5)), ((5, 5), (1, 1)):
        periods = monitoring.profile_periods(
            monitoring.read_profile(spark, path), (days[before[0]], days[before[1]]), (days[after[0]], days[after[1]]))
        sides = [table.where(F.col("session_date").between(days[x], days[y])) for x, y in (before, after)]
        assert rows(monitoring.coverage_of(periods)) == rows(monitoring.input_coverage(*sides, ("a", "b")))
        plain = {r.column: r.stability_index for r in monitoring.feature_drift(*sides, ("a", "b")).collect()}
        assert {r.column: r.stability_index for r in monitoring.drift_of(periods).collect()} == pytest.approx(plain, abs=1e-12)
