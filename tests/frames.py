"""Small hand-made event frames."""

from visitloom.sources.events import EVENT_SCHEMA, flatten_events

SECOND = 1_000_000
START = 1_700_000_000 * SECOND  # 2023-11-14 22:13:20 UTC


def event(name, at=0, user="u", session=1, event_id=0, engagement=None, source=None, medium=None, device=None,
          system=None, country=None, transaction=None, revenue=None, day="20231114", params=None):
    """``at`` is in microseconds after START."""
    if params is None:
        params = [] if session is None else [("ga_session_id", (session,))]
        if engagement is not None:
            params.append(("engagement_time_msec", (engagement,)))
    return (day, START + at, event_id, name, user, params, (source, medium), (device, system), (country,),
            (transaction, revenue))


def flat(spark, *events):
    return flatten_events(spark.createDataFrame(list(events), EVENT_SCHEMA))
