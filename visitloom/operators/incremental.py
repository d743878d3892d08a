"""A session table that grows by days: new days are read, and only the day folders that they touch are written.

Beside the sessions a store keeps their first-level aggregate by event day (the steps of :mod:`sessions`), which merges
exactly: counts and sums add up, times and first values have a smallest. An update reads the events of its days alone. It finds
the sessions that these days touch, now or in an earlier run of them, takes the steps of these sessions from all days on which
they have any, and computes the sessions anew; so sessions over midnight, late events and events that went are right.

The folders of sessions are written before the steps of the new days. An update that dies in between is run again with the same
result, since the old steps still say which sessions it touched.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.operators.sessions import SESSION_KEY, merge_steps, session_steps, sessions_of_steps
from visitloom.sources.tables import SESSION_SCHEMA, read_sessions
from visitloom.sources.workspace import materialize
from visitloom.spec import DATE, DEFAULT_SPEC, SessionSpec

EVENT_DAY = "event_date"


def replace_folders(rows: DataFrame, path: str, column: str, values: list) -> None:
    """The folders ``column=value`` of the table under ``path`` get the rows given, and go where there are none; other folders
    are left alone."""
    rows.hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    there = {str(r[0]) for r in rows.select(column).distinct().collect()}  # one row for each folder
    spark = rows.sparkSession
    for value in {str(v) for v in values} - there:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _same_session(left: DataFrame, right: DataFrame):
    same = F.lit(True)
    for c in SESSION_KEY:
        same = same & left[c].eqNullSafe(right[f"touched_{c}"])
    return same


class SessionStore:
    """Sessions under ``path``/sessions by session date, their steps under ``path``/steps by event day."""

    def __init__(self, spark: SparkSession, path: str, spec: SessionSpec = DEFAULT_SPEC):
        self.spark, self.path, self.spec = spark, path, spec

    def read(self) -> DataFrame:
        return read_sessions(self.spark, f"{self.path}/sessions")

    def _stored(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def update(self, flat: DataFrame, days: list[str]) -> None:
        """``flat``: all events of ``days`` (YYYYMMDD) and of no other day. These days' events replace what the store had of them."""
        new = materialize(session_steps(flat, self.spec, (EVENT_DAY,)), "new-steps")
        if strangers := [r[0] for r in new.where(~F.col(EVENT_DAY).isin(days)).select(EVENT_DAY).distinct().limit(5).collect()]:
            raise ValueError(f"events of other days than {days}: {strangers}")
        old = self._stored("steps", new.schema)
        keys = [F.col(c).alias(f"touched_{c}") for c in SESSION_KEY]
        touched = materialize(
            new.select(*keys).union(old.where(F.col(EVENT_DAY).isin(days)).select(*keys)).distinct(), "touched-sessions")
        # Keys and days alone say which day folders hold anything of these sessions.
        known = old.select(*SESSION_KEY, EVENT_DAY)
        involved = [r[0] for r in known.join(touched, _same_session(known, touched), "left_semi").select(
            EVENT_DAY).distinct().collect()]  # days
        kept = old.where(F.col(EVENT_DAY).isin(involved) & ~F.col(EVENT_DAY).isin(days))
        kept = kept.join(touched, _same_session(kept, touched), "left_semi")
        again = sessions_of_steps(merge_steps(kept.unionByName(new), self.spec), self.spec)
        # A session's date is one of the days on which it has events.
        dates = [F.to_date(F.lit(d), "yyyyMMdd") for d in sorted({*involved, *days})]
        stored = self._stored("sessions", SESSION_SCHEMA).where(F.col(DATE).isin(*dates))
        others = stored.join(touched, _same_session(stored, touched), "left_anti")
        columns = SESSION_SCHEMA.fieldNames()
        whole = materialize(others.select(*columns).unionByName(again.select(*columns)), "sessions-of-days")
        replace_folders(whole, f"{self.path}/sessions", DATE, [f"{d[:4]}-{d[4:6]}-{d[6:]}" for d in {*involved, *days}])
        replace_folders(new, f"{self.path}/steps", EVENT_DAY, days)
