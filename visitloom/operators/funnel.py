"""Six-stage open funnel: stages are counted independently, so a stage may exceed the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions.scalar import ratio
from visitloom.spec import DEFAULT_SPEC, SessionSpec


def funnel_wide(sessions: DataFrame, spec: SessionSpec = DEFAULT_SPEC) -> DataFrame:
    """All stage counts in one row."""
    return sessions.agg(*[
        (F.count(F.lit(1)) if flag is None else F.count_if(F.col(flag) == 1)).alias(name)
        for _, flag, name in spec.stages])


def _steps(sessions: DataFrame, spec: SessionSpec) -> DataFrame:
    """(stage_no, stage, sessions, previous): the one-row funnel laid out as rows, without a shuffle or window."""
    names = [name for _, _, name in spec.stages]
    rows = [
        F.struct(F.lit(i + 1).alias("stage_no"), F.lit(stage).alias("stage"), F.col(name).alias("sessions"),
                 (F.col(names[i - 1]) if i else F.lit(None).cast("long")).alias("previous"))
        for i, (stage, _, name) in enumerate(spec.stages)]
    return funnel_wide(sessions, spec).select(F.inline(F.array(*rows)))


def funnel(sessions: DataFrame, spec: SessionSpec = DEFAULT_SPEC) -> DataFrame:
    """Stage, sessions, share of the previous stage (1.0 for the first), and sessions lost since the previous stage."""
    return _steps(sessions, spec).select(
        "stage_no", "stage", "sessions",
        F.when(F.col("stage_no") == 1, F.lit(1.0)).otherwise(ratio("sessions", "previous")).alias("stage_conversion"),
        (F.col("previous") - F.col("sessions")).alias("drop_off"),
    )


def funnel_transitions(sessions: DataFrame, spec: SessionSpec = DEFAULT_SPEC) -> DataFrame:
    """Conversion between neighbouring stages, four decimals."""
    labels = F.array(*[F.lit(t) for t in spec.transitions])
    return _steps(sessions, spec).where("stage_no > 1").select(
        F.get(labels, F.col("stage_no") - 2).alias("transition"),
        F.round(ratio("sessions", "previous"), 4).alias("conversion_rate"),
    )
