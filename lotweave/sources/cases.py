"""Case requests and traces as sinks, and the outcome of posted cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_GOAL = "No valid goal data extracted from input"


def case_requests(traces: DataFrame, created_by: str = "lotweave") -> DataFrame:
    """Body to post for every trace that produced a goal."""
    goal = F.try_parse_json("final_goal")
    body = F.to_json(
        F.struct(
            goal.alias("goal_data"),
            F.struct(*[c for c in traces.columns if c != "final_goal"]).alias("source_trace"),
            F.lit(created_by).alias("created_by"),
            F.struct(
                F.try_variant_get(goal, "$._metadata.extraction_method", "string").alias("extraction_method"),
                F.try_variant_get(goal, "$._metadata.confidence", "double").alias("confidence"),
                F.unix_timestamp().alias("timestamp"),
            ).alias("processing_metadata"),
        )
    )
    return traces.where(F.col("final_goal").isNotNull()).select("request_id", body.alias("body"))


def case_outcome(status: Column, body: Column) -> tuple[Column, Column]:
    """(success, error) of a posted case."""
    ok = F.coalesce(status == 200, F.lit(False))
    error = F.concat(
        F.lit("API request failed with status "), status.cast("string"), F.lit(": "), F.coalesce(body, F.lit(""))
    )
    return ok, F.when(~ok, error)


def trace_output(traces: DataFrame) -> DataFrame:
    """Input, trace and case creation of each request, ready to be written as JSON."""
    has_goal = F.col("final_goal").isNotNull()
    return traces.select(
        "request_id", "input_value", "input_type",
        F.struct(*[c for c in traces.columns if c not in ("request_id", "input_value", "input_type")]).alias("trace"),
        F.struct(
            F.when(~has_goal, F.lit(False)).alias("success"), F.when(~has_goal, F.lit(NO_GOAL)).alias("error"),
            (~has_goal).alias("skipped"),
        ).alias("case_creation"),
    )


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
