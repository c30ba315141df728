"""Pages and model answers that arrive apart: a weak page waits for its answer, then goes on without.

Both streams have watermarks.  A page whose own parse is strong enough goes through at once.  A weak one
stays in the join's state, as a slim row without its body, until an answer comes or the wait is over; an
answer that came before its page waits in the same way.  What the join gives is settled as in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.functions import record
from lotweave.plans import model
from lotweave.plans.pipeline import answered_vehicles, first_parse, settled

ANSWER_SCHEMA = "page_id long, model_used string, tokens_used int, response string, answered_at timestamp"


def answer_stream(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """New answer files under a path, the first answer of each page within the delay."""
    return (
        spark.readStream.schema(ANSWER_SCHEMA).parquet(path)
        .withWatermark("answered_at", delay)
        .dropDuplicatesWithinWatermark(["page_id"])
    )


def with_late_answers(
    pages: DataFrame, answers: DataFrame, registry: DataFrame, wait: str = "30 minutes", early: str = "30 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Results of a stream of pages (page_id, url, html, fetched_at) with a stream of answers (ANSWER_SCHEMA).

    An answer counts if it came at most ``early`` before and ``wait`` after its page.  ``delay`` is how far
    behind rows of the pages may come; the answers bring their own watermark.  One row per page, in no
    order: a weak page without an answer comes out when both watermarks have passed its wait.
    """
    first = first_parse(pages.withWatermark("fetched_at", delay), registry, "fetched_at")
    given = answered_vehicles(model.parse_answers(answers), "answered_at")
    near = F.col("answered_at").between(F.col("fetched_at") - F.expr(f"INTERVAL {early}"), F.col("fetched_at") + F.expr(f"INTERVAL {wait}"))
    joined = first.join(given, F.col("weak") & (F.col("page_id") == F.col("_page")) & near, "leftOuter")
    return settled(joined.withColumn("has_ai", F.coalesce("_ok", F.lit(False))), "fetched_at")


def goals_of(results: DataFrame) -> DataFrame:
    goal = F.when(F.col("success"), record.goal_json(F.col("vehicle")))
    return results.select("page_id", "url", "domain", "success", "parser_used", "confidence", "error", goal.alias("goal"))
