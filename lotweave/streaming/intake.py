"""Pages arriving over time: the batch parse over a stream, with per-URL deduplication.

Parsing is page-local, so the stream runs the same plan as a batch.  The one state kept is which
URLs were seen within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotweave.functions import record
from lotweave.plans.pipeline import parse_pages

PAGE_SCHEMA = "page_id long, url string, html string, fetched_at timestamp"


def page_stream(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """New page files under a path; a URL seen again within the delay is dropped."""
    return (
        spark.readStream.schema(PAGE_SCHEMA).parquet(path)
        .withWatermark("fetched_at", delay)
        .dropDuplicatesWithinWatermark(["url"])
        .drop("fetched_at")
    )


def goals(pages: DataFrame, registry: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    parsed = parse_pages(pages, registry, answers)
    return parsed.select(
        "page_id", "url", "domain", "success", "parser_used", "confidence", "error",
        F.when(F.col("success"), record.goal_json(F.col("vehicle"))).alias("goal"),
    )


def run_intake(
    stream: DataFrame, registry: DataFrame, out_path: str, name: str, answers: DataFrame | None = None,
    once: bool = False, checkpoint: str | None = None,
) -> StreamingQuery:
    """Write goals of arriving pages; each micro-batch replaces its own folder, so a retry adds nothing.

    The stream's state lives under ``checkpoint`` or the session's spark.checkpoint.dir, which a
    restart must find again: one of the two is required.
    """
    folder = checkpoint or stream.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("a stream needs a checkpoint folder that outlives it")

    def write(batch: DataFrame, epoch: int) -> None:
        goals(batch, registry, answers).write.mode("overwrite").json(f"{out_path}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{folder.rstrip('/')}/{name}"
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
