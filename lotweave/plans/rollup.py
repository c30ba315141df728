"""Yield and success rates kept as partial states that merge, so that no page is read twice.

A state is a row per batch and group with counts and sums only.  Batches replace themselves, so a
repeated job changes nothing, and any set of batches is merged by adding up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

YIELD_STATE = "domain string, parser_used string, pages long, fields_found long, successes long, batch int"
RATE_STATE = "site_id string, tests long, successes long, batch int"
NAMES = ("vin", "year", "make", "model", "price", "mileage", "color", "dealer_name", "dealer_phone")
LISTS = ("features", "images")


def fields_filled(vehicle: Column) -> Column:
    """How many of a vehicle's main fields have a value; a null vehicle has none."""
    filled = [F.coalesce(vehicle[f].isNotNull(), F.lit(False)).cast("int") for f in NAMES]
    filled += [F.coalesce(F.size(vehicle[f]) > 0, F.lit(False)).cast("int") for f in LISTS]
    return reduce(lambda a, b: a + b, filled)


def yield_state(parsed: DataFrame) -> DataFrame:
    """Partial state of the yield of parse results: one row per domain and parser."""
    counted = parsed.withColumn("_n", fields_filled(F.col("vehicle")))
    return counted.groupBy("domain", "parser_used").agg(
        F.count("*").alias("pages"), F.sum("_n").alias("fields_found"), F.count_if("success").alias("successes")
    )


def merged_yield(states: DataFrame) -> DataFrame:
    """Pages and mean share of filled fields per domain and parser, over all given states."""
    whole = states.groupBy("domain", "parser_used").agg(*[F.sum(c).alias(c) for c in ("pages", "fields_found", "successes")])
    coverage = F.col("fields_found") / (F.col("pages") * (len(NAMES) + len(LISTS)))
    return whole.select("domain", "parser_used", "pages", "fields_found", coverage.alias("coverage"), "successes")


def rate_state(results: DataFrame) -> DataFrame:
    """Partial state of success rates of schema tests: one row per site."""
    return results.groupBy("site_id").agg(F.count("*").alias("tests"), F.count_if("success").alias("successes"))


def merged_rates(states: DataFrame) -> DataFrame:
    """Tests, successes and their share per site, over all given states."""
    whole = states.groupBy("site_id").agg(F.sum("tests").alias("tests"), F.sum("successes").alias("successes"))
    return whole.withColumn("success_rate", F.col("successes") / F.col("tests"))


class Rollup:
    """States by batch under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def put(self, state: DataFrame, batch: int) -> None:
        """Store a batch's state; the batch's earlier one goes."""
        state.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def states(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """States of all batches, or of those from `first` to `last`: other folders are not opened."""
        try:
            rows = self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            rows = self.spark.createDataFrame([], self.schema)
        if first is not None:
            rows = rows.where(F.col("batch") >= first)
        return rows if last is None else rows.where(F.col("batch") <= last)
