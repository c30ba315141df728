"""Joins of page-sized rows: sizes of a smaller side are left to the planner, skew is the caller's to name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(
    big: DataFrame, small: DataFrame, on: str, salt_by: str, how: str = "inner", salts: int = 1
) -> DataFrame:
    """Join ``big`` to ``small`` on a key of which ``small`` has one row per value.

    Spark broadcasts the small side below its byte threshold, at plan time or by AQE, and else
    shuffles, splitting skewed keys.  With ``salts`` over 1 both sides are spread over the key and a
    salt, so that a key holding a third of ``big`` fills many tasks in any case.  The salt is a hash
    of a column, never random, so a retried task gives the same rows.
    """
    if salts == 1:
        return big.join(small, on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def page_join(pages: DataFrame, rows: DataFrame, how: str = "left") -> DataFrame:
    """Join of two sides that both grow with the pages, on ``page_id``: neither is ever broadcast.

    The planner takes a text for 20 bytes and an array for one item, and does not count what a generated
    column adds, so a side of a gigabyte may seem to be under the broadcast threshold; all of it would then
    pass through the driver.  Sides dealt by ``page_id`` alike do not move.
    """
    return pages.join(rows.hint("merge"), "page_id", how)


def keep_wanted(big: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """Rows of ``big`` whose key is wanted: a semi join on the distinct keys.

    Few keys are broadcast by their size, so that rows nobody asks for are never shuffled.
    """
    keys = wanted.select(on).where(F.col(on).isNotNull()).distinct()
    return big.join(keys, on, "left_semi")
