"""Helpers of the training-data operators: tables, Arrow maps, hashed uniforms, bounded samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.session import checkpoint_dir, tune

ROWS = 512  # rows that a batch function gets at a time
LONGEST = 50_000  # characters of a text that a model may be fitted on: bounds what a sample brings to the driver
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write `df` once under the shared checkpoint folder and read it back.

    Cuts lineage on storage that every executor sees, and gives the planner the true size, so that
    small sides of later joins are broadcast by Spark's own byte threshold and large ones are not.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a batch function that `make` builds once per task.

    The function gets at most ROWS rows at a time, whatever the session's batch size: what it makes
    of a batch of long texts is many times their size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield fn(batch.slice(at, ROWS))

    return df.mapInArrow(run, schema)


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 5, is 0.  Null for a null doc_id, which counts as not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def uniform(seed: str, *cols: Column) -> Column:
    """Uniform double in [0, 1) from 52 bits of md5: the same in every run and in other SQL engines."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def stratified(rows: DataFrame, label: str, per_class: int, seed: str, *key: str) -> DataFrame:
    """About `per_class` rows of each label (all, where there are fewer), chosen by a hash of `key`.

    One counting pass; a table of a rate per label is joined, broadcast by its size.
    """
    rates = stored(rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.least(F.lit(1.0), per_class / F.count("*")).alias("rate")), "rates")
    chosen = uniform(seed, *[F.col(k) for k in key])
    return rows.join(rates, label).filter(chosen < F.col("rate")).select(rows.columns)


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """doc_id with its 0/1 label; null ids or labels and documents with contradicting rows are left out."""
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    both = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    return both.filter("label = other").select("doc_id", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, seed: str) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of about `per_class` labelled documents per class that are not held out.

    Ids and labels are joined first; whole texts are read for the chosen ids only, and of these the
    texts of at most LONGEST characters come to the driver.
    """
    ids = docs.filter(~held_out()).select("doc_id")
    chosen = stratified(one_label(labels, column).join(ids, "doc_id", "left_semi"), "label", per_class, seed, "doc_id")
    label = {r[0]: r[1] for r in chosen.collect()}
    if not label:
        return []
    texts = docs.filter(F.col("doc_id").isin(list(label)) & (F.length("text") <= LONGEST)).select("doc_id", "text")
    rows = {(r[0], r[1]): label[r[0]] for r in texts.collect()}
    return sorted((i, t, y) for (i, t), y in rows.items())
