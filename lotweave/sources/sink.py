"""A sink that takes every key once: files by batch, and a manifest of what counts.

Rows go out as JSON through Spark's own file commit, so a task that is tried again leaves no second
file.  The keys of a batch count once its manifest is there, which is written after its rows: a job
that ends half-way leaves files that nobody reads.  A repeated job finds its keys in the manifest and
adds nothing, whatever its rows look like by then; a batch that is written again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class OnceSink:
    """Rows with a key column under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str = "request_id", key_type: str = "long") -> None:
        self.spark, self.path, self.key, self.key_type = spark, path.rstrip("/"), key, key_type

    def _read(self, read, part: str, schema: str) -> DataFrame:
        try:
            return read(f"{self.path}/{part}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """(key, batch, file) of all rows that count; the file is the name of the row's own."""
        schema = f"{self.key} {self.key_type}, file string, batch int"
        return self._read(self.spark.read.schema(schema).parquet, "manifest", schema)

    def _data(self, schema: str) -> DataFrame:
        return self._read(self.spark.read.schema(f"{schema}, batch int").json, "rows", f"{schema}, batch int")

    def write(self, rows: DataFrame, batch: int) -> None:
        """Add the rows whose keys are new; of rows with one key, one counts.  Rows without a key are refused."""
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        known = self.manifest().where(F.col("batch") != batch).select(self.key)
        checked = rows.withColumn(self.key, F.coalesce(self.key, F.raise_error(F.lit(f"a row without {self.key}")).cast(self.key_type)))
        fresh = checked.join(known, self.key, "left_anti").dropDuplicates([self.key])
        fresh.write.mode("overwrite").json(f"{self.path}/rows/batch={batch}")
        # the manifest names what is in the files, not what the plan would give if it ran again
        schema = f"{self.key} {self.key_type}"
        kept = self.spark.read.schema(schema).json(f"{self.path}/rows/batch={batch}").select(self.key, F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
        kept.write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")

    def read(self, schema: str) -> DataFrame:
        """The rows that count (schema: their columns, the key among them), with their batch."""
        counted = self.manifest().select(self.key, "batch")
        return self._data(schema).join(counted, [self.key, "batch"], "left_semi")
