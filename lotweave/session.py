"""Session settings.  A cluster's own settings win; these only fill what is unset."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Arrow batches are bounded in rows and bytes: a page body may be megabytes, so the default of
# 10 000 rows per batch could be gigabytes in one Python worker.
_RUNTIME = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "33554432",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply runtime settings the page jobs rely on, unless the session sets its own."""
    given = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, value in _RUNTIME.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of rows that come from fewer files than there are cores.

    Page work is heavy per row, so a table in one small file would keep a single task busy.  A
    large table has more files than cores and is left as it is: no shuffle.  With keys, rows are
    dealt by their hash, the same way in every run.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if len(rows.inputFiles()) < cores else rows


def literal_rows(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A few fixed rows as a table whose small size the planner knows, so that joins broadcast it."""
    items = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; a folder of this machine only on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="lotweave-ckpt-")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table written once under the shared checkpoint folder: computed once, safe from lost executors."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cpus: int | str = 8, app: str = "lotweave") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus if str(cpus).isdigit() else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no stack capture per call
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
