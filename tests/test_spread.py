"""Page work is dealt to all cores, whatever the tables' files; intermediate tables never go to one machine's folder."""

import pytest
from pyspark.sql import functions as F

from lotweave import session
from lotweave.registry import corpus

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("of", [corpus.listing_pages, corpus.driver_pages, corpus.listings])
def test_every_core_gets_a_share(spark, of):
    counts = [r["count"] for r in of(spark, SF).groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == spark.sparkContext.defaultParallelism
    assert max(counts) < 2 * sum(counts) / len(counts)


def test_rows_of_many_files_are_left_where_they_are(spark, tmp_path):
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "many"))
    rows = spark.read.parquet(str(tmp_path / "many"))
    assert session.spread(rows, "id") is rows


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
