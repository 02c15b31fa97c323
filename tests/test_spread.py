from pyspark.sql import functions as F

from gridlens.operators import boosting
from test_boosting import corners, rows as labelled


def test_rows_of_one_partition_are_learned_from_by_all_tasks(spark, monkeypatch):
    used, grow = [], boosting.BoostedTrees._grow

    def seen(self, blocks, *a):
        used.append((blocks.select(F.spark_partition_id()).distinct().count(), blocks.agg(F.sum("n")).first()[0]))
        return grow(self, blocks, *a)

    monkeypatch.setattr(boosting, "BLOCK", 16)
    monkeypatch.setattr(boosting.BoostedTrees, "_grow", seen)
    df = labelled(spark, *corners(200, 1), parts=1)
    boosting.BoostedTrees(maxIter=1, maxDepth=1).fit(df.union(df.where("id < 0").repartition(9)))  # one full partition, nine empty ones
    assert used == [(spark.sparkContext.defaultParallelism, 200)]
