"""Connected components by least labels with pointer jumping; each round is a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and has no other executors."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp()}"
    return top.rstrip("/")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each component; rows of ``edges`` need no order."""
    spark = edges.sparkSession
    top = shared_dir(spark)
    n, run = 0, uuid.uuid4().hex

    def kept(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        path = f"{top}/components-{run}/{n}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = kept(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = kept(step.join(up, "label", "left").select("node", "was", F.least("label", "up").alias("label")))
        if not new.filter("was <> label").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
