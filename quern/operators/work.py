"""Work tables: rows written once to the folder that all executors share, so that later joins don't compute them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_place(spark: SparkSession) -> str:
    """A new place below spark.checkpoint.dir. Only a local master without that setting gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named := tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return f"{named}/quern-work/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder that all executors share: no lineage, known sizes."""
    spark, place = df.sparkSession, work_place(df.sparkSession)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key that tells them apart: a table with short rows comes in a few splits, however long the work on a row takes."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def bound(value: Column, then) -> Column:
    """then(value), with the value worked out once however often `then` names it: higher-order functions don't share what they have in common."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def clear(spark: SparkSession) -> bool:
    """Remove this application's work tables, once its results are written; whether there were any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_place(spark)).getParent()
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
