"""Session settings and shared scratch space."""

from __future__ import annotations

import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "jobmetrics", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for. What was submitted with the application still wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.compress": "true",
    }
    submitted = SparkConf()
    given = {key: value for key, value in settings.items() if not submitted.contains(key)}
    for key, value in {**given, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir, else one under the warehouse, which executors share too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nobody has used yet."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage; survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint(eager=True)


class Stage:
    """Tables in the shared folder that cut lineage, and of which later steps read only the columns they need.

    ``drop`` removes those that nothing reads any more. What a returned DataFrame still reads stays; it lies under
    ``root`` and is the owner's to remove.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, scratch_path(spark, name), {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
