"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in ``spark.checkpoint.dir``; in local mode in a temporary one where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="gleaner-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows and bytes of a batch that goes to Python: texts can be long, and a worker holds a batch several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": (("10000",), "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (("268435456", "268435456b", "256MB", "256m"), str(4 << 20))}


def bound_batches(spark: SparkSession) -> None:
    """Smaller batches, where the session still has Spark's own sizes."""
    for key, (defaults, own) in BATCH.items():
        if spark.conf.get(key, defaults[0]) in defaults:
            spark.conf.set(key, own)


class Steps:
    """Written tables of one computation: each cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, shared_folder(spark, name), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:04d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
