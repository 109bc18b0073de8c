"""Tables that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str | None:
    """This application's intermediate tables: in the shared folder that ``spark.checkpoint.dir`` names."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared}/stages-{spark.sparkContext.applicationId}" if shared else None


def settled(df: DataFrame) -> DataFrame:
    """df computed now, once: written to the shared folder, so that a lost executor costs no recomputation; persisted where no folder is named."""
    spark = df.sparkSession
    if (own := folder(spark)) is None:
        return df.persist()
    path = f"{own}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder for what a job keeps besides tables; without a shared folder one of this machine, which only a local session may use."""
    own = folder(spark)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="pairlattice-")
    return f"{own}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession) -> None:
    """Delete the tables written by ``settled``, once results are read or written elsewhere."""
    if own := folder(spark):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
