"""Tables between steps, in the folder that driver and executors share: they end lineage and outlive any executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own in local mode, where driver and executors are one
    process; on a cluster, whose machines don't see each other's folders, an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir isn't set: it names the folder that driver and executors share")
    if not hasattr(spark, "_strandlake_tables"):
        spark._strandlake_tables = "file://" + tempfile.mkdtemp(prefix="strandlake-")
    return spark._strandlake_tables


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the driver ends; the folder is only litter then
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read from there; the table is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandlake-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandlake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    delete(df.sparkSession, df._strandlake_path)
