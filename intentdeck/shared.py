"""Tables in the folder that driver and executors share, for loops and results that are read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset (tests, one machine) a new local folder."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = "file://" + tempfile.mkdtemp(prefix="intentdeck-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def materialize(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
