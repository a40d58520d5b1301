"""The data model, and views that read the test tables as intents, vectors and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTCOME = T.StructType([T.StructField("status", T.IntegerType()), T.StructField("latency_ns", T.LongType()), T.StructField("exit_code", T.IntegerType())])
CONTEXT = T.StructType([T.StructField("cwd", T.StringType()), T.StructField("env_hash", T.DecimalType(20, 0)), T.StructField("session_id", T.DecimalType(20, 0)), T.StructField("shell", T.StringType()), T.StructField("user", T.StringType())])
INTENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("ts_ns", T.LongType(), False),
        T.StructField("raw_command", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
        T.StructField("context_hash", T.DecimalType(20, 0)),
        T.StructField("context", CONTEXT),
        T.StructField("parent_ids", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.FloatType()),
        T.StructField("category", T.StringType()),
        T.StructField("outcome", OUTCOME),
    ]
)
EDGES = T.StructType([T.StructField("from_id", T.LongType()), T.StructField("to_id", T.LongType()), T.StructField("relation", T.IntegerType()), T.StructField("weight", T.DoubleType())])

#: Codes of outcome states and of edge relations.
STATUS = {"pending": 0, "success": 1, "failure": 2, "partial": 3}
RELATION = {"causal": 0, "temporal": 1, "dependency": 2, "retry": 3, "branch": 4}


class IntentError(Exception):
    """Base of this library's errors."""


class SegmentNotFound(IntentError):
    pass


class SegmentCorrupted(IntentError):
    pass


class NodeNotFound(IntentError):
    pass


class DimensionMismatch(IntentError):
    pass


class ExtractionFailed(IntentError):
    pass


class CycleDetected(IntentError):
    pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as intents: the type is the command, the value its latency."""
    status = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "view", 0).otherwise(1)
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.col("event_type").alias("raw_command"),
        F.col("user_id").alias("session_id"),
        F.get_json_object("props", "$.k").cast("long").alias("env"),
        status.alias("status"),
        F.round(F.col("value") * 1e6).cast("long").alias("latency_ns"),
    )
    return df.withColumn("exit_code", F.when(F.col("status") == 2, 1 + F.col("env") % 127).otherwise(F.lit(0)))


EVENTS_SQL = """(SELECT *, CASE WHEN status = 2 THEN 1 + env % 127 ELSE 0 END AS exit_code FROM (
  SELECT event_id AS id, epoch_us(ts) * 1000 AS ts_ns, event_type AS raw_command, user_id AS session_id,
         CAST(json_extract(props, '$.k') AS BIGINT) AS env,
         CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 0 ELSE 1 END AS status,
         CAST(round(value * 1e6) AS BIGINT) AS latency_ns FROM events))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings in arrival order, as doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


VECTORS_SQL = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
