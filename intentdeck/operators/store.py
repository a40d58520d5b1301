"""The intent store over tables: insert, lookup, semantic and temporal queries, late outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intentdeck.functions.hashing import Bloom, context_hash
from intentdeck.functions.text import classify_udf, embed_udf
from intentdeck.operators import knn
from intentdeck.schemas import DimensionMismatch, ExtractionFailed

CONFIDENCE = 1.0
#: Ids of a segment that shares a Bloom filter: the hot capacity of the original's simulation.
SEGMENT_IDS = 10_000


def is_empty(raw: Column) -> Column:
    """Whether a command is null, all white space, or without a word (only empty quotes, an open quote or a trailing backslash)."""
    return F.coalesce(~F.rlike(raw, F.lit(r"(?U)\S")) | F.rlike(raw, F.lit(r"^(?:[ \t\n]|''|\"\")*(?:'|\"|\\)?\z")), F.lit(True))


def extract(commands: DataFrame) -> DataFrame:
    """Intent columns from (id, ts_ns, raw_command, context): embedding, category, context hash. Empty commands are left to rejected()."""
    c = F.col("context")
    ok = commands.where(~is_empty(F.col("raw_command")))
    return ok.select(
        "id",
        "ts_ns",
        "raw_command",
        embed_udf("raw_command").alias("embedding"),
        context_hash(c["cwd"], c["env_hash"], c["session_id"], c["shell"], c["user"]).alias("context_hash"),
        "context",
        F.array().cast("array<string>").alias("parent_ids"),
        F.lit(CONFIDENCE).cast("float").alias("confidence"),
        classify_udf("raw_command").alias("category"),
    )


def rejected(commands: DataFrame) -> DataFrame:
    return commands.where(is_empty(F.col("raw_command")))


def temporal_range(rows: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """start <= ts_ns < end in time order; the condition is pushed into the scan."""
    return rows.where((F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns)).orderBy("ts_ns", "id")


def recent_ids(rows: DataFrame, most: int = 1000, dropped: int = 500) -> DataFrame:
    """(id) of the bounded list of latest rows, newest first: whenever it exceeds ``most`` the oldest ``dropped`` go, so its length follows from the number of rows."""
    n = rows.count()
    length = n if n <= most else most + 1 - dropped + (n - most - 1) % dropped
    return rows.orderBy(F.desc("ts_ns"), F.desc("id")).limit(length).select("id")


def attach_outcomes(intents: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intents with their latest outcome, outcomes of unknown ids). outcomes: id, status, latency_ns, exit_code, seq."""
    last = outcomes.groupBy("id").agg(F.max_by(F.struct("status", "latency_ns", "exit_code"), "seq").alias("outcome"))
    return intents.drop("outcome").join(last, "id", "left"), outcomes.join(intents.select("id"), "id", "left_anti")


def segment_members(ids: DataFrame, member, per_segment: int = SEGMENT_IDS) -> DataFrame:
    """For each id: its rows (n), whether it is a member, and whether its segment's filter may hold it. Null ids are no members.

    A segment is a range of ids, with one filter over its members; an id meets its own segment's filter only, so a group is bounded at any size.
    """
    known = ids.groupBy("id").agg(F.count("*").alias("n")).withColumn("member", F.coalesce(member, F.lit(False)) & F.col("id").isNotNull())

    def probe(rows):
        import pandas as pd

        keys = [None if pd.isna(k) else int(k).to_bytes(16, "big", signed=True) for k in rows["id"]]
        held = [k for k, m in zip(keys, rows["member"], strict=True) if m]
        bloom = Bloom(max(1, len(held)))
        for k in held:
            bloom.insert(k)
        return rows[["id", "n", "member"]].assign(may=[k is not None and bloom.contains(k) for k in keys])

    return known.withColumn("_segment", F.floor(F.col("id") / per_segment)).groupBy("_segment").applyInPandas(probe, "id long, n long, member boolean, may boolean")


class IntentStore:
    """A table of intents at a path (append-only Parquet), or in memory when path is None."""

    def __init__(self, spark: SparkSession, dim: int = 384, path: str | None = None):
        self.spark, self.dim, self.path, self.held = spark, dim, path, None

    def rows(self) -> DataFrame | None:
        if self.path is None:
            return self.held
        try:
            return self.spark.read.parquet(f"{self.path}/intents")
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def insert(self, intents: DataFrame) -> None:
        """Append; a row of another dimension raises DimensionMismatch and nothing is written."""
        if not intents.where(F.coalesce(F.size("embedding"), F.lit(-1)) != self.dim).isEmpty():
            raise DimensionMismatch(f"expected {self.dim}")
        if self.path is None:
            self.held = intents if self.held is None else self.held.unionByName(intents, allowMissingColumns=True)
        else:
            intents.write.mode("append").parquet(f"{self.path}/intents")

    def ingest(self, commands: DataFrame) -> None:
        if not rejected(commands).isEmpty():
            raise ExtractionFailed("empty command")
        self.insert(extract(commands))

    def get(self, id_):
        rows = self.rows()
        return None if rows is None else rows.where(F.col("id") == id_).first()

    def query_semantic(self, embedding: list[float], k: int) -> DataFrame:
        if len(embedding) != self.dim:
            raise DimensionMismatch(f"expected {self.dim}, got {len(embedding)}")
        rows = self.rows()
        if rows is None:
            return self.spark.createDataFrame([], "id string, similarity double, distance double")
        return knn.search(rows.select("id", F.col("embedding").alias("v")), embedding, k)

    def query_temporal(self, start_ns: int, end_ns: int) -> DataFrame | None:
        rows = self.rows()
        return None if rows is None else temporal_range(rows, start_ns, end_ns)

    def attach_outcome(self, outcomes: DataFrame) -> DataFrame:
        """The rows with outcomes attached; unknown ids raise."""
        known, unknown = attach_outcomes(self.rows(), outcomes)
        if not unknown.isEmpty():
            from intentdeck.schemas import NodeNotFound

            raise NodeNotFound(str([r["id"] for r in unknown.select("id").limit(5).collect()]))
        return known
