"""The engine: a store of intents and its graph, behind ingest, find, replay, status and insights."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentdeck.functions.text import DIM, embed_numpy, shell_words
from intentdeck.operators import graph, insight, knn
from intentdeck.operators.store import IntentStore, extract
from intentdeck.schemas import CONTEXT, EDGES, ExtractionFailed

#: Edges of a new intent.
LINKS = 5


class Engine:
    """Intents at a path. seq is the order of arrival and the node of the graph; id is the intent's uuid."""

    def __init__(self, spark: SparkSession, path: str, dim: int = DIM):
        self.spark, self.path, self.store = spark, path.rstrip("/"), IntentStore(spark, dim, path)

    def _edges(self) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/edges")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], EDGES)
            raise

    def ingest_many(self, commands: list[tuple[str, dict | None]], status: list[int] | None = None) -> list[str]:
        """Ingest a batch in order; an empty command rejects the batch. Edges are formed against history and earlier rows of the batch."""
        if any(not c.strip() or not shell_words(c) for c, _ in commands):
            raise ExtractionFailed("empty command")
        rows = self.store.rows()
        first = 0 if rows is None else (rows.agg(F.max("seq")).first()[0] + 1)
        now = time.time_ns()
        blank = {"cwd": "", "env_hash": 0, "session_id": 0, "shell": "", "user": ""}
        made = [(str(uuid.uuid4()), first + k, now + k, c, {**blank, **(ctx or {})}, (status or [0] * len(commands))[k]) for k, (c, ctx) in enumerate(commands)]
        from decimal import Decimal

        data = [(i, s, t, c, tuple(Decimal(x[n]) if n in ("env_hash", "session_id") else x[n] for n in ("cwd", "env_hash", "session_id", "shell", "user")), st) for i, s, t, c, x, st in made]
        df = self.spark.createDataFrame(data, f"id string, seq long, ts_ns long, raw_command string, context {CONTEXT.simpleString()}, status int")
        batch = extract(df).join(df.select("id", "seq", "status"), "id")
        history = None if rows is None else rows.select(F.col("seq").alias("id"), F.col("embedding").alias("v"))
        self.store.insert(batch)
        new = self.store.rows().where(F.col("seq") >= first).select(F.col("seq").alias("id"), F.col("embedding").alias("v"))
        edges = knn.form_edges(new, LINKS) if history is None else knn.form_edges_incremental(history.where(F.col("id") < first), new, LINKS)
        edges.write.mode("append").parquet(f"{self.path}/edges")
        return [m[0] for m in made]

    def ingest(self, command: str, context: dict | None = None) -> str:
        return self.ingest_many([(command, context)])[0]

    def find(self, query: str, k: int = 10) -> list[tuple[str, float]]:
        rows = self.store.rows()
        if rows is None:
            return []
        got = knn.search(rows.select("id", F.col("embedding").alias("v")), embed_numpy(query).tolist(), k)
        return [(r.id, r.similarity) for r in got.collect()]

    def plan(self, intent_id: str, depth: int = 3) -> DataFrame:
        """(level, intent_id, command, deps) of what an intent leads to, intent_id being its seq; an unknown id raises."""
        from intentdeck.schemas import NodeNotFound

        row = self.store.get(intent_id)
        if row is None:
            raise NodeNotFound(intent_id)
        rows = self.store.rows()
        return graph.replay(rows.select(F.col("seq").alias("node")), self._edges(), rows.select(F.col("seq").alias("id"), F.col("raw_command").alias("command")), row.seq, depth)

    def _seqs(self, ids: list[str]) -> DataFrame:
        rows = self.store.rows().select("seq", "id")
        return rows.where(F.col("id").isin(ids)).select(F.col("seq").alias("id"))

    def _named(self, plan: DataFrame) -> list:
        rows = self.store.rows()
        named = plan.join(rows.select(F.col("seq").alias("intent_id"), "id"), "intent_id").orderBy("level", "intent_id")
        return named.collect()

    def replay(self, intent_id: str, depth: int = 3) -> list[tuple[str, str, int]]:
        """(command, id, number of dependencies) in an order that respects dependencies; an unknown id raises."""
        return [(r.command, r.id, len(r.deps)) for r in self._named(self.plan(intent_id, depth))]

    def dry_run(self, intent_id: str, depth: int = 3, completed: list[str] = (), values: dict[str, str] | None = None) -> list[tuple[str, str, int]]:
        """replay() without the completed intents, with variables filled in."""
        got = graph.dry_run(self.plan(intent_id, depth), self._seqs(list(completed)), values or {})
        return [(r.command, r.id, len(r.deps)) for r in self._named(got)]

    def execute(self, intent_id: str, depth: int = 3, completed: list[str] = (), values: dict[str, str] | None = None, executor=None) -> list[tuple[str, str, bool, int]]:
        """(command, id, skipped, status) of every step, by graph.execute(): executor is a pure function, and without one steps stay pending."""
        got = graph.execute(self.plan(intent_id, depth), self._seqs(list(completed)), values, executor)
        return [(r.command, r.id, r.skipped, r.outcome.status) for r in self._named(got)]

    def status(self) -> tuple[int, int, int, int]:
        """Nodes, edges, distinct commands, dimension."""
        rows = self.store.rows()
        if rows is None:
            return 0, 0, 0, self.store.dim
        nodes, commands = rows.agg(F.count("*"), F.count_distinct("raw_command")).first()
        return nodes, self._edges().count(), commands, self.store.dim

    def insights(self, clusters: int = 5) -> list[tuple[str, str, float]]:
        rows = self.store.rows()
        if rows is None:
            return []
        r = rows.select(F.col("seq").alias("id"), "ts_ns", "raw_command", "status")
        v = rows.select(F.col("seq").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        return [(x.kind, x.description, x.confidence) for x in insight.insights(r, v, clusters).collect()]
