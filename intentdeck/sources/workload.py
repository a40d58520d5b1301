"""Generated command histories of four kinds of work; row k is the same wherever it is made."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class Vertical:
    user: str
    cwd: str
    env_hash: int
    success: float
    failure: float
    least_ns: int
    most_ns: int
    verbs: tuple[str, ...]
    objects: tuple[str, ...]
    probes: tuple[str, ...] = ()


#: User, folder, environment, shares of success and failure (the rest is partial) and latencies of each kind.
VERTICALS = {
    "incident": Vertical("oncall", "/root", 0x1C1DE7, 0.85, 0.08, 10_000_000, 8_000_000_000, ("journalctl -u {}", "kubectl logs {}", "systemctl restart {}", "lsof -c {}", "strace -p $(pgrep {})"), ("nginx", "postgresql", "gateway", "queue", "cache"), ("find failing service logs", "restart service", "open files", "trace process")),
    "deploy": Vertical("deploy", "/home/deploy/app", 0xDE910D, 0.93, 0.04, 50_000_000, 30_000_000_000, ("docker build -t {} .", "docker push {}", "kubectl apply -f {}.yaml", "helm upgrade {} chart", "git push origin {}"), ("web", "api", "worker", "main", "release"), ("build image", "push image", "apply manifest", "upgrade chart")),
    "observe": Vertical("sre", "/home/sre/diagnostics", 0x0B5E4E, 0.94, 0.03, 5_000_000, 15_000_000_000, ("vmstat 1 {}", "iostat -x 1 {}", "tail -n {} /var/log/syslog", "sar -u 1 {}", "perf stat -- sleep {}"), ("1", "2", "5", "10", "30"), ("memory use", "disk use", "recent logs", "cpu use")),
    "provision": Vertical("root", "/opt/app", 0x940510, 0.92, 0.04, 100_000_000, 20_000_000_000, ("apt-get install -y {}", "useradd {}", "terraform plan -target={}", "mkdir -p /opt/{}", "systemctl enable {}"), ("nginx", "redis", "backup", "metrics", "agent"), ("install package", "create user", "plan change", "enable service")),
}


def generate(spark: SparkSession, vertical: str, rows: int, seed: int = 0, start_ns: int = 0, step_ns: int = 500_000_000) -> DataFrame:
    """(id, ts_ns, raw_command, context, status, latency_ns, exit_code), all from hashes of (seed, row)."""
    v = VERTICALS[vertical]
    h = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(n))
    commands = F.array(*[F.lit(a.format(o)) for a in v.verbs for o in v.objects])
    u = h("outcome", 1_000_000) / 1e6
    df = spark.range(rows).select("id", (F.lit(start_ns) + F.col("id") * step_ns).alias("ts_ns"), F.get(commands, h("cmd", len(v.verbs) * len(v.objects)).cast("int")).alias("raw_command"), (1 + h("session", 99)).alias("session_id"), F.when(u < v.success, 1).when(u < v.success + v.failure, 2).otherwise(3).alias("status"), (F.lit(v.least_ns) + h("latency", v.most_ns - v.least_ns)).alias("latency_ns"))
    context = F.struct(F.lit(v.cwd).alias("cwd"), F.lit(v.env_hash).cast("decimal(20,0)").alias("env_hash"), F.col("session_id").cast("decimal(20,0)").alias("session_id"), F.lit("bash").alias("shell"), F.lit(v.user).alias("user"))
    return df.select("id", "ts_ns", "raw_command", context.alias("context"), "status", "latency_ns", F.when(F.col("status") == 2, 1 + h("exit", 127)).otherwise(0).cast("int").alias("exit_code"))


def inject(rows: DataFrame, kind: str) -> DataFrame:
    """Fault rows for tests: ForcedFailure, LatencySpike (x 5), RetryStorm (each row five times), IngestFailure (empty command); else unchanged."""
    if kind == "ForcedFailure":
        return rows.withColumn("status", F.lit(2)).withColumn("exit_code", F.lit(137)).withColumn("latency_ns", F.lit(999_999_999).cast("long"))
    if kind == "LatencySpike":
        return rows.withColumn("latency_ns", F.col("latency_ns") * 5)
    if kind == "RetryStorm":
        return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("_k")
    if kind == "IngestFailure":
        return rows.withColumn("raw_command", F.lit(""))
    return rows


@dataclass
class Rows(InputPartition):
    first: int
    end: int


class WorkloadReader(DataSourceReader):
    """Rows of generate() made on the executors, range by range of rows_per_partition ids."""

    def __init__(self, options: dict):
        self.vertical, self.rows, self.seed = options.get("vertical", "incident"), int(options.get("rows", 1000)), int(options.get("seed", 0))
        self.start, self.step, self.width = int(options.get("start_ns", 0)), int(options.get("step_ns", 500_000_000)), int(options.get("rows_per_partition", 1_000_000))
        if self.vertical not in VERTICALS:
            raise ValueError(f"unknown vertical {self.vertical!r}, known: {sorted(VERTICALS)}")

    def partitions(self) -> list[Rows]:
        return [Rows(a, min(a + self.width, self.rows)) for a in range(0, self.rows, self.width)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        from decimal import Decimal

        import xxhash

        v = VERTICALS[self.vertical]
        commands = [a.format(o) for a in v.verbs for o in v.objects]
        seed = struct.pack("<i" if -(2**31) <= self.seed < 2**31 else "<q", self.seed)
        # the hash of (seed, salt, row) as Spark's xxhash64 chains it
        heads = {salt: xxhash.xxh64_intdigest(salt.encode(), xxhash.xxh64_intdigest(seed, 42)) for salt in ("outcome", "cmd", "session", "latency", "exit")}

        def h(salt: str, row: bytes, n: int) -> int:
            x = xxhash.xxh64_intdigest(row, heads[salt])
            return (x - (1 << 64) if x >> 63 else x) % n

        for k in range(partition.first, partition.end):
            row = struct.pack("<q", k)
            u = h("outcome", row, 1_000_000) / 1e6
            status = 1 if u < v.success else 2 if u < v.success + v.failure else 3
            context = (v.cwd, Decimal(v.env_hash), Decimal(1 + h("session", row, 99)), "bash", v.user)
            yield k, self.start + k * self.step, commands[h("cmd", row, len(commands))], context, status, v.least_ns + h("latency", row, v.most_ns - v.least_ns), 1 + h("exit", row, 127) if status == 2 else 0


class WorkloadSource(DataSource):
    """spark.read.format("intentdeck_workload") with the options vertical, rows, seed, start_ns, step_ns and rows_per_partition, once registered with spark.dataSource.register()."""

    @classmethod
    def name(cls) -> str:
        return "intentdeck_workload"

    def schema(self) -> str:
        return "id long, ts_ns long, raw_command string, context struct<cwd:string,env_hash:decimal(20,0),session_id:decimal(20,0),shell:string,user:string>, status int, latency_ns long, exit_code int"

    def reader(self, schema) -> WorkloadReader:
        return WorkloadReader(dict(self.options))
