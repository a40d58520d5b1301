"""The binary write-ahead log: a reader of log files, and entries as a table of binary records.

Entry: u32 payload length, 16 bytes id, u64 time, u32 n and n f32, u32 n and n bytes of the command; little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from intentdeck.schemas import SegmentCorrupted

WAL_TYPE = "id string, ts_ns decimal(20,0), embedding array<float>, raw_command string"


def encode_entry(id_: bytes, ts_ns: int, embedding, command: str) -> bytes:
    text = command.encode()
    body = id_ + struct.pack("<QI", ts_ns, len(embedding)) + struct.pack(f"<{len(embedding)}f", *embedding) + struct.pack("<I", len(text)) + text
    return struct.pack("<I", len(body)) + body


def decode_log(data: bytes) -> Iterator[tuple[str, int, list[float], str]]:
    """The entries in order. A cut-off length prefix ends the log, a cut-off entry is an error."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<I", data, at)
        body = data[at + 4 : at + 4 + n]
        if len(body) < n or n < 32:
            raise SegmentCorrupted(f"entry at byte {at} is cut off")
        ts, d = struct.unpack_from("<QI", body, 16)
        if 32 + 4 * d > n:
            raise SegmentCorrupted(f"entry at byte {at} has a wrong length")
        vector = list(struct.unpack_from(f"<{d}f", body, 28))
        (c,) = struct.unpack_from("<I", body, 28 + 4 * d)
        yield body[:16].hex(), ts, vector, body[32 + 4 * d : 32 + 4 * d + c].decode()
        at += 4 + n


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    from decimal import Decimal

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = [(i, Decimal(t), v, c) for i, t, v, c in decode_log(data)]
                yield pd.DataFrame(rows, columns=["id", "ts_ns", "embedding", "raw_command"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, WAL_TYPE)


def wal_entries(rows: DataFrame) -> DataFrame:
    """(entry binary) of rows (id string of 32 hex digits, ts_ns, embedding, raw_command)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"entry": [encode_entry(bytes.fromhex(i), int(t), v, c) for i, t, v, c in zip(b["id"], b["ts_ns"], b["embedding"], b["raw_command"], strict=True)]})

    return rows.select("id", "ts_ns", "embedding", "raw_command").mapInPandas(pack, "entry binary")


def write_wal(rows: DataFrame, path: str) -> None:
    """Append entries as a table of binary records, which any store that Spark writes to can hold."""
    wal_entries(rows).write.mode("append").parquet(path)


def read_wal_table(spark: SparkSession, path: str) -> DataFrame:
    """The entries of write_wal()."""
    from decimal import Decimal

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, Decimal(t), v, c) for i, t, v, c in decode_log(b"".join(b["entry"]))]
            yield pd.DataFrame(rows, columns=["id", "ts_ns", "embedding", "raw_command"])

    return spark.read.parquet(path).mapInPandas(parse, WAL_TYPE)
