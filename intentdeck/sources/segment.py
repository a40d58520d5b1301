"""Segments: Parquet tables of nodes and edges, and the reference binary layout as codec and batch reader.

Binary: a header of 128 bytes, columns (ids, times, hashes, confidences, states) each at a multiple of 64, vectors of padded stride,
CSR edges (offsets, then target u32, relation u8, weight f32 and 3 bytes of padding), Bloom filter of the ids. Little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from intentdeck.functions.hashing import Bloom
from intentdeck.schemas import SegmentCorrupted, SegmentNotFound

#: Fixed values of the layout.
MAGIC, MAJOR, MINOR, HEADER, ALIGN, EDGE = b"TALB", 1, 0, 128, 64, 12
NODE_TYPE = "segment string, node int, id string, ts_ns decimal(20,0), context_hash decimal(20,0), confidence float, status int, embedding array<float>"


def align_up(value: int, to: int = ALIGN) -> int:
    return -(-value // to) * to


def layout(n: int) -> list[int]:
    """Offsets of the five node columns within their region, and its end."""
    out, at = [], 0
    for width in (16, 8, 8, 4, 1):
        out.append(at)
        at = align_up(at + width * n)
    return [*out, at]


def write_segment(nodes: list[tuple], edges: list[tuple], dim: int) -> bytes:
    """nodes: (id 16 bytes, ts, hash, confidence, status, vector); edges: (from, to, relation, weight) by node position. Edges from unknown positions are dropped."""
    n = len(nodes)
    cols = layout(n)
    region = bytearray(cols[-1])
    for k, (fmt, at) in enumerate(zip("16s Q Q f B".split(), cols, strict=False)):
        data = b"".join(struct.pack("<" + fmt, x[k]) for x in nodes)
        region[at : at + len(data)] = data
    stride = align_up(4 * dim)
    vectors = b"".join(struct.pack(f"<{dim}f", *x[5]).ljust(stride, b"\0") for x in nodes)
    by: list[list] = [[] for _ in range(n)]
    for e in edges:
        if e[0] < n:
            by[e[0]].append(e)
    offsets = [0]
    for x in by:
        offsets.append(offsets[-1] + len(x))
    csr = struct.pack(f"<{n + 1}Q", *offsets) + b"".join(struct.pack("<IBf3x", t, r, w) for x in by for _, t, r, w in x)
    bloom = Bloom(max(1, n))
    for x in nodes:
        bloom.insert(x[0])
    filt = struct.pack("<IQ", bloom.hashes, bloom.bits) + struct.pack(f"<{len(bloom.words)}Q", *bloom.words)
    node_at = HEADER
    vec_at = align_up(node_at + len(region))
    edge_at = align_up(vec_at + len(vectors))
    bloom_at = align_up(edge_at + len(csr))
    head = bytearray(HEADER)
    head[0:4] = MAGIC
    struct.pack_into("<HH", head, 4, MINOR, MAJOR)
    struct.pack_into("<QQI", head, 24, n, offsets[-1], dim)
    struct.pack_into("<QQQ", head, 48, node_at, vec_at, edge_at)
    struct.pack_into("<Q", head, 80, bloom_at)
    out = bytearray(bloom_at + len(filt))
    for at, part in ((0, head), (node_at, region), (vec_at, vectors), (edge_at, csr), (bloom_at, filt)):
        out[at : at + len(part)] = part
    return bytes(out)


def read_segment(data: bytes) -> tuple[list[tuple], list[tuple], Bloom]:
    """The nodes and edges of write_segment(), and the filter. A wrong magic or a file too short raises SegmentCorrupted."""
    if len(data) < HEADER or data[:4] != MAGIC:
        raise SegmentCorrupted("no segment header")
    n, m, dim = struct.unpack_from("<QQI", data, 24)
    node_at, vec_at, edge_at = struct.unpack_from("<QQQ", data, 48)
    (bloom_at,) = struct.unpack_from("<Q", data, 80)
    cols, stride = layout(n), align_up(4 * dim)
    try:
        parts = [[struct.unpack_from("<" + f, data, node_at + at + w * i)[0] for i in range(n)] for f, w, at in zip("16s Q Q f B".split(), (16, 8, 8, 4, 1), cols, strict=False)]
        vectors = [list(struct.unpack_from(f"<{dim}f", data, vec_at + stride * i)) for i in range(n)]
        offsets = struct.unpack_from(f"<{n + 1}Q", data, edge_at)
        edges = [(i, *struct.unpack_from("<IBf", data, edge_at + 8 * (n + 1) + EDGE * j)) for i in range(n) for j in range(offsets[i], offsets[i + 1])]
        bloom = Bloom(1)
        bloom.hashes, bloom.bits = struct.unpack_from("<IQ", data, bloom_at)
        bloom.words = list(struct.unpack_from(f"<{(bloom.bits + 63) // 64}Q", data, bloom_at + 12))
    except struct.error as e:
        raise SegmentCorrupted(str(e)) from e
    if m != len(edges):
        raise SegmentCorrupted("edge count differs from the offsets")
    return list(zip(*parts, vectors, strict=True)), edges, bloom


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """NODE_TYPE rows of binary segment files."""
    from decimal import Decimal

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                nodes, _, _ = read_segment(data)
                yield pd.DataFrame([(name, k, x[0].hex(), Decimal(x[1]), Decimal(x[2]), x[3], x[4], x[5]) for k, x in enumerate(nodes)], columns=["segment", "node", "id", "ts_ns", "context_hash", "confidence", "status", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, NODE_TYPE)


def write_tables(nodes: DataFrame, edges: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """The Spark form of a segment: Parquet with a Bloom filter on id, edges sorted by their start."""
    nodes.write.mode("append").option("maxRecordsPerFile", rows_per_file).option("parquet.bloom.filter.enabled#id", "true").parquet(f"{path}/nodes")
    edges.sortWithinPartitions("from_id").write.mode("append").parquet(f"{path}/edges")


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    try:
        return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SegmentNotFound(path) from e
        raise
