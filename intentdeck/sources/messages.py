"""The binary messages between nodes: tag, length of the payload, payload; all numbers little-endian.

Spark moves data by itself; the codec is for logs of such messages and for talking to nodes that speak it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentdeck.schemas import SegmentCorrupted

#: Tag, name and fields of each message, in the order of the bytes. "I" and "Q" are whole numbers of 4 and 8 bytes, "*" is the
#: rest of the payload, and a list is a count of 4 bytes and so many values (of the one field, or dicts of several).
MESSAGES: dict[int, tuple[str, tuple]] = {
    1: ("ping", (("from", "Q"), ("seq", "Q"))),
    2: ("pong", (("from", "Q"), ("seq", "Q"))),
    3: ("intent_forward", (("partition", "I"), ("payload", "*"))),
    4: ("segment_sync", (("partition", "I"), ("segment_data", "*"))),
    5: ("membership_update", (("version", "Q"), ("members", ["Q"]))),
    6: ("partition_table_update", (("version", "Q"), ("assignments", [(("partition_id", "I"), ("owner", "Q"), ("replicas", ["Q"]))]))),
}
_TAGS = {name: tag for tag, (name, _) in MESSAGES.items()}


def _put(kind, value) -> bytes:
    if kind == "*":
        return bytes(value)
    if isinstance(kind, str):
        return struct.pack(f"<{kind}", value)
    if isinstance(kind, list):
        return struct.pack("<I", len(value)) + b"".join(_put(kind[0], v) for v in value)
    return b"".join(_put(k, value[name]) for name, k in kind)


def _get(kind, data: bytes, at: int) -> tuple[Any, int]:
    if kind == "*":
        return data[at:], len(data)
    if isinstance(kind, str):
        end = at + struct.calcsize(f"<{kind}")
        if end > len(data):
            raise SegmentCorrupted(f"expected at least {end} bytes, got {len(data)}")
        return struct.unpack_from(f"<{kind}", data, at)[0], end
    if isinstance(kind, list):
        count, at = _get("I", data, at)
        out = []
        for _ in range(count):
            v, at = _get(kind[0], data, at)
            out.append(v)
        return out, at
    out = {}
    for name, k in kind:
        out[name], at = _get(k, data, at)
    return out, at


def encode(name: str, fields: dict) -> bytes:
    tag = _TAGS[name]
    payload = _put(MESSAGES[tag][1], fields)
    return struct.pack("<BI", tag, len(payload)) + payload


def decode(data: bytes) -> tuple[str, dict]:
    """(name, fields). A short header or payload and an unknown tag raise SegmentCorrupted; bytes behind the message are ignored."""
    if len(data) < 5:
        raise SegmentCorrupted("message too short for its header")
    tag, length = struct.unpack_from("<BI", data)
    if len(data) < 5 + length:
        raise SegmentCorrupted(f"message truncated: expected {length} payload bytes, got {len(data) - 5}")
    if tag not in MESSAGES:
        raise SegmentCorrupted(f"unknown message tag: 0x{tag:02x}")
    name, kind = MESSAGES[tag]
    return name, _get(kind, bytes(data[5 : 5 + length]), 0)[0]


@F.pandas_udf(T.BinaryType())
def encode_ping(sender: pd.Series, seq: pd.Series) -> pd.Series:
    return pd.Series([encode("ping", {"from": int(a), "seq": int(b)}) for a, b in zip(sender, seq, strict=True)])


@F.pandas_udf(T.StructType().add("name", "string").add("sender", "long").add("seq", "long"))
def decode_ping(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [decode(x) for x in b]
        yield pd.DataFrame({"name": [n for n, _ in got], "sender": [f["from"] for _, f in got], "seq": [f["seq"] for _, f in got]})
