"""64-bit FNV-1a over bytes, context hashes, partition ids and Bloom filters, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The FNV-1a offset basis as two halves, and the low part of its prime 2^40 + 435.
BASIS_HIGH, BASIS_LOW, PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
FULL = 0xFFFFFFFF


def bytes_of(binary) -> Column:
    """A binary column as an array of its byte values."""
    hexed = F.hex(binary)
    n = F.octet_length(binary)
    at = F.when(n > 0, F.sequence(F.lit(1), 2 * n - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))


def fnv1a(byte_values) -> Column:
    """DECIMAL(20,0) hash of an array of byte values, by 32-bit halves so that nothing overflows under ANSI rules."""
    start = F.struct(F.lit(BASIS_HIGH).cast("long").alias("h"), F.lit(BASIS_LOW).cast("long").alias("l"))

    def step(s, x):
        t = s["l"].bitwiseXOR(x)
        p = t * PRIME_LOW
        h = (s["h"] * PRIME_LOW + F.shiftright(p, 32) + F.shiftleft(t, 8)).bitwiseAND(FULL)
        return F.struct(h.alias("h"), p.bitwiseAND(FULL).alias("l"))

    return F.aggregate(byte_values, start, step, lambda s: s["h"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + s["l"].cast("decimal(20,0)")).cast("decimal(20,0)")


def fnv1a_text(text) -> Column:
    return fnv1a(bytes_of(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary")))


def little_endian(value, width: int = 8) -> Column:
    """The bytes of a non-negative whole number, lowest first."""
    v = value.cast("decimal(20,0)")
    return F.array(*[F.pmod(F.floor(v / F.lit(256**k).cast("decimal(20,0)")), F.lit(256)).cast("long") for k in range(width)])


def context_hash(cwd, env_hash, session_id, shell, user) -> Column:
    """Over cwd, env_hash and session_id as 8 bytes each, shell and user, without separators."""
    text = lambda c: bytes_of(c.cast("binary"))
    return fnv1a(F.concat(text(cwd), little_endian(env_hash), little_endian(session_id), text(shell), text(user)))


def partition_of(byte_values, n) -> Column:
    """fnv1a modulo n; 0 when n is 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n == 0, F.lit(0)).otherwise(F.pmod(fnv1a(byte_values), F.when(n == 0, F.lit(1)).otherwise(n).cast("decimal(20,0)"))).cast("int")


def bloom_bits(n, p=0.01) -> Column:
    """Bits of a Bloom filter for n keys at false-positive rate p."""
    return F.greatest(F.lit(64), F.ceil(-n.cast("double") * math.log(p) / math.log(2) ** 2)).cast("long")


def bloom_hashes(n, bits) -> Column:
    return F.greatest(F.lit(1), F.ceil(bits.cast("double") / n.cast("double") * math.log(2))).cast("long")


class Bloom:
    """Double hashing over FNV-1a: the reference filter of a segment, built on one side and probed on the other."""

    def __init__(self, n: int, p: float = 0.01):
        self.bits = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
        self.hashes = max(1, math.ceil(self.bits / n * math.log(2)))
        self.words = [0] * ((self.bits + 63) // 64)

    @staticmethod
    def fnv(data: bytes) -> int:
        h = (BASIS_HIGH << 32) | BASIS_LOW
        for b in data:
            h = ((h ^ b) * ((1 << 40) + PRIME_LOW)) & ((1 << 64) - 1)
        return h

    def places(self, key: bytes):
        first = self.fnv(key)
        second = (self.fnv(first.to_bytes(8, "little")) + 1) & ((1 << 64) - 1)
        return [((first + j * second) & ((1 << 64) - 1)) % self.bits for j in range(self.hashes)]

    def insert(self, key: bytes) -> None:
        for i in self.places(key):
            self.words[i // 64] |= 1 << (i % 64)

    def contains(self, key: bytes) -> bool:
        return all(self.words[i // 64] >> (i % 64) & 1 for i in self.places(key))
