"""Vector maths as column expressions in double precision, and their NumPy twins for Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: added to the product of norms, so that a zero vector has cosine 0.
EPSILON = 1.1920928955078125e-07


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm_sq(a) -> Column:
    return dot(a, a)


def cosine(a, b) -> Column:
    return dot(a, b) / (F.sqrt(norm_sq(a)) * F.sqrt(norm_sq(b)) + F.lit(EPSILON))


def l2_sq(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d)


def l2_sq_cached(a, b, norm_a, norm_b) -> Column:
    """From cached squared norms, never below 0."""
    return F.greatest(F.lit(0.0), norm_a + norm_b - 2 * dot(a, b))


def l2_normalize(a) -> Column:
    """A vector whose squared norm is not above epsilon stays as it is."""
    n = norm_sq(a)
    return F.when(n > EPSILON, F.transform(a, lambda x: x.cast("double") / F.sqrt(n))).otherwise(F.transform(a, lambda x: x.cast("double")))


def int8_scale(a) -> Column:
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.when(top == 0, F.lit(1.0)).otherwise(top / 127)


def quantize_int8(a) -> Column:
    """Halves round away from zero; values stay within 127 of it."""
    s = int8_scale(a)
    return F.transform(a, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x.cast("double") / s))).cast("tinyint"))


def dequantize_int8(q, scale) -> Column:
    return F.transform(q, lambda x: x.cast("double") * scale)


def half_bits(x):
    """NumPy float32 -> uint16 bits of a half by dropping mantissa bits; small values become a signed zero, large ones infinity."""
    import numpy as np

    bits = np.ascontiguousarray(x, "f4").view("u4")
    sign, exp, frac = (bits >> 16) & 0x8000, ((bits >> 23) & 0xFF).astype("i8") - 112, (bits >> 13) & 0x3FF
    nan = ((bits >> 23) & 0xFF == 0xFF) & (bits & 0x7FFFFF != 0)
    out = np.where(exp <= 0, sign, np.where(exp >= 31, sign | 0x7C00, sign | (np.clip(exp, 0, 31).astype("u4") << 10) | frac))
    return np.where(nan, sign | 0x7C00 | np.maximum(frac, 1), out).astype("u2")


def from_half_bits(h):
    """NumPy uint16 bits of halves -> float32."""
    import numpy as np

    return np.ascontiguousarray(h, "u2").view("f2").astype("f4")


def batch_cosine(query, corpus):
    """NumPy cosine of one query with the rows of a matrix."""
    import numpy as np

    q, m = np.asarray(query, float), np.asarray(corpus, float)
    return m @ q / (np.linalg.norm(q) * np.linalg.norm(m, axis=1) + EPSILON)
