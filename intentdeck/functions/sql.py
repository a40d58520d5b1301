"""The scalar functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from intentdeck.functions import text
from intentdeck.functions.vector import EPSILON

#: Bodies of the native functions: Catalyst puts them into the query, so that they cost what their expressions cost.
NATIVE = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"vec_dot(a, b) / (sqrt(vec_dot(a, a)) * sqrt(vec_dot(b, b)) + {EPSILON}D)"),
    "vec_l2_sq": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x - y), 0D, (s, d) -> s + d * d)"),
}
ARROW = {"shell_words": text.shell_words_udf, "shell_tokens": text.tokens_udf, "hash_embedding": text.embed_udf, "classify_command": text.classify_udf}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to spark.sql() in this session; returns their names."""
    for name, (args, returns, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    for name, f in ARROW.items():
        spark.udf.register(name, f)
    return [*NATIVE, *ARROW]
