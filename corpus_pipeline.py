"""The corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() applies them to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentdeck.llm import decontamination, jaccard_join, packing, secrets, toxicity
from intentdeck.llm._common import materialize, read_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from the labelled documents of the input table."""
    model = toxicity.train_on(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest (doc_id, hash of its text) stays; of rows equal in doc_id and text one.

    Rows of one doc_id with different texts are judged apart. Rows without a doc_id take part behind all others, by a number made of their text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 62) - 1) + F.pmod(F.xxhash64(text, F.lit(1)), F.lit(1 << 62)))
    names = {"id": "_id", "fp": "_fp"}
    # the row goes along as one column, so that no name clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("text"), number.alias("_id"), F.xxhash64(text).alias("_fp"))
    gone = jaccard_join.jaccard_join(rows, id_col="_id", with_fp=True).where("not kept").select("id", "fp").distinct().withColumnsRenamed(names)
    return rows.join(gone, ["_id", "_fp"], "left_anti").dropDuplicates(["_id", "_fp"]).select("_row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; n_chars follows."""
    out = secrets.redact(docs, secrets.default_forest(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
