"""Near-duplicate vectors by a pivot-permutation index.

Each distinct vector is described by its ``width`` nearest reference points (pivots) in order of nearness and filed in the inverted list of
each of them, per label. Vectors that share at least ``shared`` pivots are candidates, compared by exact cosine. A list longer than
``block`` is dealt into blocks and the blocks are paired, so no task holds more than two blocks; a pair that meets in
several lists is counted in that of its smallest common pivot only. A task returns link counts and a spanning forest of its links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentdeck.llm._common import connected_components, discard, forest, hot_keys, join_spread, materialize, read_table

COSINE = 0.93
#: Nearest pivots that describe a vector, and how many of them candidates share.
WIDTH, SHARED = 12, 2
#: Bounds of the sample of vectors that serve as pivots; within them their number grows with the root of the rows.
LEAST_PIVOTS, MOST_PIVOTS = 64, 32_768
#: Rows of an inverted list that meet in one block.
BLOCK = 1024


def usable(vector, label):
    """Whether a row can link at all: label and vector not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def apart(pivots: np.ndarray, cosine: float) -> np.ndarray:
    """The unit pivots without those that link with an earlier one that stays: near copies would trade places in every order, and their group miss itself."""
    kept = np.empty_like(pivots)
    n = 0
    for at in range(0, len(pivots), 256):
        block = pivots[at : at + 256]
        free = (block @ kept[:n].T < cosine).all(axis=1)
        for p in block[free]:
            # of this block's own pivots, those kept since it began
            if n == 0 or (kept[:n][-256:] @ p < cosine).all():
                kept[n] = p
                n += 1
    return kept[:n]


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, width: int = WIDTH, shared: int = SHARED, block: int = BLOCK, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors of equal label and dimension link at a double-precision cosine of at least ``cosine``. Rows that are not
    usable() and rows with a null id link with nothing; their component is their own id. Repeated ids count as one node with the
    links of its rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    src = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    good = src.where(F.col("id").isNotNull() & usable(F.col("v"), F.col("label")))
    # + 0 makes -0.0 equal to 0.0, so that equal vectors are one class
    good = good.withColumn("v", F.transform("v", lambda x: x.cast("double") + F.lit(0.0)))
    classes = good.groupBy("label", "v").agg(F.min("id").alias("class"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    n = classes.count()
    pivots: list = []
    if n:
        many = min(most_pivots, max(LEAST_PIVOTS, 2 * math.isqrt(n)))
        # a bounded sample, in an order that does not depend on where the rows lie
        pivots = classes.select("v", F.xxhash64("v").alias("h")).orderBy("h", F.to_json("v")).limit(many).select("v").toArrow().column(0).to_numpy()
    by_dim_ = {}
    for d in {len(p) for p in pivots}:
        m = np.array([p for p in pivots if len(p) == d], "f8")
        by_dim_[d] = apart((m / np.linalg.norm(m, axis=1)[:, None]).astype("f4"), cosine)
    shared_pivots = spark.sparkContext.broadcast(by_dim_)  # at most most_pivots rows of four bytes a component

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_dim = shared_pivots.value
        for b in batches:
            dims = b["v"].map(len)
            for d, part in b.groupby(dims):
                x = np.array(part["v"].tolist(), dtype=float)
                if d in by_dim:
                    p = by_dim[d]
                    k = min(width, len(p))
                    near = np.empty((len(x), k), "int32")
                    for at in range(0, len(x), 256):
                        far = -(x[at : at + 256].astype("f4") @ p.T)
                        some = np.argpartition(far, k - 1, axis=1)[:, :k]
                        near[at : at + 256] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)
                else:  # no pivot of this dimension: one list for all
                    near = np.zeros((len(x), 1), "int32")
                yield pd.DataFrame({"label": part["label"].to_numpy(), "dim": np.full(len(part), d), "class": part["class"].to_numpy(), "copies": part["copies"].to_numpy(), "near": list(near), "v": list(x)})

    label_type = dict(src.dtypes)["label"]
    described = materialize(classes.mapInPandas(describe, f"label {label_type}, dim int, class long, copies long, near array<int>, v array<double>"), "described")
    filed = described.withColumn("pivot", F.explode("near"))
    sizes = filed.groupBy("label", "dim", "pivot").count().where("count > 1")
    listed = filed.join(sizes, ["label", "dim", "pivot"]).withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    listed = listed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    listed = listed.select("label", "dim", "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "copies", "near", "v")

    def compare(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        pivot, i, j = key[2], key[3], key[4]
        b = b.sort_values("class", kind="stable").reset_index(drop=True)
        near, own = np.stack(b["near"].to_list()), b["own"].to_numpy()
        need = min(shared, near.shape[1])
        ids, slot = np.unique(near, return_inverse=True)
        held = np.zeros((len(b), len(ids)), "float32")
        held[np.repeat(np.arange(len(b)), near.shape[1]), slot.ravel()] = 1
        cand = held @ held.T >= need
        low = held[:, ids < pivot]
        cand &= low @ low.T == 0  # else the pair is counted in the list of a smaller pivot
        if i != j:
            cand &= own[:, None] != own[None, :]
        x = np.stack(b["v"].to_list())
        norm = np.sqrt((x * x).sum(axis=1))
        cand &= (x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine
        np.fill_diagonal(cand, False)
        c, copies = b["class"].to_numpy(), b["copies"].to_numpy()
        links = cand.astype("float64") @ copies
        rows_, cols = np.nonzero(np.triu(cand))
        out = [(int(c[k]), int(links[k]), None) for k in np.nonzero(links)[0]]
        out += [(int(c[a]), 0, int(c[r])) for a, r in forest(len(b), zip(rows_.tolist(), cols.tolist(), strict=True))]
        return pd.DataFrame({"class": pd.array([o[0] for o in out], "int64"), "links": pd.array([o[1] for o in out], "int64"), "root": pd.array([o[2] for o in out], "Int64")})

    found = materialize(listed.groupBy("label", "dim", "pivot", "i", "j").applyInPandas(compare, "class long, links long, root long"), "found")
    links = materialize(found.groupBy("class").agg(F.sum("links").alias("links")), "links")
    # a third of all rows may be copies of one vector: their joins with its class are spread
    many_rows = classes.agg(F.sum("copies")).first()[0] or 0
    counts = classes.withColumnRenamed("copies", "records")
    hot_vectors, hot_classes = hot_keys(counts, ["label", "v"], many_rows), hot_keys(counts.groupBy("class").agg(F.max("records").alias("records")), ["class"], many_rows)
    nodes = join_spread(good, classes.select("label", "v", "class", "copies"), hot_vectors, ["id"], "inner").select("id", "class", "copies")
    nodes = materialize(nodes, "classed")
    # two rows of one id can be in two classes: the id ties them together
    tied = nodes.groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("a")).where("a <> b").select("a", "b")
    parts = connected_components(found.where("root is not null").select(F.col("class").alias("a"), F.col("root").alias("b")).unionByName(tied))
    known = links.join(parts.withColumnRenamed("node", "class"), "class", "full")
    classed, nodes = nodes, join_spread(nodes, known, hot_classes, ["id"], "left")
    nodes = nodes.groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.min(F.coalesce("component", "class")).alias("component"))
    nodes = materialize(nodes, "nodes")
    for t in (classes, described, found, links, parts, classed):
        discard(t)
    out = src.select("id").join(nodes, "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op4_near_vectors(spark, sf_dir) -> DataFrame:
    out = near_vectors(read_table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


OP4_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
