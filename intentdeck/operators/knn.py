"""Nearest neighbours: one query against all, and the k nearest earlier vectors of every vector."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intentdeck.functions import vector as V
from intentdeck.schemas import DimensionMismatch
from intentdeck.shared import discard, materialize

#: Rows of a block of the blocked join, until there are so many blocks that they grow instead, and bytes of a block's components as doubles at most.
BLOCK, BLOCKS, MOST_BYTES = 1024, 24, 1 << 26
#: Pairs of blocks that meet, about, if blocks are not too large for it: the fewer they are, the fewer times a row is dealt out.
MEETINGS = 48
#: Parts of the cell index, asking rows of all cells that are worth a part, and the most that meet in one.
PARTS, FEW_ROWS, PART_ROWS = 4, 2048, 1 << 18
#: For edges that begin in given nodes: rows of the first sample, at least and at most, and for each node; how much larger the next sample is; and
#: of how few open rows no more are ruled out.
SAMPLE, MOST_SAMPLE, SAMPLE_EACH, GROWTH, FEW = 4096, 65_536, 64, 16, 256
#: Asking rows and stored rows of one product.
CHUNK, TILE = 512, 4096


def check_dim(rows: DataFrame, dim: int, col: str = "v") -> tuple[DataFrame, DataFrame]:
    """(rows of dimension dim, the others)."""
    ok = F.coalesce(F.size(col) == dim, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def search(corpus: DataFrame, query: list[float], k: int, metric: str = "l2", exclude: int | None = None) -> DataFrame:
    """(id, similarity, distance) of the k rows nearest to query: chosen by squared L2 distance (or by cosine with metric="cosine"), cosine reported.

    Every task keeps k rows (TakeOrderedAndProject); ties go to the smaller id.
    """
    if not query:
        raise DimensionMismatch("the query has no components")
    q = F.array(*[F.lit(float(x)) for x in query])
    df = corpus if exclude is None else corpus.where(F.col("id") != exclude)
    df = df.select("id", V.cosine(F.col("v"), q).alias("similarity"), V.l2_sq(F.col("v"), q).alias("distance"))
    order = [F.round("distance", 9).asc(), "id"] if metric == "l2" else [F.round("similarity", 9).desc(), "id"]
    return df.orderBy(*order).limit(k)


def rerank(corpus: DataFrame, query: list[float], k: int, exclude: int | None = None) -> DataFrame:
    """Fetch 4k by L2, keep the k of highest cosine."""
    got = search(corpus, query, 4 * k, exclude=exclude)
    return got.orderBy(F.round("similarity", 9).desc(), "id").limit(k)


def knn_earlier(rows: DataFrame, k: int = 5, strategy: str = "blocked", cells: int | None = None, probes: int = 6, block: int | None = None) -> DataFrame:
    """(from_id, to_id, weight): for each row (id in arrival order, v) its k most similar earlier rows, as edges earlier -> later.

    native: a theta join in SQL expressions. blocked: blocks of rows meet in pairs, each pair by matrix products,
    and a group returns at most k rows for each later row; memory is two blocks, of MOST_BYTES each at most. ivf: rows meet only within cells around
    sampled centres (each row searches ``probes`` cells; by default their number grows with the root of the rows, up to 4096), which is approximate. Rows whose vector is null or
    holds a null take no part, and only vectors of one dimension meet.
    """
    rows = rows.select("id", "v").where(complete())
    if strategy == "native":
        a, b = rows.select(F.col("id").alias("to_id"), F.col("v").alias("va")), rows.select(F.col("id").alias("from_id"), F.col("v").alias("vb"))
        pairs = b.join(a, (F.col("from_id") < F.col("to_id")) & (F.size("va") == F.size("vb"))).select("from_id", "to_id", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("weight"))
    elif strategy == "blocked":
        pairs = _earlier(rows, rows, k, block)
    elif strategy == "ivf":
        pairs = _ivf(rows, k, cells, probes)
    else:
        raise ValueError(strategy)
    return _best_of(pairs, k)


def complete() -> Column:
    """Whether a row's vector v is there with all its components."""
    return F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())


def _best_of(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("to_id").orderBy(F.desc("weight"), "from_id")
    return pairs.repartition("to_id").dropDuplicates(["from_id", "to_id"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("from_id", "to_id", "weight")


def _size(rows: DataFrame) -> tuple[int, int]:
    """Rows, and the largest dimension."""
    return tuple(rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first())


def _cuts(rows: DataFrame, block: int | None, size: tuple[int, int] | None = None, most: int = 0) -> list[int]:
    """Last ids of all blocks but the last: ranges of ids of about equally many rows.

    Without ``block`` there are up to BLOCKS of BLOCK rows, then BLOCKS larger ones, so that each row is dealt out a fixed number of times, and from
    MOST_BYTES of components in a block on ever more. With ``most`` there are no more than that, as far as those bytes allow.
    """
    n, dim = size or _size(rows)
    fit = max(1, MOST_BYTES // (8 * max(1, dim)))
    block = block or max(min(BLOCK, fit), min(-(-n // BLOCKS), fit))
    blocks = -(-n // block)
    if most:
        blocks = max(min(blocks, most), -(-n // fit))
    if blocks < 2:
        return []
    return sorted({int(x) for x in rows.approxQuantile("id", [i / blocks for i in range(1, blocks)], 0.1 / blocks)})


def _earlier(asks: DataFrame, stored: DataFrame, k: int, block: int | None) -> DataFrame:
    """(from_id, to_id, weight): for each row of asks candidates among the stored rows of smaller id, its k best of each block among them.

    Blocks are ranges of ids; a block of asks meets the blocks of stored rows that begin before its end, each in a group of its own.
    """
    if block:
        cs = _cuts(stored, block)
        ca = cs if asks is stored else _cuts(asks, block)
    elif asks is stored:  # half of all pairs meet
        ca = cs = _cuts(stored, None, None, math.isqrt(2 * MEETINGS))
    else:  # blocks of either side of about equally many rows deal out the fewest
        na, ns = _size(asks), _size(stored)
        most = max(1, round(math.sqrt(MEETINGS * na[0] / max(1, ns[0]))))
        ca, cs = _cuts(asks, None, na, most), _cuts(stored, None, ns, -(-MEETINGS // most))
    asks, stored = (df.select("id", "v").where(F.col("id").isNotNull()) for df in (asks, stored))
    number = lambda cuts: F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("id"))) if cuts else F.lit(0)
    last = [bisect.bisect_left(cs, c) for c in ca] + [len(cs)]  # of the stored blocks that a block of asks meets
    first = [bisect.bisect_left(last, s) for s in range(len(cs) + 1)]  # of the blocks of asks that meet a stored block
    at = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), i + 1)
    left = asks.withColumn("i", number(ca)).select("id", "v", "i", F.explode(F.sequence(F.lit(0), at(last, F.col("i")))).alias("j"), F.lit(True).alias("asks"))
    right = stored.withColumn("j", number(cs)).select("id", "v", F.explode(F.sequence(at(first, F.col("j")), F.lit(len(ca)))).alias("i"), "j", F.lit(False).alias("asks"))
    groups = sum(x + 1 for x in last)
    dealt = left.unionByName(right)
    if groups > 1:  # as many tasks as groups, however few bytes they have
        dealt = dealt.repartition(min(2 * groups, 4000), "i", "j")
    return dealt.groupBy(F.size("v").alias("dim"), "i", "j").applyInArrow(_best_stored(k), "from_id long, to_id long, weight double")


def centres(rows: DataFrame, cells: int) -> list[list[float]]:
    """A bounded sample of rows, by hash order."""
    return [r[0] for r in rows.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(cells).select("v").collect()]


def assign_cells(rows: DataFrame, at: list[list[float]], probes: int) -> DataFrame:
    """(id, v, near): the probes nearest centres of each row."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        c = np.array(at, float)
        c /= np.linalg.norm(c, axis=1)[:, None] + V.EPSILON
        for b in batches:
            s = np.stack(b["v"].to_list()).astype(float) @ c.T if len(b) else np.zeros((0, len(c)))
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "near": list(np.argsort(-s, axis=1, kind="stable")[:, :probes].astype("int32"))})

    return rows.select("id", "v").mapInPandas(near, "id long, v array<double>, near array<int>")


def _ivf(rows: DataFrame, k: int, cells: int | None, probes: int) -> DataFrame:
    n = rows.count()
    cells = cells or min(4096, max(64, math.isqrt(n)))
    at = centres(rows, cells)
    put = assign_cells(rows, at, probes)
    parts = max(1, min(PARTS, n // FEW_ROWS), -(-n // PART_ROWS))  # of a cell's asking rows, so that a group does not hold all of them
    stored = put.select("id", "v", F.col("near")[0].alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("asks"))
    asks = put.select("id", "v", F.explode("near").alias("cell"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("asks"))
    return stored.unionByName(asks).groupBy("cell", "part").applyInArrow(_best_stored(k), "from_id long, to_id long, weight double")


def _matrix(b: pa.Table):
    """Ids in order, and their vectors."""
    import numpy as np

    t = b.select(["id", "v"]).combine_chunks()
    ids, at = np.unique(t["id"].to_numpy(), return_index=True)
    v = t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"]
    return ids, (v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)[at].astype(float) if len(ids) else np.zeros((0, 0)))


def _best_stored(k: int):
    """For each row that asks its k most similar earlier rows among those that do not."""

    def best(b: pa.Table) -> pa.Table:
        to, frm, weight = nearest_earlier(*_matrix(b.filter(b["asks"])), *_matrix(b.filter(pc.invert(b["asks"]))), k)
        return pa.table({"from_id": frm, "to_id": to, "weight": weight})

    return best


def nearest_earlier(qi, x, mi, y, k: int):
    """(to ids, from ids, weights): for each row x[r] of id qi[r] the k rows of y (ids mi, ascending) of smaller id and greatest cosine, equal ones by id.

    Tiles of y go in order of ids and grow. A pair is looked at again only if its cosine may exceed the k-th best of the tiles before; one that
    equals it has the larger id. So a pair costs its product and one comparison, whatever the number of copies.
    """
    import numpy as np

    with np.errstate(all="ignore"):
        nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
        ux, uy = x / np.where(nx > 0, nx, 1)[:, None], y / np.where(ny > 0, ny, 1)[:, None]
        least = (nx[nx > 0].min() if (nx > 0).any() else 1.0) * (ny[ny > 0].min() if (ny > 0).any() else 1.0)
        shrink = least / (least + V.EPSILON)  # a cosine with the epsilon is at least this part of one without
        out = []
        for lo in range(0, len(x), CHUNK):
            q, u, n = x[lo : lo + CHUNK], ux[lo : lo + CHUNK], nx[lo : lo + CHUNK]
            end = np.searchsorted(mi, qi[lo : lo + CHUNK])  # so many rows of y are earlier
            w, ids, floor = np.full((len(q), k), -np.inf), np.zeros((len(q), k), "i8"), np.full(len(q), -np.inf)

            def take(s, c0: int) -> None:
                r, c = np.divmod(np.flatnonzero(s > floor[:, None]), s.shape[1])
                some = c + c0 < end[r]
                r, c = r[some], c[some]
                if len(r) > 32 * len(q) and s.shape[1] > 64:  # in halves, the second with what the first found
                    half = s.shape[1] // 2
                    take(s[:, :half], c0)
                    take(s[:, half:], c0 + half)
                    return
                if not len(r):
                    return
                c += c0
                got = np.round(np.einsum("ij,ij->i", q[r], y[c]) / (n[r] * ny[c] + V.EPSILON), 6)
                hit = np.unique(r)
                rr, ww, ii = np.r_[np.repeat(hit, k), r], np.r_[w[hit].ravel(), got], np.r_[ids[hit].ravel(), mi[c]]
                rr, ww, ii = (z[ww > -np.inf] for z in (rr, ww, ii))
                order = np.lexsort((ii, -ww, rr))
                rr, ww, ii = rr[order], ww[order], ii[order]
                place = np.arange(len(rr)) - np.searchsorted(rr, rr)
                kept = place < k
                w[hit] = -np.inf
                w[rr[kept], place[kept]], ids[rr[kept], place[kept]] = ww[kept], ii[kept]
                kth = w[hit, k - 1] + 4e-7  # what rounds to more than the k-th best is above this
                floor[hit] = np.where(kth < 0, kth / shrink - 1e-9, kth)

            c0, last = 0, int(end.max(initial=0))
            while c0 < last:
                c1 = min(last, c0 + min(TILE, max(64, c0)))
                take(u @ uy[c0:c1].T, c0)
                c0 = c1
            r, p = np.nonzero(w > -np.inf)
            out.append((qi[lo + r], ids[r, p], w[r, p]))
        if not out:
            return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def form_edges(rows: DataFrame, k: int = 5, **how) -> DataFrame:
    """Edges existing -> new of relation Causal (0), weighted by cosine."""
    return knn_earlier(rows, k, **how).select("from_id", "to_id", F.lit(0).alias("relation"), "weight")


def form_edges_to(rows: DataFrame, asks: DataFrame, k: int = 5, block: int | None = None) -> DataFrame:
    """The edges of form_edges() that end in a node of asks (node): only these ask, so the work is that of so many searches among rows before the last of them."""
    rows = rows.select("id", "v").where(complete())
    return _edges_into(rows, rows.join(asks.select(F.col("node").alias("id")).distinct(), "id", "left_semi"), k, block)


def _edges_into(rows: DataFrame, some: DataFrame, k: int, block: int | None) -> DataFrame:
    last = some.agg(F.max("id")).first()[0]
    return _best_of(_earlier(some, rows.where(F.col("id") < F.lit(last)), k, block), k).select("from_id", "to_id", F.lit(0).alias("relation"), "weight")


def form_edges_from(rows: DataFrame, asks: DataFrame, k: int = 5, block: int | None = None) -> DataFrame:
    """The edges of form_edges() that begin in a node of asks (node), without making the others.

    A row is open, it may end such an edge, until k earlier rows are found that come before the best node of asks for it. They are looked for in samples
    of the rows, each GROWTH times the one before, which leave about k rows open for each node and sample row that a row of the table stands for; only what
    is open in the end searches all. So the work is that of the rows times the nodes, times the logarithm of the rows; samples rule out, they do not decide.
    """
    rows = rows.select("id", "v").where(complete() & F.col("id").isNotNull())
    nodes = asks.select(F.col("node").alias("id")).distinct()
    some = rows.join(nodes, "id", "left_semi")
    asked, first = some.agg(F.count("*"), F.min("id")).first()
    n = rows.count()
    is_open = rows.where(F.col("id") > F.lit(first))
    size = min(MOST_SAMPLE, max(SAMPLE, SAMPLE_EACH * asked))
    sample = lambda: rows.where(F.pmod(F.xxhash64("id"), F.lit(n // size)) == 0)
    if asked and 2 * size <= n:
        is_open = materialize(_open(is_open, some, sample(), k, max(1, n // max(4 * SAMPLE, size)), -(-asked // MOST_SAMPLE)), "open")
        while 2 * (size := size * GROWTH) <= n and is_open.count() > FEW:
            found = _best_of(_earlier(is_open, sample(), k, block), k).groupBy(F.col("to_id").alias("id"))
            worst = found.agg(F.count("*").alias("n"), F.min(F.struct("weight", (-F.col("from_id")).alias("minus"))).alias("worst"))
            closed = is_open.join(worst, "id").where((F.col("n") == k) & (F.col("worst") > F.struct("weight", (-F.col("from_id")).alias("minus"))))
            still = materialize(is_open.join(closed.select("id"), "id", "left_anti"), "open")
            discard(is_open)
            is_open = still
    return _edges_into(rows, is_open.select("id", "v"), k, block).join(nodes.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select("from_id", "to_id", "relation", "weight")


def _open(rows: DataFrame, some: DataFrame, sample: DataFrame, k: int, groups: int, parts: int) -> DataFrame:
    """(id, v, from_id, weight): the rows for which fewer than k of the earlier rows of sample come before the best earlier row of some, and that row.

    Rows are dealt to groups, some to parts; a group of a part holds all of the sample.
    """
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = (
        rows.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).select("id", "v", "i", number(parts).alias("p"), F.lit(0).alias("role"))
        .unionByName(some.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).select("id", "v", number(groups).alias("i"), "p", F.lit(1).alias("role")))
        .unionByName(sample.withColumn("p", number(parts)).select("id", "v", number(groups).alias("i"), "p", F.lit(2).alias("role")))
    )

    def rule_out(b: pa.Table) -> pa.Table:
        import numpy as np

        (ids, x), asked, others = (_matrix(b.filter(pc.equal(b["role"], role))) for role in range(3))
        to, best, weight = nearest_earlier(ids, x, *asked, 1)
        at = np.searchsorted(ids, to)
        end, frm, w = nearest_earlier(to, x[at], *others, k)  # a row's lie together, the best first
        count = np.bincount(np.searchsorted(to, end), minlength=len(to))
        full = np.flatnonzero(count == k)
        worst = np.cumsum(count)[full] - 1
        closed = np.zeros(len(to), bool)
        closed[full] = (w[worst] > weight[full]) | ((w[worst] == weight[full]) & (frm[worst] < best[full]))
        at, keep = at[~closed], ~closed
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype="i4") * x.shape[1]), pa.array(x[at].ravel()))
        return pa.table({"id": to[keep], "v": v, "from_id": best[keep], "weight": weight[keep]})

    if groups * parts > 1:
        dealt = dealt.repartition(min(2 * groups * parts, 4000), "i", "p")
    got = dealt.groupBy(F.size("v").alias("dim"), "i", "p").applyInArrow(rule_out, "id long, v array<double>, from_id long, weight double")
    if parts > 1:
        best = F.max_by(F.struct("v", "from_id", "weight"), F.struct("weight", (-F.col("from_id")).alias("minus"))).alias("best")
        got = got.groupBy("id").agg(best).select("id", "best.*")
    return got


def count_edges(rows: DataFrame, k: int = 5) -> DataFrame:
    """(edges): how many form_edges() gives. A row has as many as there are earlier ones of its dimension, k at most, whichever they are, so none is compared.

    A row with a component that is not finite has no cosine with any, hence no edge.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))
    ok = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    n = ok.select("id", F.size("v").alias("dim")).distinct().groupBy("dim").agg(F.count("*").alias("n"))
    most = F.least("n", F.lit(k))  # rows before the k-th have fewer
    return n.agg(F.coalesce(F.sum(k * (F.col("n") - most) + F.floor(most * (most - 1) / 2)), F.lit(0)).cast("long").alias("edges"))


def form_edges_incremental(history: DataFrame, batch: DataFrame, k: int = 5, block: int | None = None) -> DataFrame:
    """The edges that form_edges gives for the rows of batch (ids after those of history), without redoing history: rows of batch ask, block by
    block, and rows of history are only searched."""
    asks, stored = batch.select("id", "v").where(complete()), history.select("id", "v").unionByName(batch.select("id", "v")).where(complete())
    return _best_of(_earlier(asks, stored, k, block), k).select("from_id", "to_id", F.lit(0).alias("relation"), "weight")
