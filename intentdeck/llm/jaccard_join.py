"""Similarity join on word n-grams by chosen paths.

Each document's set of word 5-grams is embedded as ``COORDINATES`` min-hash tokens, so that sets of similarity J share any coordinate's token with
probability J. A run splits all sets recursively: at a node of its tree each token is sampled with probability 1 / (0.8 x COORDINATES), by a hash of the
path and the token, and a set goes into the bucket of each of its sampled tokens, so that a pair at the threshold shares about one bucket again.
A bucket of one set ends; one of up to ``SMALL`` sets is compared by brute force; a larger one is split on, unless most of it is alike, ``DEPTH`` levels at most. What
is large even then is dealt into blocks that meet in pairs. Runs with fresh samples repeat until a pair at the threshold shares no bucket in any of them
with a probability of at most 1 - RECALL.

Brute force goes by the tokens first: sets that can be similar by their sizes and share at least ``LEAST_ALIKE`` tokens are then compared exactly. A pair counts in the
smallest bucket that it shares only. Tasks return link counts and spanning forests, never pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentdeck.llm._common import connected_components, discard, forest, groups_of, materialize, read_table

WORDS = 5
#: The least similarity as a fraction, compared in whole numbers.
SIMILAR = (8, 10)
COORDINATES = 64
#: Levels of a run's tree; sets in a bucket that is compared without further splitting.
DEPTH, SMALL = 4, 128
RECALL = 0.998
#: A large bucket whose sets agree on such a share of their tokens is a group of near copies, which splitting would not part: it is dealt into blocks at once.
DENSE, PROBES = 0.6, 24
#: Tokens that a pair shares at least (a pair at 0.8 shares 51 on average, and fewer than 35 once in 10^5).
LEAST_ALIKE = 35
#: Sets in a block of a large bucket, and n-grams (or eighths of characters, if more) in a block of the exact comparison.
BLOCK, BLOCK_GRAMS = 512, 300_000
WORD = re.compile(r"\w+")
MASK = (1 << 64) - 1


@cache
def runs_needed(threshold: float = 0.8, coordinates: int = COORDINATES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Runs until a pair at the threshold, split to the full depth in each, misses in all of them with a probability of at most 1 - recall.

    A pair that shares ``a`` tokens has at each shared node a binomial number of shared children, independent given ``a``; all
    runs see the same tokens, so the miss is taken over the distribution of ``a``.
    """
    sample = min(1.0, 1 / (threshold * coordinates))
    ends = [0.0] * (coordinates + 1)  # by shared tokens: no shared node is left after so many levels
    for _ in range(depth):
        ends = [(1 - sample + sample * q) ** a for a, q in enumerate(ends)]
    share = [math.comb(coordinates, a) * threshold**a * (1 - threshold) ** (coordinates - a) for a in range(coordinates + 1)]
    runs = 1
    while sum(s * q**runs for s, q in zip(share, ends, strict=True)) > 1 - recall:
        runs += 1
    return runs


def word_hash(word: str) -> int:
    """A 64-bit hash that is the same in every process."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's lower-case word n-grams; a text of fewer words is one n-gram, one without words none."""

    def __init__(self, words: int = WORDS, remember: int = 150_000):
        self.words, known = words, {}
        self.known, self.remember = known, remember

    def hashes(self, text: str):
        import numpy as np

        known = self.known
        if len(known) > self.remember:
            known.clear()
        found = WORD.findall(text.lower())
        try:
            return np.fromiter(map(known.__getitem__, found), "u8", len(found))
        except KeyError:
            for w in found:
                if w not in known:
                    known[w] = word_hash(w)
            return np.fromiter(map(known.__getitem__, found), "u8", len(found))

    def __call__(self, text: str | None):
        import numpy as np

        h = self.hashes(text or "")
        n = min(self.words, len(h))
        if not n:
            return h
        m = len(h) - n + 1
        out = np.zeros(m, "u8")
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def _mixed(x):
    """A bijective 64-bit mix of an array."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, fp, set_key, n, weight, tokens) of every row: a digest of its n-gram set, the set's size, what it weighs in memory and its min-hash tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        rng = np.random.default_rng(11)
        mul = rng.integers(1, 1 << 63, COORDINATES, dtype="u8") * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 1 << 63, COORDINATES, dtype="u8")
        shingle = Shingler(words)
        for b in batches:
            keys, sizes, weights, tokens = [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingle(t)
                sizes.append(len(s))
                weights.append(max(len(s), len(t) // 8))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                low = np.full(COORDINATES, MASK, "u8")
                for i in range(0, len(s), 4096):
                    x = s[i : i + 4096, None] * mul + add
                    x ^= x >> np.uint64(32)
                    low = np.minimum(low, x.min(axis=0))
                tokens.append((low & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64()), pa.array(tokens, pa.binary())], ["id", "fp", "set_key", "n", "weight", "tokens"])

    src = docs.select(F.col("id"), F.xxhash64("text").alias("fp"), "text")
    return src.mapInArrow(run, "id long, fp long, set_key binary, n long, weight long, tokens binary")


def split(nodes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(key, cid): the children of each node (paths array<long>, cid, tokens) that its set goes into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        salt = np.arange(1, COORDINATES + 1, dtype="u8") * np.uint64(0xD6E8FEB86659FD93)
        least = np.uint64(MASK / (threshold * COORDINATES))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                many = np.array([len(p) for p in part.column(0).to_pylist()])
                who = np.repeat(np.arange(part.num_rows), many)
                path = np.array([x for p in part.column(0).to_pylist() for x in p], "i8").view("u8")
                tokens = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u4").reshape(part.num_rows, COORDINATES).astype("u8")
                key = _mixed(_mixed((tokens << np.uint64(8)) ^ salt)[who] ^ _mixed(path + np.uint64(1))[:, None])
                row, coordinate = np.nonzero(_mixed(key ^ np.uint64(0xA5A5A5A5)) < least)
                cid = part.column(1).to_numpy()[who[row]]
                yield pa.RecordBatch.from_arrays([pa.array(key[row, coordinate].view("i8")), pa.array(cid)], ["key", "cid"])

    return nodes.select("paths", "cid", "tokens").mapInArrow(run, "key long, cid long")


def _leaves(classes: DataFrame, small: int) -> list[DataFrame]:
    """Written tables (key, cid, c): the buckets of two sets or more in which the splitting of all runs ends, and how many sets they hold."""
    paths = F.array(*[F.lit(r).cast("long") for r in range(runs_needed())])
    nodes, leaves = classes.select(paths.alias("paths"), "cid", "tokens"), []
    for level in range(DEPTH):
        filed = materialize(split(nodes), "filed")
        sizes = materialize(filed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
        held = materialize(filed.join(sizes, "key"), "buckets")
        discard(filed)
        discard(sizes)
        large = held.where(F.col("c") > small)
        if level + 1 == DEPTH or large.isEmpty():
            return [*leaves, held]
        leaves.append(held.where(F.col("c") <= small))
        large = materialize(large.join(classes.select("cid", "tokens"), "cid"), "large")
        alike = materialize(large.groupBy("key").agg(_agreement().alias("alike")), "alike")
        large = large.join(alike, "key")
        leaves.append(large.where(F.col("alike") >= DENSE).select("key", "cid", "c"))
        nodes = large.where(F.col("alike") < DENSE).select(F.array("key").alias("paths"), "cid", "tokens")
    return leaves


def _agreement():
    """About the share of the tokens on which two sets of a group agree, as an aggregate that starts on the map side.

    The lowest bits of a coordinate's tokens are random signs of its values, and the square of their mean is on average the chance that two rows hold the same value.
    """
    signs = [1.0 - 2 * F.conv(F.hex(F.substring("tokens", 4 * c + 1, 1)), 16, 10).cast("int").bitwiseAND(1) for c in range(PROBES)]
    total = F.pow(F.avg(signs[0]), 2)
    for x in signs[1:]:
        total = total + F.pow(F.avg(x), 2)
    return total / PROBES


def _in_pairs(df: DataFrame, blocks, *columns) -> DataFrame:
    """Deal the rows of each key into blocks and copy them to each pair (i, j) of blocks; rows of a pair lie together, sorted."""
    df = df.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    df = df.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "own", *columns)
    return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cid")


def _apart(key: int, leaves: list[list[int]]):
    """Whether pairs (as a matrix) share no bucket of a smaller key."""
    import numpy as np

    where: dict[int, int] = {}
    at = [(r, where.setdefault(k, len(where))) for r, ks in enumerate(leaves) for k in ks if k < key]
    m = np.zeros((len(leaves), len(where)), "float32")
    if at:
        m[tuple(np.array(at).T)] = 1
    return m @ m.T == 0


def _alike(rows: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(key, cid, weight) of the sets that have at least one possible partner which counts in the bucket key."""
    p, q = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for t, groups in groups_of(batches, 3):
            key, i, j, cid, own, n, weight = (t.column(c).to_numpy() for c in range(7))
            tokens = np.frombuffer(b"".join(t.column(7).to_pylist()), "u1").reshape(t.num_rows, COORDINATES)
            leaves, wanted = t.column(8), np.zeros(t.num_rows, bool)
            by_size: dict[int, list[int]] = {}
            for a, z in groups:
                if z - a <= SMALL and i[a] == j[a]:
                    by_size.setdefault(z - a, []).append(a)
                    continue
                m = n[a:z]
                able = q * np.minimum(m[:, None], m[None, :]) >= p * np.maximum(m[:, None], m[None, :])
                alike = np.zeros((z - a, z - a), "i2")
                for c in range(COORDINATES):
                    alike += tokens[a:z, c, None] == tokens[None, a:z, c]
                able &= alike >= LEAST_ALIKE
                if i[a] != j[a]:
                    able &= own[a:z, None] != own[None, a:z]
                np.fill_diagonal(able, False)
                if able.any():
                    wanted[a:z] = (able & _apart(int(key[a]), leaves.slice(a, z - a).to_pylist())).any(axis=1)
            for size, firsts in by_size.items():
                x, y = np.triu_indices(size, 1)
                for at in range(0, len(firsts), max(1, 60_000 // max(1, len(x)))):
                    first = np.array(firsts[at : at + max(1, 60_000 // max(1, len(x)))])[:, None]
                    l, r = (first + x).ravel(), (first + y).ravel()
                    able = q * np.minimum(n[l], n[r]) >= p * np.maximum(n[l], n[r])
                    l, r = l[able], r[able]
                    able = (tokens[l] == tokens[r]).sum(axis=1) >= LEAST_ALIKE
                    for u, v in zip(l[able].tolist(), r[able].tolist(), strict=True):
                        if min(set(leaves[u].as_py()) & set(leaves[v].as_py())) == key[u]:
                            wanted[u] = wanted[v] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[wanted]) for x in (key, cid, weight)], ["key", "cid", "weight"])

    return rows.mapInArrow(run, "key long, cid long, weight long")


def _links(rows: DataFrame, words: int, similar: tuple[int, int]) -> DataFrame:
    """(cid, links, root): exact comparison of the rows (key, i, j, cid, own, copies, leaves, text) that lie together."""
    p, q = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        shingle = Shingler(words)
        for t, groups in groups_of(batches, 3, rows=256):
            out: list[tuple[int, int, int | None]] = []
            for a, z in groups:
                g = t.slice(a, z - a).to_pydict()
                c, copies = g["cid"], np.array(g["copies"], "f8")
                sets = [shingle(x) for x in g["text"]]
                n = np.array([len(s) for s in sets], "f8")
                flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), n.astype("i8"))
                _, slot, times = np.unique(flat, return_inverse=True, return_counts=True)
                many = times[slot] > 1
                _, slot = np.unique(slot[many], return_inverse=True)
                who = who[many]
                order = np.argsort(slot, kind="stable")
                slot, who = slot[order], who[order]
                both = np.zeros((len(sets), len(sets)))
                width, top = max(256, (1 << 22) // len(sets)), int(slot[-1]) + 1 if len(slot) else 0
                for s in range(0, top, width):
                    lo, hi = np.searchsorted(slot, [s, s + width])
                    m = np.zeros((len(sets), min(width, top - s)), "float32")
                    m[who[lo:hi], slot[lo:hi] - s] = 1
                    both += m @ m.T
                link = both * q >= p * (n[:, None] + n[None, :] - both)
                if g["i"][0] != g["j"][0]:
                    own = np.array(g["own"])
                    link &= own[:, None] != own[None, :]
                np.fill_diagonal(link, False)
                if not link.any():
                    continue
                link &= _apart(g["key"][0], g["leaves"])
                links = link.astype("f8") @ copies
                x, y = np.nonzero(np.triu(link))
                out += [(c[k], int(links[k]), None) for k in np.nonzero(links)[0]]
                out += [(c[s], 0, c[r]) for s, r in forest(len(sets), zip(x.tolist(), y.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["cid", "links", "root"])

    return rows.mapInArrow(run, "cid long, links long, root long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: tuple[int, int] = SIMILAR, small: int = SMALL, block: int = BLOCK, block_grams: int = BLOCK_GRAMS, with_fp: bool = False) -> DataFrame:
    """(id, class_id, n_links, component_id, kept[, fp]) for every row.

    class_id: the smallest id whose text has the same set of word n-grams. n_links: the other rows whose set has a
    Jaccard similarity of at least similar[0]/similar[1] with this row's, copies included. component_id: the smallest id reachable by
    links. kept: whether the row is the first of its component by (id, fp), fp being a hash of the text; rows equal in both are all kept. Texts that are null or
    without words, and rows with a null id, link with nothing. Texts of fewer words than the n-gram are one n-gram. Repeated rows are copies of each other (each
    counts as a link). Rows of one id with different texts are judged each on its own. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sig = materialize(_signatures(src, words), "signatures")
    live = sig.where("id is not null and set_key is not null")
    # of a class only the smallest (id, fp) is compared
    classes = live.groupBy("set_key").agg(F.count("*").alias("copies"), F.min(F.struct("id", "fp")).alias("rep"), F.first("tokens").alias("tokens"), F.first("n").alias("n"), F.max("weight").alias("weight"))
    classes = materialize(classes.select("set_key", "copies", F.col("rep.id").alias("rep"), F.col("rep.fp").alias("fp"), F.xxhash64("set_key").alias("cid"), "tokens", "n", "weight"), "classes")
    tables = _leaves(classes, small)
    leaves = tables[0]
    for t in tables[1:]:
        leaves = leaves.unionByName(t)
    # at most a few leaves for each run
    filed = leaves.groupBy("cid").agg(F.collect_list(F.struct("key", "c")).alias("at"))
    profile = filed.join(classes.select("cid", "copies", "n", "weight", "tokens", "rep", "fp"), "cid").withColumn("leaves", F.array_sort(F.array_distinct("at.key")))
    profile = materialize(profile, "profile")
    one_byte = F.expr("unhex(regexp_replace(hex(tokens), '(..)......', '$1'))")  # of each token
    buckets = profile.select("cid", "n", "weight", one_byte.alias("tokens"), "leaves", F.explode(F.array_distinct("at")).alias("l"))
    buckets = buckets.select("cid", "n", "weight", "tokens", "leaves", F.col("l.key").alias("key"), F.col("l.c").alias("c"))
    wanted = materialize(_alike(_in_pairs(buckets, F.ceil(F.col("c") / block).cast("int"), "n", "weight", "tokens", "leaves"), similar).distinct(), "wanted")
    sizes = materialize(wanted.groupBy("key").agg(F.ceil(F.sum("weight") / block_grams).cast("int").alias("blocks")), "sizes")
    need = materialize(wanted.select("cid").distinct().join(profile.select("cid", "rep", "fp", "copies", "leaves"), "cid"), "need")
    texts = src.withColumn("fp", F.xxhash64("text")).withColumnRenamed("id", "rep").join(need, ["rep", "fp"])
    texts = texts.groupBy("cid").agg(*[F.first(c).alias(c) for c in ("copies", "leaves", "text")])  # of rows equal in id and text one
    rows = wanted.join(sizes, "key").join(texts, "cid")
    found = materialize(_links(_in_pairs(rows, F.col("blocks"), "copies", "leaves", "text"), words, similar), "found")
    links = materialize(found.groupBy("cid").agg(F.sum("links").alias("links")), "links")
    parts = connected_components(found.where("root is not null").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    about = classes.select("set_key", "cid", "copies", "rep", "fp").join(links, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    about = materialize(about.withColumn("component", F.coalesce("component", "cid")), "about")
    low = materialize(about.groupBy("component").agg(F.min(F.struct(F.col("rep").alias("low"), F.col("fp").alias("low_fp"))).alias("l")).select("component", "l.*"), "low")
    about = materialize(about.join(low, "component").select("set_key", F.col("rep").alias("class_id"), "low", "low_fp", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "about")
    for t in (*tables, classes, profile, wanted, sizes, need, found, links, parts, low):
        discard(t)
    out = sig.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("set_key")).alias("set_key")).join(about, "set_key", "left")
    first = F.coalesce((F.col("id") == F.col("low")) & (F.col("fp") == F.col("low_fp")), F.lit(True))
    fp = ["fp"] if with_fp else []
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "id").alias("component_id"), first.alias("kept"), *fp)


def op6_jaccard_join(spark, sf_dir) -> DataFrame:
    out = jaccard_join(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links", "component_id", "kept")
