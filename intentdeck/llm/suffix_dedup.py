"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Which 100-byte strings can repeat at all is found by content-chosen anchors: every such string holds the k-gram with the smallest
hash among its k-grams, so equal strings have equal anchors, and an anchor with the run of windows that chose it is a short context.
Contexts that are equal as a whole need no index: all but the first are repeats. Different contexts of one anchor whose bytes agree
on one side of it at least are indexed: shards of them are sorted on their own, and their transforms are merged by iterative interleave refinement. A round
deals the current interleave by the transforms' next symbols, which sorts by four more bytes each time without touching a suffix; where neighbours
part in a round gives their common prefix. The blocks of common prefix 100 are the repeated intervals; all but the first in
document order are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intentdeck.llm._common import discard, materialize, read_table, release

LENGTH = 100
GRAM = 24
#: Bytes of contexts that are merged at a time (an anchor's contexts stay together).
MERGE_BYTES = 60_000
SHARDS = 4
#: Different contexts of one anchor that are merged in one task; those of an anchor with more are compared block by block.
MOST_CONTEXTS = 8_000
#: No byte of UTF-8: ends each context.
END = 0xFF
LOWEST = -(1 << 63)
#: Share of all anchors from which one is hot, so that its rows are not brought together.
HOT_SHARE = 0.001
#: Windows of a text that are looked at at a time.
PIECE = 1 << 20


def gram_hashes(t, k: int = GRAM):
    """A 64-bit hash of each k-gram of a byte array (k = 24)."""
    import numpy as np

    c = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = (t.astype("u8") + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        p, n, powers = c, 1, {}
        while n < 16:
            powers[n] = (h, p)
            h = h[: len(h) - n] * p + h[n:]
            p, n = p * p, 2 * n
            if n == 8:
                eight, eight_power = h, p
        m = len(t) - k + 1
        h = h[:m] * eight_power + eight[16 : 16 + m]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def anchors(t, length: int = LENGTH, k: int = GRAM, lo: int = 0, hi: int | None = None):
    """(gram hash, sides, first window, its place in that window, windows) of each anchor of the windows lo to hi of one text's bytes, in order; empty for texts shorter than length.

    sides: 32 bits each of hashes of the bytes to the left and to the right of the anchor, half of what a window holds beside it, 0 where the text
    ends before. A window holds one of the two whole, so windows can be equal only where their anchors have an equal side.
    """
    import numpy as np

    half = (length - k) // 2
    last = len(t) - length + 1
    hi = last if hi is None else min(hi, last)
    if hi <= lo:
        return np.zeros(0, "u8"), np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    base = max(0, lo - half)
    h = gram_hashes(t[base : hi + length - 1 + half], k)
    width = length - k + 1
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype="u8")  # the leftmost of equal hashes
    m, span = v[lo - base :], 1
    while span * 2 <= width:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    n = hi - lo
    low = np.minimum(m[:n], m[width - span : width - span + n])
    at = (low & np.uint64(0xFFFFFFFF)).astype("i8")
    first = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
    p = at[first]
    steps = sorted({*range(half, k, -k), min(k, half)})
    sides = np.zeros(len(p), "u8")
    for sign, shift in ((-1, 32), (1, 0)):
        end = p + sign * half
        ok = (end >= 0) & (end < len(h))
        x = np.zeros(int(ok.sum()), "u8")
        with np.errstate(over="ignore"):
            for d in steps:
                x = (x ^ h[p[ok] + sign * d]) * np.uint64(0x9E3779B97F4A7C15)
        sides[ok] |= np.maximum(x >> np.uint64(32), np.uint64(1)) << np.uint64(shift)
    return h[p], sides, first + lo, p + base - first - lo, np.diff(np.append(first, n))


def _occurrences(docs: DataFrame, length: int, hot: frozenset[int] | None) -> DataFrame:
    """(gram, ctx, sides, doc, fp, at, hot) of every anchor of every text; at: first window, the anchor's place in it, windows.

    With hot None: (gram, n), the anchors that are frequent within some piece of the input, and under gram null how many anchors there are.
    """
    schema = "gram long, ctx long, sides long, doc long, fp long, at long, hot boolean" if hot is not None else "gram long, n long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        known = np.array(sorted(hot or ()), "i8")

        def settle(out: list) -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            if hot is None:
                gram, n = np.unique(cols[0], return_counts=True)
                many = n >= max(4, HOT_SHARE / 2 * len(cols[0]))
                return pa.RecordBatch.from_arrays([pa.array([None, *gram[many].tolist()], pa.int64()), pa.array([len(cols[0]), *n[many].tolist()], pa.int64())], names)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in [*cols, np.isin(cols[0], known)]], names)

        out, size = [], 0
        for b in batches:
            for doc, fp, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                t = np.frombuffer(body, "u1")
                for lo in range(0, max(0, len(t) - length + 1), PIECE):
                    gram, sides, first, o, n = anchors(t, length, lo=lo, hi=lo + PIECE)
                    if hot is None:
                        out.append((gram.view("i8"),))
                    else:
                        ends = (first + n + (length - 1)).tolist()
                        ctx = np.fromiter((xxhash.xxh3_64_intdigest(body[s:e]) for s, e in zip(first.tolist(), ends, strict=True)), "u8", len(gram))
                        out.append((gram.view("i8"), ctx.view("i8"), sides.view("i8"), np.full(len(gram), doc), np.full(len(gram), fp), first << 20 | o << 10 | n))
                    size += len(gram)
                    if size > 200_000:
                        yield settle(out)
                        out, size = [], 0
        if out:
            yield settle(out)

    return docs.select("doc", "fp", "body").mapInArrow(run, schema)


def hot_anchors(docs: DataFrame, length: int) -> frozenset[int]:
    """The anchors that make up HOT_SHARE or more of all: at most 1 / HOT_SHARE of them, whatever the input."""
    found = _occurrences(docs, length, None).groupBy("gram").agg(F.sum("n").alias("n"))
    found = materialize(found, "frequent")
    total = found.where("gram is null").first()
    hot = [r[0] for r in found.where(F.col("gram").isNotNull() & (F.col("n") >= HOT_SHARE * total[1])).select("gram").collect()] if total else []
    discard(found)
    return frozenset(hot)


def shard_order(text, begin, size, at, depth: int):
    """Positions ``at`` of a shard's strings sorted by their next ``depth`` symbols (cyclic within a string), ties by position."""
    import numpy as np

    b, n = begin[at], size[at]
    rank = np.zeros(len(text), "i8")
    first = np.zeros(len(at), "u8")
    for k in range(8):
        first = (first << np.uint64(8)) | text[b + (at - b + k) % n]
    rank[at] = np.unique(first, return_inverse=True)[1]
    span = 8
    while True:
        ahead = b + (at - b + span) % n
        key = rank[at] * np.int64(len(text) + 257) + rank[ahead]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        span *= 2
        if span >= depth or new[-1] == len(at) - 1:
            return at[order]
        rank[at[order]] = new


def merge_transforms(shards, text, begin, size, depth: int):
    """(positions in merged order, common prefix with the one before, cut at depth) of shards of sorted positions.

    Only the shards' transforms (the four bytes before each suffix; two where they are too many for 16-bit symbols) and the interleave are
    used in the rounds, so depth is a multiple of four.
    """
    import numpy as np

    sa = np.concatenate(shards)
    b, n = begin[sa], size[sa]
    prev = [text[b + (sa - b - k) % n].astype("u4") for k in (4, 3, 2, 1)]
    transform = (prev[0] << 24) | (prev[1] << 16) | (prev[2] << 8) | prev[3]
    step = 4
    values, ranks = np.unique(transform, return_inverse=True)  # small symbols in the same order
    if len(values) > 1 << 16:
        step, ranks = 2, transform & np.uint32(0xFFFF)
    transform = ranks.astype("u2")
    z = np.repeat(np.arange(len(shards), dtype="u1"), [len(s) for s in shards])
    block = np.zeros(len(z), "i4")
    lcp = np.full(len(z), -1, "i2")
    lcp[:1] = 0
    for r in range(0, depth, step):
        symbols = np.empty(len(z), "u2")
        symbols[np.argsort(z, kind="stable")] = transform  # each place takes its shard's next symbols
        order = np.argsort(symbols, kind="stable")
        z2, s, blk = z[order], symbols[order], block[order]
        part = (s[1:] != s[:-1]) | (blk[1:] != blk[:-1])
        fresh = np.nonzero(part & (lcp[1:] < 0))[0] + 1
        lcp[fresh] = r
        same = not len(fresh) and np.array_equal(z2, z)
        z = z2
        block[1:] = np.cumsum(part)
        block[:1] = 0
        if same:
            break
    merged = np.empty(len(z), "i8")
    merged[np.argsort(z, kind="stable")] = sa
    lcp[lcp < 0] = depth
    return merged, lcp


def repeats(contexts: list[bytes], order: list[tuple], windows: list[int], length: int = LENGTH, shards: int = SHARDS) -> list[tuple[int, int, int]]:
    """(context, first window, windows) runs whose string of ``length`` bytes also begins earlier.

    order: (doc, fp, start) of each context's first byte, which decides what is earlier.
    """
    import numpy as np

    text = np.frombuffer(b"".join(c + bytes([END]) for c in contexts), "u1")
    sizes = np.array([len(c) + 1 for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(contexts)), sizes)
    begin, size = starts.astype("i4")[owner], sizes.astype("i4")[owner]
    place = np.arange(len(text))
    cut = np.linspace(0, len(text), shards + 1)
    shard_of = np.searchsorted(cut, starts[owner], side="right") - 1
    parts = [shard_order(text, begin, size, place[shard_of == s], length) for s in range(shards) if (shard_of == s).any()]
    merged, lcp = merge_transforms(parts, text, begin, size, length)
    interval = np.cumsum(lcp < length)
    who = owner[merged]
    offset = merged - starts[who]
    ok = offset < np.array(windows)[who]
    interval, who, offset = interval[ok], who[ok], offset[ok]
    rank = np.empty(len(order), "i8")
    rank[sorted(range(len(order)), key=lambda i: order[i][:2])] = np.arange(len(order))
    docs = {}
    doc = np.array([docs.setdefault(o[:2], len(docs)) for o in order])
    by_doc = np.array([rank[i] for i in range(len(order))])
    lowest = np.full(len(docs), len(order), "i8")
    np.minimum.at(lowest, doc, by_doc)
    doc_rank = lowest[doc][who]
    where = np.array([o[2] for o in order], "i8")[who] + offset
    o = np.lexsort((where, doc_rank, interval))
    interval, who, offset = interval[o], who[o], offset[o]
    again = np.concatenate([[False], interval[1:] == interval[:-1]])
    who, offset = who[again], offset[again]
    o = np.lexsort((offset, who))
    who, offset = who[o], offset[o]
    if not len(who):
        return []
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (offset[1:] != offset[:-1] + 1)])
    at = np.nonzero(new)[0]
    return list(zip(who[at].tolist(), offset[at].tolist(), np.diff(np.append(at, len(who))).tolist(), strict=True))


def _repeats_of_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, fp, first, n): repeated runs among contexts (gram, doc, fp, first, n, body), which lie together and in order of their gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            rows = list({r[:4]: r for r in rows}.values())  # rows that repeat a document
            got = repeats([r[5] for r in rows], [(r[1], r[2], r[3]) for r in rows], [r[4] for r in rows], length) if rows else []
            cols = [[rows[i][1] for i, _, _ in got], [rows[i][2] for i, _, _ in got], [rows[i][3] + o for i, o, _ in got], [n for _, _, n in got]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc", "fp", "first", "n"])

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if size > MERGE_BYTES and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        yield settle(held)

    return contexts.select("gram", "doc", "fp", "first", "n", "body").mapInArrow(run, "doc long, fp long, first int, n int")


def _repeats_of_blocks(contexts: DataFrame, length: int, held: list[DataFrame]) -> DataFrame:
    """What _repeats_of_contexts() gives, for contexts (gram, doc, fp, first, o, n, body) of anchors with any number of them; o: the anchor's place in the first window.

    Contexts are cut at the same places relative to the anchor into ever smaller blocks of windows. Of equal blocks all but the first repeat as a whole. The first,
    which stands for them, is cut on if another block of its anchor and place holds the bytes that all its windows share. Single windows are the last blocks. Equality goes by
    128 bits of hashes. Firsts are aggregations that start on the map side, and joins read written tables, so no task holds an anchor's contexts. Tables that the result
    reads are added to held.
    """
    rows = contexts.select("gram", "doc", "fp", "first", "n", (-F.col("o")).alias("u"), "body")
    runs = None
    zero, size = 1 << 12, 32  # a multiple of all sizes beyond every place
    while size:
        cut = rows.select("*", F.explode(F.sequence(F.floor((F.col("u") + zero) / size), F.floor((F.col("u") + F.col("n") - 1 + zero) / size))).alias("b"))
        begin, end = F.col("b") * size - zero, (F.col("b") + 1) * size - zero
        cut = cut.withColumn("v", F.greatest(F.col("u"), begin)).withColumn("m", F.least(F.col("u") + F.col("n"), end) - F.col("v"))
        cut = cut.withColumn("first", F.col("first") + F.col("v") - F.col("u")).withColumn("body", F.substring("body", (F.col("v") - F.col("u") + 1).cast("int"), (F.col("m") + length - 1).cast("int")))
        shared = F.substring("body", (end - F.col("v")).cast("int"), F.lit(length - size + 1)) if size <= length else F.lit(b"")
        cut = cut.select("gram", "doc", "fp", F.col("first").cast("int").alias("first"), F.col("m").cast("int").alias("n"), F.col("v").alias("u"), "body", F.xxhash64("gram", "b", shared).alias("shared"), F.xxhash64("gram", "v", "m", "body").alias("key"), F.xxhash64("body", F.lit(size)).alias("key2"))
        cut = materialize(cut, "blocks", compression="zstd")
        lead = materialize(cut.groupBy("key", "key2").agg(F.min(F.struct("doc", "fp", "first")).alias("lead")), "lead")
        known = materialize(cut.join(lead, ["key", "key2"]), "known", compression="zstd")
        held += [cut, lead, known]
        at = F.struct("doc", "fp", "first")
        again = known.where(at > F.col("lead")).select("doc", "fp", "first", "n")
        runs = again if runs is None else runs.unionByName(again)
        more = materialize(known.where(at == F.col("lead")).groupBy("shared").agg(F.count("*").alias("c")).where("c > 1").select("shared"), "shared")
        held.append(more)
        rows = known.where(at == F.col("lead")).join(more, "shared").select("gram", "doc", "fp", "first", "n", "u", "body")
        size //= 2
    return runs


def removed_spans(n_bytes: int, runs: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal (start, end) byte spans that windows of runs (first, n) cover."""
    out: list[list[int]] = []
    for first, n in sorted(runs):
        end = first + n - 1 + length
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(s, min(e, n_bytes)) for s, e in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row; with_text adds the bytes that are left.

    Earlier means a smaller doc_id, or the same row and an earlier start; a null doc_id is smaller than any. Rows of equal doc_id and
    different text are ordered by a hash of the text; rows equal in both get the result of one. Null texts are empty; texts
    shorter than ``length`` bytes lose nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc"), F.xxhash64(body).alias("fp"), body.alias("body"))
    # a hot anchor's rows are dealt to all partitions; what is not the first of its context there repeats, and only the firsts of the partitions are brought together
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    occurrences = _occurrences(src, length, hot_anchors(src, length))
    deal = F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "at"), F.lit(deals))).otherwise(0)
    left, right = F.when(F.shiftrightunsigned("sides", 32) != 0, F.shiftrightunsigned("sides", 32)), F.when(F.col("sides").bitwiseAND(0xFFFFFFFF) != 0, F.col("sides").bitwiseAND(0xFFFFFFFF))
    alike = ("gram", "deal")
    several = lambda *by: F.min("ctx").over(Window.partitionBy(*alike, *by)) != F.max("ctx").over(Window.partitionBy(*alike, *by))
    seen = occurrences.withColumn("deal", deal).repartition(*alike)
    seen = seen.withColumn("k", F.rank().over(Window.partitionBy(*alike, "ctx").orderBy("doc", "fp", "at"))).withColumn("many", several())
    seen = seen.where("hot or k > 1 or many").withColumn("left", left).withColumn("right", right)
    seen = seen.withColumn("twin", several("left") & F.col("left").isNotNull()).withColumn("twin", F.col("twin") | (several("right") & F.col("right").isNotNull()))
    seen = seen.withColumn("contexts", F.sum(F.when((F.col("k") == 1) & F.col("twin"), 1).otherwise(0)).over(Window.partitionBy(*alike)))
    seen = seen.where("hot or k > 1 or twin").withColumn("first", F.shiftright("at", 20).cast("int")).withColumn("o", F.shiftright("at", 10).bitwiseAND(1023).cast("int")).withColumn("n", F.col("at").bitwiseAND(1023).cast("int"))
    seen = materialize(seen.select("gram", "ctx", "left", "right", "doc", "fp", "first", "o", "n", "hot", "k", "contexts"), "repeated", compression="zstd")
    release(spark)
    spans = ["doc", "fp", "first", "n"]
    plain = seen.where("not hot")
    whole = seen.where("k > 1").select(*spans)
    hot = seen.where("hot and k = 1")
    crowded = plain.where((F.col("k") == 1) & (F.col("contexts") > most_contexts)).select("gram", "o", *spans)
    held: list[DataFrame] = [seen]
    if not hot.isEmpty():
        lead = hot.groupBy("gram", "ctx").agg(F.min(F.struct(*spans, "o", "left", "right")).alias("lead"))
        lead = materialize(lead, "lead")
        again = hot.join(lead.select("gram", "ctx", "lead"), ["gram", "ctx"]).where(F.struct("doc", "fp", "first") > F.struct("lead.doc", "lead.fp", "lead.first"))
        whole = whole.unionByName(again.select(*spans))
        one = lead.select("gram", "ctx", "lead.*")
        held.append(lead)
        for side in ("left", "right"):
            more = materialize(one.where(F.col(side).isNotNull()).groupBy("gram", side).agg(F.count("*").alias("c")).where("c > 1").select("gram", side), "sides")
            crowded = crowded.unionByName(one.join(more, ["gram", side]).select("gram", "o", *spans))
            held.append(more)
    # the bytes of the first of each context whose anchor has others
    texts = src.select("doc", "fp", "body")

    def bodies(anchors_: DataFrame) -> DataFrame:
        wanted = anchors_.dropDuplicates(["gram", "doc", "fp", "first"]).groupBy("doc", "fp").agg(F.collect_list(F.struct("gram", "first", "o", "n")).alias("w"))
        cut = texts.join(wanted, ["doc", "fp"]).select("doc", "fp", "body", F.explode("w").alias("w"))
        return cut.select("w.gram", "doc", "fp", "w.first", "w.o", "w.n", F.substring(F.col("body"), F.col("w.first") + 1, F.col("w.n") + length - 1).alias("body"))

    few = plain.where((F.col("k") == 1) & (F.col("contexts") <= most_contexts)).select("gram", "o", *spans)
    apart = _repeats_of_contexts(bodies(few).repartition("gram").sortWithinPartitions("gram"), length)
    if not crowded.isEmpty():
        apart = apart.unionByName(_repeats_of_blocks(bodies(crowded), length, held))
    runs = whole.unionByName(apart).groupBy("doc", "fp").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    runs = materialize(runs, "runs", compression="zstd")
    for table in held:
        discard(table)
    release(spark)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for i, text, w in zip(*[c.to_pylist() for c in b.columns], strict=True):
                spans = removed_spans(len(text), [(r["first"], r["n"]) for r in w or []], length)
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                left = b"".join([*kept, text[at:]])
                for c, v in zip(cols, (i, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            n = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds, strict=False)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:n])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return src.join(runs, ["doc", "fp"], "left").select("id", "body", "runs").mapInArrow(finish, schema)


def op9_suffix_dedup(spark, sf_dir) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"))
