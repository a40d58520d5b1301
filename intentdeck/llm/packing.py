"""Best-fit packing of tokenised documents into fixed-length sequences, in bulk-synchronous sweeps.

Documents are taken by halves of the capacity, the longest first. In a round the waiting documents and the gaps of all open sequences are range-sorted by
size together, and every range is swept from its largest size down: a gap goes on a stack, a document takes the top one, its successor, the smallest gap that holds it. What
that leaves of the gap stays on top while the next document fits. The documents that found no gap in their range and the gaps that were not asked for keep their rank in it; from the
two counts of each range follows which ranks of documents meet which ranks of gaps of larger ranges (the nearest first), a table of two rows a range. Gaps
shrink, and rounds repeat until one places few of those that wait; these open new sequences, filled in order of size.
"""

from __future__ import annotations

import json
import math
import re
import sys
import types
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intentdeck.llm._common import discard, materialize, read_table

CAPACITY = 1024
END_ID = 2
#: Documents and gaps in a range of the sort.
RANGE_ROWS = 20_000
#: A round that places less than this share of the waiting documents is the last of their size.
LEAST_PLACED = 0.02
#: Unicode's white space; a run of this many is encoded as the pieces that the pattern would give, which backtracks over runs.
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{2000,}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """The ids of a byte-level BPE file of `tokenizers`: of byte strings, and of its added tokens, which stand for themselves in a text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level files write these bytes as themselves
    table = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(table[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}, added


def worker_memo(key: str, make: Callable):
    """One object for each Python worker process, kept from task to task."""
    held = sys.modules.setdefault("_intentdeck_memo", types.ModuleType("_intentdeck_memo")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def text_encoder(path: str) -> Callable[[str], bytes]:
    """encode(text) -> little-endian uint32 bytes of its ids, equal to those of `tokenizers` for the file at path.

    The merges of the file are read into tiktoken, which gives the same ids in a fifth of the time (tests compare them).
    """
    import public_tokenizers
    import tiktoken

    ranks, added = vocabulary(path)
    bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)")

    def plain(text: str) -> list[int]:
        ids, at = [], 0
        for m in LONG_BLANK.finditer(text):
            end = m.end() - (m.end() < len(text))  # the last blank goes to what follows
            ids += bpe.encode_ordinary(text[at : m.start()])
            ids += bpe._encode_single_piece(text[m.start() : end])
            at = end
        return ids + bpe.encode_ordinary(text[at:])

    def encode(text: str) -> bytes:
        ids, at = [], 0
        for m in special.finditer(text):
            ids += [*plain(text[at : m.start()]), added[m.group()]]
            at = m.end()
        return array("I", ids + plain(text[at:])).tobytes()

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones, but for a shorter first."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(i, capacity) for i in range(first, n, capacity)]


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece of each document's ids with end_id after them; with_ids adds the ids themselves.

    A null text is the empty one (a piece of one id). Null and repeated doc_ids keep their rows.
    """
    path = path or tokenizer_path()
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode, end = worker_memo(f"encode {path}", lambda: text_encoder(path)), np.array([end_id], "<u4").tobytes()
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = memoryview(ids)[4 * start : 4 * (start + n)]
                    for c, v in zip(cols, (i, k, start, n, zlib.crc32(part), np.frombuffer(part, "<u4").astype("i4") if with_ids else None), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 if with_ids else 5]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: len(kinds)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _sweep(docs: DataFrame, gaps: DataFrame, most: int, ranges: int, capacity: int) -> DataFrame:
    """One sweep of docs (id, size <= most) over gaps (id, size): rows (kind, part, rank, id, size, seq, at) of four kinds.

    p: a document placed in sequence seq at offset at. d: one that found no gap, with its rank in its range. g: a gap that nobody asked for, its rank counted
    in documents of size most, from the smallest gap of the range on. r: what is left of the gaps that were hit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        stack: list[list[int]] = []  # [sequence, size, whether it was hit]
        waiting = 0

        def rows() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["kind", "part", "rank", "id", "size", "seq", "at"])

        for b in batches:
            for is_doc, i, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not is_doc:
                    stack.append([i, size, False])
                    continue
                while stack and stack[-1][1] < size:  # hit before, and too small by now
                    seq, left, _ = stack.pop()
                    out.append(("r", part, None, seq, left, None, None))
                if not stack:
                    out.append(("d", part, waiting, i, size, None, None))
                    waiting += 1
                    continue
                top = stack[-1]
                out.append(("p", part, None, i, size, top[0], capacity - top[1]))
                top[1], top[2] = top[1] - size, True
                if not top[1]:
                    stack.pop()
            if len(out) >= 10_000:
                yield rows()
                out.clear()
        rank = 0
        for seq, size, hit in reversed(stack):
            out.append(("r", part, None, seq, size, None, None) if hit else ("g", part, rank, seq, size, None, None))
            rank += 0 if hit else max(1, size // most)
        yield rows()

    both = docs.select(F.lit(True).alias("is_doc"), "id", "size").unionByName(gaps.select(F.lit(False).alias("is_doc"), "id", "size"))
    order = [F.desc("size"), "is_doc", "id"]  # at equal size the gap comes first
    return both.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(run, "kind string, part int, rank long, id long, size int, seq long, at int")


def _meet(waiting: dict[int, int], free: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(range of documents, first rank, range of gaps, first rank, how many) for the counts of waiting documents and free places by range, the largest sizes in range 0."""
    out, stack = [], []
    for part in sorted({*waiting, *free}):
        rank, left = 0, waiting.get(part, 0)
        while left and stack:
            of, first, n = stack.pop()
            take = min(n, left)
            out.append((part, rank, of, first, take))
            if n > take:
                stack.append((of, first + take, n - take))
            rank, left = rank + take, left - take
        if free.get(part):
            stack.append((part, 0, free[part]))
    return out


def _open(docs: DataFrame, ranges: int, capacity: int) -> DataFrame:
    """(id, seq, at, size) of docs (id, size) in new sequences, each range filled in order of size; a sequence has the id of its first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, at = None, capacity
        for b in batches:
            seqs, ats = [], []
            for i, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if at + size > capacity:
                    seq, at = i, 0
                seqs.append(seq)
                ats.append(at)
                at += size
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seqs, pa.int64()), pa.array(ats, pa.int32()), b.column(1)], ["id", "seq", "at", "size"])

    order = [F.desc("size"), "id"]
    return docs.select("id", "size").repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(run, "id long, seq long, at int, size int")


def pack(pieces: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (length, ...; 1 <= length <= capacity).

    A sequence's pieces lie without gaps from 0; its id is a number without meaning. Rows may repeat; an empty table gives an empty one. Columns named
    sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    number = "_pid"
    while number in pieces.columns:
        number += "_"
    pieces = materialize(pieces.drop("sequence_id", "offset").withColumn(number, F.monotonically_increasing_id()), "numbered")  # written, so that numbers stay
    docs = pieces.select(F.col(number).alias("id"), F.col("length").cast("int").alias("size"))
    bounds = [capacity]
    while bounds[-1]:
        bounds.append(bounds[-1] // 2)
    classes = list(zip(bounds[1:], bounds[:-1], strict=True))  # documents longer than the first and up to the second
    level = F.lit(0)
    for k, (low, _) in enumerate(classes):
        level = F.when(F.col("size") <= low, F.lit(k + 1)).otherwise(level)
    many = {r[0]: r[1] for r in docs.groupBy(level.alias("k")).count().collect()}  # a row for each halving of the capacity
    cols = ["id", "seq", "at"]
    # no two of the first class go together
    placed = [docs.where(F.col("size") > classes[0][0]).select("id", F.col("id").alias("seq"), F.lit(0).alias("at"))]
    gaps = materialize(docs.where((F.col("size") > classes[0][0]) & (F.col("size") < capacity)).select("id", (capacity - F.col("size")).cast("int").alias("size")), "gaps")
    used = []  # tables that go when all is placed
    for k, (low, most) in enumerate(classes[1:], 1):
        waits, n = docs.where((F.col("size") > low) & (F.col("size") <= most)), many.get(k, 0)
        if not n:
            continue
        free, old = gaps.where(F.col("size") > low), gaps
        aside = gaps.where(F.col("size") <= low)
        while n:
            ranges = max(1, math.ceil((n + free.count()) / range_rows))
            swept = materialize(_sweep(waits, free, most, ranges, capacity), "swept")
            used.append(swept)
            places = F.greatest(F.lit(1), F.floor(F.col("size") / most)).cast("long")
            # two rows for each range
            counts = swept.groupBy("kind", "part").agg(F.count("*").alias("n"), F.sum(places).alias("places")).where("kind <> 'r'").collect()
            left = {r["part"]: r["n"] for r in counts if r["kind"] == "d"}
            plan = _meet(left, {r["part"]: r["places"] for r in counts if r["kind"] == "g"})
            placed.append(swept.where("kind = 'p'").select(*cols))
            hit, unasked, unmet = swept.where("kind = 'r'").select("id", "size"), swept.where("kind = 'g'"), swept.where("kind = 'd'")
            if plan:
                meet = spark.createDataFrame(plan, "part int, first long, of int, to long, n long")
                taken = meet.groupBy(F.col("of").alias("part")).agg(F.sum("n").alias("taken"))
                ask = unmet.join(F.broadcast(meet), "part").where("rank >= first and rank < first + n").select(F.col("of").alias("part"), (F.col("to") + F.col("rank") - F.col("first")).alias("place"), F.col("id").alias("doc"), F.col("size").alias("length"))
                last = F.least(F.col("rank") + places, F.col("taken")) - 1
                give = unasked.join(F.broadcast(taken), "part").where("rank < taken").select("part", F.explode(F.sequence(F.col("rank"), last)).alias("place"), "id", "size")
                by = Window.partitionBy("id").orderBy("place")  # at most capacity rows
                length = F.sum("length").over(by)
                got = materialize(ask.join(give, ["part", "place"]).select(F.col("doc").alias("id"), F.col("id").alias("seq"), (capacity - F.col("size") + length - F.col("length")).cast("int").alias("at"), F.col("length")), "met")
                used.append(got)
                placed.append(got.select(*cols))
                gone = got.groupBy(F.col("seq").alias("id")).agg(F.sum("length").alias("gone"))
                unasked = unasked.join(gone, "id", "left").select("id", (F.col("size") - F.coalesce("gone", F.lit(0))).cast("int").alias("size")).where("size > 0")
                met = spark.createDataFrame([(p, sum(m[4] for m in plan if m[0] == p)) for p in {m[0] for m in plan}], "part int, met long")
                unmet = unmet.join(F.broadcast(met), "part", "left").where("rank >= coalesce(met, 0)")
            waits, before, n = unmet.select("id", "size"), n, sum(left.values()) - sum(m[4] for m in plan)
            free = unasked.select("id", "size").unionByName(hit)
            if n and before - n < LEAST_PLACED * before:
                break
        new = [free, aside]
        if n:
            opened = materialize(_open(waits, max(1, math.ceil(n / range_rows)), capacity), "opened")
            used.append(opened)
            placed.append(opened.select(*cols))
            new.append(opened.groupBy(F.col("seq").alias("id")).agg((capacity - F.sum("size")).cast("int").alias("size")).where("size > 0"))
        gaps = new[0]
        for g in new[1:]:
            gaps = gaps.unionByName(g)
        gaps = materialize(gaps, "gaps")
        discard(old)
    discard(gaps)
    where = placed[0]
    for t in placed[1:]:
        where = where.unionByName(t)
    where = materialize(where.select(F.col("id").alias(number), F.col("seq").alias("sequence_id"), F.col("at").cast("long").alias("offset")), "placed")
    for t in used:
        discard(t)
    return pieces.join(where, number).drop(number)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack. The pieces are written once to the shared folder, so ids are made once."""
    return pack(tokenize_pieces(docs, capacity=capacity, path=path, with_ids=with_ids), capacity)


def op2_best_fit_packing(spark, sf_dir) -> DataFrame:
    out = pack_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
