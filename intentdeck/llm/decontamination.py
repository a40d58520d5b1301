"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of lower-case words. The CGK walk of a window reads its words from the left, and after each step a
random bit of (step, word) says whether to move on to the next word, so that windows of small edit distance walk over the same words in step again
after each edit: edit distance becomes Hamming distance between walks. Each repetition draws a walk and samples
a few steps; windows and items that agree on the sampled steps are candidates.

Walks drift apart with every edit, so items are cut into pieces of some 7 to 10 words, with walks started in each: where an item lies within
e edits, one of its P pieces lies within e // P. Repetitions go on until at most MISS of simulated pieces at that distance are missed, for each kind of
edit. Candidates are verified by their exact edit distance, first of the piece, then of the item around it.

Exact necessary conditions spare most windows the walk: words that no item has can match none, so a window with more of them than
the allowed edits is out; an edit breaks at most two word pairs, so a window without enough pairs that items have is out; and a sampled step that no
item has there ends the window's repetition.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentdeck.llm._common import materialize, read_table

#: Share of an item's words that may be edited.
EDITS = 0.2
#: Sampled steps of a repetition.
SAMPLES = 3
#: The fewest words of a piece of an item that is cut.
PIECE = 7
#: The share of simulated pieces at the allowed distance that may be missed, for each kind of edit, and how many are simulated.
MISS, TRIALS = 0.005, 1000
#: More repetitions than any sensible setting needs; an index that would need more raises.
MOST_REPETITIONS = 1000
#: Items that are matched in one pass over the documents; more items take more passes.
ITEMS_PER_PASS = 20_000
#: Slots of the table of word pairs that items have.
PAIR_SLOTS = 1 << 23
WORD = re.compile(r"\w+")
FOUND = "doc_id long, item_id long, start_word int, n_words int, edits int, similarity double"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def edit_rows(item, windows):
    """For each row of windows (word ids, padded with -1): the edit distances of item to all its prefixes."""
    import numpy as np

    idx = np.arange(windows.shape[1] + 1, dtype="i4")
    row = np.repeat(idx[None, :], len(windows), axis=0)
    for i, x in enumerate(item, 1):
        cand = np.empty_like(row)
        cand[:, 0] = i
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (windows != x), out=cand[:, 1:])
        row = np.minimum.accumulate(cand - idx, axis=1) + idx  # insertions
    return row


def best_run(item, text) -> tuple[int, int, int]:
    """(edits, start, words) of the run of text that is nearest to item; ties go to the first start, then to the shortest."""
    import numpy as np

    idx = np.arange(len(text) + 1, dtype="i4")
    row = np.zeros(len(text) + 1, "i4")  # a run may start anywhere
    for i, x in enumerate(item, 1):
        cand = np.empty_like(row)
        cand[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (text != x), out=cand[1:])
        row = np.minimum.accumulate(cand - idx) + idx
    least = int(row.min())
    ends = np.nonzero(row == least)[0]
    width, best = len(item) + least, None
    chunk = max(1, 2_000_000 // (width + 1))
    for lo in range(0, len(ends), chunk):
        some = ends[lo : lo + chunk]
        place = some[:, None] - 1 - np.arange(width)[None, :]
        back = edit_rows(item[::-1], np.where(place >= 0, text[np.maximum(place, 0)], -1) if len(text) else np.full(place.shape, -1, "i4"))
        back = np.where(np.arange(width + 1)[None, :] <= some[:, None], back, least + 1)
        words = width - np.argmax(back[:, ::-1] == least, axis=1)  # the longest at that distance starts first
        at = int(np.lexsort((words, some - words))[0])
        found = (int(some[at] - words[at]), int(words[at]))
        best = found if best is None else min(best, found)
    return least, *best


@dataclass(frozen=True)
class Part:
    """A piece of an item, or all of a short one."""

    item: int  # position in the index
    offset: int  # words of the item before it
    allowed: int  # edits of the piece


@dataclass(frozen=True)
class Band:
    """Pieces of like size, which share windows of one size."""

    parts: tuple[int, ...]  # positions in the index
    least: int  # words that any match must hold in its window
    edits: int  # the most edits that any of them allows
    pairs: int  # the fewest word pairs that any match shares with its piece
    reach: int  # words within which they lie


def padded(seqs, width: int, fill: int):
    import numpy as np

    out = np.full((len(seqs), width), fill, "i4")
    for row, q in zip(out, seqs, strict=True):
        row[: len(q)] = q
    return out


class ItemIndex:
    """Walk samples of every piece by repetition."""

    def __init__(self, items: list[tuple[int, str | None]], edits: float = EDITS, samples: int = SAMPLES, miss: float = MISS, seed: int = 3):
        import numpy as np

        seqs = [(i, words_of(t)) for i, t in items]
        seqs = [(i, w) for i, w in seqs if w]  # an item without words matches nothing
        self.ids = [i for i, _ in seqs]
        self.vocab = {w: k for k, w in enumerate(sorted({w for _, s in seqs for w in s}), 1)}  # 0: a word of no item
        self.base = len(self.vocab) + 2
        self.seqs = [np.array([self.vocab[w] for w in s], "i4") for _, s in seqs]
        self.allowed = [int(edits * len(s)) for s in self.seqs]
        self.parts: list[Part] = []
        self.pieces: list = []
        by: dict[tuple[int, int], list[int]] = {}
        for k, (s, e) in enumerate(zip(self.seqs, self.allowed, strict=True)):
            n = max(1, min(e // 2 + 1, len(s) // PIECE))
            for c in range(n):
                piece = s[len(s) * c // n : len(s) * (c + 1) // n]
                by.setdefault((e // n, len(piece) // 3), []).append(len(self.parts))
                self.parts.append(Part(k, len(s) * c // n, e // n))
                self.pieces.append(piece)
        self.bands = []
        for (t, _), v in sorted(by.items()):
            sizes = [len(self.pieces[k]) for k in v]
            self.bands.append(Band(tuple(v), min(sizes) - t, t, max(0, min(sizes) - 1 - 2 * t), max(sizes) + t))
        self.pair_table = np.zeros(PAIR_SLOTS, bool)
        for q in self.pieces:
            self.pair_table[self.pair_slots(q)] = True
        rng = random.Random(seed)
        self.runs = []
        for band in self.bands:
            span = band.least + band.edits  # a walk of so many steps ends within every piece, so exact copies are never missed
            pieces = padded([self.pieces[k] for k in band.parts], max(len(self.pieces[k]) for k in band.parts), -1)
            kinds, clean, edited, starts = self.trials(band, rng, span)
            open_ = np.arange(len(kinds))
            done = 0
            while len(open_) and np.bincount(kinds[open_]).max() > miss * TRIALS:
                if done == MOST_REPETITIONS:
                    raise ValueError(f"{done} repetitions miss too many pieces within {band.edits} edits of {band.least + band.edits} words")
                done += 1
                steps = sorted(rng.sample(range(span), min(samples, span)))
                bits = np.random.default_rng(rng.getrandbits(32)).integers(0, 2, (steps[-1] + 1, len(self.vocab) + 1), dtype="i1")
                walks = self.walks(pieces, 0, steps, bits)
                order = np.argsort(walks[:, -1], kind="stable")
                self.runs.append((band, steps, bits, [np.unique(walks[:, d]) for d in range(len(steps))], walks[order, -1], np.array(band.parts)[order]))
                own = self.walks(clean[open_], 0, steps, bits)[:, -1]
                hit = np.zeros(len(open_), bool)
                for c in range(starts.shape[1]):
                    hit |= self.walks(edited[open_], starts[open_, c], steps, bits)[:, -1] == own
                open_ = open_[~hit]

    def trials(self, band: Band, rng: random.Random, span: int):
        """Pieces of a band at its allowed distance among unknown words: kind of edit, the piece, the text, two starts of the run in it (or one twice)."""
        import numpy as np

        kinds, clean, edited, starts = [], [], [], []
        for kind in range(3):
            for _ in range(TRIALS):
                k = rng.choice(band.parts)
                w = self.pieces[k].tolist()
                clean.append(w)
                t = min(self.parts[k].allowed, len(w))
                if kind == 2:  # insertions within the piece; at its ends they are no edits
                    places, w = [], w[:]
                    for _ in range(t if len(w) > 1 else 0):
                        w.insert(rng.randrange(1, len(w)), 0)
                else:
                    places = rng.sample(range(len(w)), t)
                    w = [0 if p in places else x for p, x in enumerate(w) if kind == 1 or p not in places]
                kinds.append(kind)
                edited.append([0, *w])
                starts.append((1, 1 if 0 not in places else 2 * kind))  # a lost first word is as far as a changed one
        width = max(map(len, edited)) + span + 3
        return np.array(kinds), padded(clean, max(map(len, clean)), -1), padded(edited, width, 0), np.array(starts)

    @staticmethod
    def pair_slots(seq):
        """The slot of each word and its next in a table of pairs; unlike pairs may share one."""
        return (seq[:-1].astype("i8") * 2_654_435_761 + seq[1:]) % PAIR_SLOTS

    def walks(self, texts, start, steps, bits):
        """For each row of texts (padded with -1): the keys of the first 1, 2, ... sampled steps of its walk from start."""
        import numpy as np

        rows, at, key, out = np.arange(len(texts)), np.zeros(len(texts), "i8") + start, np.zeros(len(texts), "i8"), []
        for j in range(steps[-1] + 1):
            x = np.where(at < texts.shape[1], texts[rows, np.minimum(at, texts.shape[1] - 1)], -1)
            if j in steps:
                key = key * self.base + (x + 1)
                out.append(key)
            at = at + np.where(x >= 0, bits[j, np.maximum(x, 0)], 1)
        return np.stack(out, axis=1)

    def candidates(self, seq, ends):
        """(window start, piece position) pairs over the word ids of many texts put one after the other; ends: for each word the end of its text."""
        import numpy as np

        n = len(seq)
        unknown = np.concatenate([[0], np.cumsum(seq == 0)])
        known = self.pair_table[self.pair_slots(seq)] & (seq[:-1] > 0) & (seq[1:] > 0)
        pairs = np.concatenate([[0], np.cumsum(known), [0]]).astype("i4")
        pairs[-1] = pairs[-2]
        here = np.arange(n)
        out: set[tuple[int, int]] = set()
        starts_of: dict[int, object] = {}
        for band, steps, bits, firsts, keys, parts in self.runs:
            starts = starts_of.get(id(band))
            if starts is None:
                last = np.minimum(here + band.reach, ends) - 1
                starts = here if band.pairs <= 0 else np.nonzero(pairs[last] - pairs[:n] >= band.pairs)[0]
                last = np.minimum(starts + band.least, ends[starts])
                ok = unknown[last] - unknown[starts] + (starts + band.least - last) <= band.edits
                starts = starts_of[id(band)] = starts[ok]
            at, live, key = starts.copy(), starts, np.zeros(len(starts), "i8")
            for j in range(steps[-1] + 1):
                if not len(live):
                    break
                inside = at < ends[live]
                x = np.where(inside, seq[np.minimum(at, n - 1)], -1)
                if j in steps:
                    key = key * self.base + (x + 1)
                    some = firsts[steps.index(j)]
                    keep = some[np.minimum(np.searchsorted(some, key), len(some) - 1)] == key
                    at, live, key, x, inside = at[keep], live[keep], key[keep], x[keep], inside[keep]
                at = at + np.where(inside, bits[j, np.maximum(x, 0)], 1)
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            for s, lo, hi in zip(live.tolist(), low.tolist(), high.tolist(), strict=True):
                out.update((s, k) for k in parts[lo:hi].tolist())
        return out


def matcher(index: ItemIndex):
    """matches(rows): FOUND rows of (id, text) rows, in passes over about a million characters at a time."""
    import numpy as np

    vocab = index.vocab

    def some(docs_: list[tuple]) -> list[tuple]:
        seqs = [[vocab.get(w, 0) for w in words_of(t)] for _, t in docs_]
        sizes = np.array([len(s) for s in seqs])
        if not sizes.sum() or not index.runs:
            return []
        seq = np.concatenate([np.array(s, "i4") for s in seqs])
        ends = np.repeat(np.cumsum(sizes), sizes)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        near: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (document, item) -> where runs of the item may lie
        by_part: dict[int, list[int]] = {}
        for s, p in index.candidates(seq, ends):
            by_part.setdefault(p, []).append(s)
        for p, at in by_part.items():
            piece, part = index.pieces[p], index.parts[p]
            allowed, size = index.allowed[part.item], len(index.seqs[part.item])
            at = np.array(sorted(at))
            for lo in range(0, len(at), 4096):
                some = at[lo : lo + 4096]
                place = some[:, None] + np.arange(len(piece) + part.allowed)[None, :]
                windows = np.where(place < ends[some][:, None], seq[np.minimum(place, len(seq) - 1)], -1)
                for s in some[edit_rows(piece, windows).min(axis=1) <= part.allowed].tolist():
                    doc = int(np.searchsorted(begin, s, side="right")) - 1
                    first = s - part.offset - allowed
                    near.setdefault((doc, part.item), []).append((max(first, int(begin[doc])), min(first + size + 3 * allowed, int(ends[s]))))
        best: dict[tuple[int, int], tuple] = {}
        for (doc, k), places in near.items():
            merged: list[list[int]] = []
            for a, b in sorted(places):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                d, s, n = best_run(index.seqs[k], seq[a:b])
                if d <= index.allowed[k] and ((doc, k) not in best or d < best[doc, k][0]):
                    best[doc, k] = (d, s + a - int(begin[doc]), n)
        return [(docs_[doc][0], index.ids[k], s, n, d, 1 - d / len(index.seqs[k])) for (doc, k), (d, s, n) in sorted(best.items())]

    def matches(rows: list[tuple]) -> list[tuple]:
        got: list[tuple] = []
        part, size = [], 0
        for r in rows:
            part.append(r)
            size += len(r[1] or "")
            if size > 1_000_000:
                got += some(part)
                part, size = [], 0
        return got + some(part)

    return matches


def find_items(docs: DataFrame, items: list[tuple[int, str | None]], id_col: str = "doc_id", text_col: str = "text", edits: float = EDITS) -> DataFrame:
    """FOUND rows: for each document and item that occurs in it, the best window.

    Occurs: some run of the document's words is within ``edits`` x (words of the item) word edits of it; ties go to the first window.
    Documents without a match have no row; null texts have no words; repeated rows give repeated rows.
    """
    index = ItemIndex(items, edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = matcher(index)
        for b in batches:
            got = matches(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
            cols = list(zip(*got, strict=True)) if got else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "start_word", "n_words", "edits", "similarity"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FOUND)


def item_blocks(benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded size; rows without an id or text hold nothing to look for."""
    part: list = []
    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        part.append((r[0], r[1]))
        if len(part) == per_pass:
            yield part
            part = []
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """find_items() for a whole benchmark table, one pass over the documents for each block of items.

    What the passes before the last one find is written, so that the driver holds the index of one block.
    """
    out, last = None, None
    for block in item_blocks(benchmark, per_pass):
        if last is not None:
            got = materialize(find_items(docs, last), "found")
            out = got if out is None else out.unionByName(got)
        last = block
    if last is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    got = find_items(docs, last)
    return got if out is None else out.unionByName(got)


def op3_decontamination(spark, sf_dir) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The rows of docs in which no item occurs, with the columns of docs: each row by its own text, whatever its id. A null text stays."""
    at = docs.columns.index("text")

    def without(index: ItemIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matches = matcher(index)
            for b in batches:
                bad = {m[0] for m in matches(list(enumerate(b.column(at).to_pylist())))}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        return run

    out, last = docs, None
    for block in item_blocks(benchmark, per_pass):
        if last is not None:  # written, so that the driver holds the index of one block
            out = materialize(out.mapInArrow(without(ItemIndex(last)), docs.schema), "clean")
        last = block
    return out if last is None else out.mapInArrow(without(ItemIndex(last)), docs.schema)
