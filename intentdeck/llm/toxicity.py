"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Two dictionaries of equal size are compared. They share a base, trained by zstandard on ordinary text, so that what is common to all text costs the same under
both, and each goes on with a part trained by zstandard on its own kind: further ordinary text, or the toxic passages. Labels are of documents, so the passages
of toxic documents are found first: the words whose beginnings are over-represented there. A text is cut into windows of whole words, and a window's compressed length under the
ordinary dictionary minus that under the toxic one is how much better toxic text explains it. The lengths from which a window counts, and the weights that turn a
document's windows into a probability, are calibrated on training documents that took no part in the dictionaries that judge them (cross-fitting); the final
dictionaries are trained on all.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentdeck.llm._common import read_table

#: The most labelled documents of each kind that the model is fitted on.
TOXIC_SAMPLE, ORDINARY_SAMPLE = 2000, 4000
#: Bytes of the shared base and of each own part of the dictionaries; the most samples that a part is trained on.
BASE_BYTES, OWN_BYTES, MOST_SAMPLES = 32_768, 4_096, 40_000
#: Bytes of the segments that zstandard's trainer picks, and of the strings whose counts it goes by.
SEGMENT, MATCH = 500, 8
#: Begins both dictionaries and each window: zstandard gives up on inputs of a few bytes, and this adds the same to both lengths.
LEAD = b"0123456789:;<=>?@ABCDEFG"
#: Ends each dictionary and each window: zstandard does not index or search the last bytes of either.
PAD = b"\n" * 16
TAIL = b"~}{#$%&*+,-!"
#: Words in a window.
WINDOW_WORDS = 2
#: Pairs of lengths, in bytes, of which calibration picks one: from the first on a window counts, from the second on once more.
LIMITS = ((1, 3), (2, 4), (3, 5), (4, 6))
FOLDS = 3
THRESHOLD = 0.7
#: Windows whose difference a worker remembers.
CACHE = 150_000
WORD = re.compile(r"\w+")


def windows_of(text: str, n: int = WINDOW_WORDS) -> list[str]:
    """The text's lower-case words, n at a time; the last window may be shorter."""
    words = WORD.findall(text.lower())
    out = list(map(" ".join, zip(*[iter(words)] * n, strict=False)))
    rest = len(words) % n
    return [*out, " ".join(words[-rest:])] if rest else out


def _content(window: str) -> bytes:
    return f" {window} ".encode("utf-8", "replace")


@dataclass(frozen=True)
class ToxicityModel:
    base: bytes
    ordinary: bytes
    toxic: bytes
    limits: tuple[int, int]
    weights: tuple[float, ...]  # of summary()

    def differences(self):
        """differences(text): of each window, the bytes that the toxic dictionary saves over the ordinary one."""
        import zstandard as zs

        par = zs.ZstdCompressionParameters.from_level(13, window_log=17, hash_log=16, chain_log=17, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS)

        def compressor(own: bytes):
            # equal lengths on both sides, so that distances cost the same
            size = max(len(self.ordinary), len(self.toxic))
            d = zs.ZstdCompressionDict(LEAD + self.base + own.rjust(size) + PAD, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=par)
            return zs.ZstdCompressor(dict_data=d, compression_params=par).compress

        ordinary, toxic = compressor(self.ordinary), compressor(self.toxic)
        lead, tail = LEAD.decode(), TAIL.decode()

        class Differences(dict):
            def __missing__(self, window: str) -> int:
                if len(self) >= CACHE:
                    self.clear()
                b = f"{lead} {window} {tail}".encode("utf-8", "replace")
                d = self[window] = len(ordinary(b)) - len(toxic(b))
                return d

        known = Differences()
        return lambda text: list(map(known.__getitem__, windows_of(text)))

    def scorer(self):
        """score(text) in [0, 1]; a null text is the empty one."""
        differences, w, limits = self.differences(), self.weights, self.limits

        def score(text: str | None) -> float:
            z = sum(a * b for a, b in zip(w, summary(differences(text or ""), limits), strict=True))
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return score


def summary(differences: list[int], limits: tuple[int, int]) -> tuple[float, ...]:
    """What is weighed of a document's windows: how many count, also as a share, the largest difference and the bytes saved."""
    out = [1.0]
    saved = [d for d in differences if d > 0]
    for limit in limits:
        n = sum(d >= limit for d in saved)
        out += [math.log1p(n), math.log((n + 0.5) / (len(differences) + 1))]
    return (*out, float(min(12, max(saved, default=0))), math.log1p(sum(saved)))


def _logistic(x, y, rounds: int = 40):
    """Weights of a ridge logistic regression by Newton steps."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


def toxic_passages(toxic: list[str], ordinary: list[str]) -> list[str]:
    """The words of toxic texts with a beginning of 3 to 12 letters that is over-represented there, as often as they occur."""

    def beginnings(text: str) -> set[str]:
        return {w[:n] for w in set(WORD.findall(text.lower())) for n in range(3, min(len(w), 12) + 1)}

    in_t, in_o = Counter(b for t in toxic for b in beginnings(t)), Counter(b for t in ordinary for b in beginnings(t))
    least = max(3, 0.015 * len(toxic))
    over = {b for b, n in in_t.items() if n >= least and n / len(toxic) > 4 * (in_o[b] + 0.5) / len(ordinary)}
    return [w for t in toxic for w in WORD.findall(t.lower()) if any(w[:n] in over for n in range(3, min(len(w), 12) + 1))]


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """zstandard's dictionary of the samples; of too few for its trainer, the samples themselves."""
    import zstandard as zs

    samples = [s for s in samples if s]
    try:
        return zs.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[:size]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, bytes]:
    """(base, ordinary part, toxic part) of the training texts."""
    passages = [_content(w) for w in toxic_passages(toxic, ordinary)]
    lines = [_content(w) for t in ordinary for w in windows_of(t, 8)]
    random.Random(1).shuffle(lines)
    half = len(lines) // 2
    return _dictionary(BASE_BYTES, lines[:half][:MOST_SAMPLES]), _dictionary(OWN_BYTES, lines[half:][:MOST_SAMPLES]), _dictionary(OWN_BYTES, passages[:MOST_SAMPLES])


def train(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Fit on training texts; equal texts count once. Without texts of both kinds every score is about 0."""
    import numpy as np

    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", b"", LIMITS[0], (-60.0,) + (0.0,) * 6)
    found: list[list[int]] = []
    y: list[float] = []
    for k in range(FOLDS):
        rest = [[t for i, t in enumerate(kind) if i % FOLDS != k] or kind for kind in (toxic, ordinary)]
        differences = ToxicityModel(*dictionaries(*rest), LIMITS[0], ()).differences()
        for kind, label in ((toxic, 1.0), (ordinary, 0.0)):
            got = [differences(t) for i, t in enumerate(kind) if i % FOLDS == k]
            found += got
            y += [label] * len(got)
    target, best = np.array(y), None
    for limits in LIMITS:
        x = np.array([summary(f, limits) for f in found])
        w = _logistic(x, target)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        loss = float(-np.mean(target * np.log(p + 1e-12) + (1 - target) * np.log(1 - p + 1e-12)))
        if best is None or loss < best[0]:
            best = (loss, limits, tuple(float(v) for v in w))
    return ToxicityModel(*dictionaries(toxic, ordinary), *best[1:])


def held_out(id_col: str = "doc_id"):
    """The fold whose labels are never learned: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, ordinary_sample: int = ORDINARY_SAMPLE) -> ToxicityModel:
    """Fit on at most toxic_sample and ordinary_sample labelled documents outside the held-out fold, picked by a hash of their id.

    Rows without doc_id or label, and labels without a document, teach nothing.
    """
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).select("doc_id", "toxic")
    pick = lambda y, n: rows.where(F.col("toxic") == y).select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(n)
    # bounded by the two sample sizes
    few = F.broadcast(pick(1, toxic_sample).unionByName(pick(0, ordinary_sample)))
    got = docs.select("doc_id", "text").where("text is not null").join(few, "doc_id").select("toxic", "text", "h")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["h"], r["text"]))
        m = train([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0])
        yield pa.RecordBatch.from_pylist([{"base": m.base, "ordinary": m.ordinary, "toxic": m.toxic, "limits": list(m.limits), "weights": list(m.weights)}])

    # one task fits on the bounded sample, so that the driver holds the model only
    r = got.repartition(1).mapInArrow(fit, "base binary, ordinary binary, toxic binary, limits array<long>, weights array<double>").first()
    return ToxicityModel(bytes(r.base), bytes(r.ordinary), bytes(r.toxic), tuple(r.limits), tuple(r.weights))


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row, over its whole text; null and empty texts score as text without toxic windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train_on(docs, read_table(spark, sf_dir, "labels"))
    out = score_documents(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs that are not predicted toxic, with the columns of docs."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield b.filter(pa.array([score(t) < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
