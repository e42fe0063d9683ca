"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on text labelled good and one on text labelled bad. A text is compressed with
each, whole, in blocks so that the dictionary matters throughout; the difference of the two sizes per byte is the only
feature. A logistic curve over it, fitted on other labelled rows, turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, id_text

THRESHOLD = 0.7
#: Bytes that are compressed at a time: where the dictionary is all there is to refer to, it tells most.
BLOCK = 1024


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample, a class: documents for the dictionary and pieces of each (spread evenly over the
    whole text), and documents for the curve, which count whole."""

    dictionary_docs: int = 300
    pieces: int = 8
    piece_chars: int = 1024
    dictionary_bytes: int = 32 << 10
    curve_docs: int = 700
    level: int = 3


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; their beginning as it is where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[:size]


class SizeDifference:
    """(size with the bad dictionary - size with the good one) / bytes, 0 for an empty text. ``dictionaries``: good, bad."""

    def __init__(self, dictionaries: tuple[bytes, bytes], level: int):
        self.good, self.bad = (self._compressor(d, level) for d in dictionaries)

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content or b"\n" * 8)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, text: str) -> float:
        data = text.encode()
        if not data:
            return 0.0
        bad, good = (sum(len(c.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)) for c in (self.bad, self.good))
        return (bad - good) / len(data)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Intercept and slopes of the maximum-likelihood curve with a small ridge, by Newton's method."""
    X = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(X.shape[1])
    ridge = np.diag([1e-6] + [1e-3] * (len(w) - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (p - y) + ridge @ w
        step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + ridge, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[bytes, bytes]
    level: int
    intercept: float
    slope: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + x * self.slope, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, usable: Column, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """``labels``: id and 0/1 label; ``usable`` is a condition on its id. Documents are drawn by a hash of their ids, as
    many of each class as ``s`` says; class sizes are counted over all usable labels and set the prior. Only pieces of
    the dictionaries' documents and a number for each of the curve's reach the driver. Of rows that repeat an id one
    counts. With labels of one class only, or too few, the score is the prior for all texts."""
    rows = labels.filter(usable & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    want = s.dictionary_docs + s.curve_docs
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(10)), 11) / float(1 << 53)
    drawn: dict[int, tuple[int, bool]] = {}  # id -> (label, for a dictionary)
    for y in sorted(counts):
        near = rows.filter((F.col("y") == y) & F.col("doc_id").isNotNull() & (unit < min(1.0, 1.5 * want / counts[y]))).select("doc_id", unit.alias("u")).distinct().collect()
        ids = [r["doc_id"] for r in sorted(near, key=lambda r: (r["u"], r["doc_id"]))][:want]
        head = min(s.dictionary_docs, max(1, len(ids) // 2))
        drawn |= {i: (y, k < head) for k, i in enumerate(ids)}
    chosen = docs.sparkSession.createDataFrame([(i, y, d) for i, (y, d) in drawn.items()], "doc_id long, y int, for_dictionary boolean")
    found = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most two classes of ``want`` ids
    found = found.groupBy("doc_id", "y", "for_dictionary").agg(F.min("text").alias("text"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(s.pieces - 1)), lambda i: F.substring(F.col("text"), (F.floor(i * F.char_length("text") / s.pieces) + 1).cast("int"), F.lit(s.piece_chars)))
    pieces = F.when(F.char_length("text") > s.pieces * s.piece_chars, spread).otherwise(F.array("text"))
    taken = sorted(found.filter("for_dictionary").select("doc_id", "y", pieces.alias("pieces")).collect(), key=lambda r: r["doc_id"])
    blocks = lambda data: [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    made = {y: [b for r in taken if r["y"] == y for p in r["pieces"] for b in blocks(p.encode())] for y in (1, 0)}
    dictionaries = (dictionary(made[1], s.dictionary_bytes), dictionary(made[0], s.dictionary_bytes))
    curve = found.filter("NOT for_dictionary").select("doc_id", "text", "y").mapInArrow(_differences(docs.sparkSession.sparkContext.broadcast((dictionaries, s.level))), "doc_id long, difference double, y int").collect()
    curve.sort(key=lambda r: r["doc_id"])
    x, y = np.array([r["difference"] for r in curve]), np.array([float(r["y"]) for r in curve])
    n = {c: int((y == c).sum()) for c in (0, 1)}
    good = counts.get(1, 0)
    prior = float(np.log((good + 1) / (sum(counts.values()) - good + 1)))
    scale = float(x.std()) if len(x) else 0.0
    if not n[0] or not n[1] or scale == 0.0:
        return Model(dictionaries, s.level, prior, 0.0)
    w = logistic(x[:, None] / scale, y)
    return Model(dictionaries, s.level, float(w[0]) - float(np.log(n[1] / n[0])) + prior, float(w[1]) / scale)


def _sizes(dictionaries: tuple, level: int) -> SizeDifference:
    return held(("quality", hash(dictionaries), level), lambda: SizeDifference(dictionaries, level))


def _differences(sent):
    """Rows (doc_id, text, y) -> (doc_id, difference, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _sizes(*sent.value)
        for b in batches:
            x = pa.array([size(t.as_py()) for t in b.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), x, b.column(2)], ["doc_id", "difference", "y"])

    return run


def _scored(model, rows: int = 2048):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        size = _sizes(m.dictionaries, m.level)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                x = np.array([size(t.as_py()) for t in part.column(1)], np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.probability(x), pa.float64()), pa.array(x, pa.float64())], ["doc_id", "score", "difference"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (probability of label 1), difference.

    Null counts as empty; an empty text has the difference 0 and the curve's value there. Whole texts are compressed.
    Equal texts get equal scores; if either class has no rows the score is the prior for all; other columns are ignored;
    an empty table gives an empty result. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return id_text(docs, id_col, text_col).mapInArrow(_scored(sent), "doc_id long, score double, difference double")
