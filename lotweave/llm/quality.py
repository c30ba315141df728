"""Compression classifier: how much better a text packs beside good texts than beside bad ones.

Two zstandard dictionaries are built from labelled texts, one of good and one of bad documents.  A
text is compressed whole with each; the difference of the two sizes over their sum, with the sizes
themselves per byte, goes through a logistic curve fitted on labelled texts that made no dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import arrow_map, held_out, labelled_sample

PER_CLASS = 1200  # labelled documents read per class: half for the dictionaries, half to calibrate
DICTIONARY = 112 << 10  # bytes of a dictionary
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the features, the last a constant
    share: float  # of label 1 among the calibration texts: the answer where nothing could be learnt


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the texts' own ends where there are too few to train one."""
    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY, texts, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(texts)[-DICTIONARY:]


class Sizer:
    def __init__(self, model: CompressionModel) -> None:
        self.packers = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_dict_id=False) if d else
            zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
            for d in (model.good, model.bad)
        ]

    def features(self, text: bytes) -> tuple[float, ...]:
        good, bad = (len(p.compress(text)) for p in self.packers)
        size = len(text) + 16
        return ((bad - good) / (good + bad), good / size, bad / size, (good / size) ** 2, (bad - good) / size, float(np.log(size)), 1.0)


_SCALE = np.array([20.0, 4.0, 4.0, 4.0, 20.0, 0.2, 1.0])  # brings the features to about one


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 60) -> np.ndarray:
    """Newton steps for weighted classes; the ridge leaves the constant out."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.r_[np.ones(x.shape[1] - 1), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + keep * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> CompressionModel:
    """Learn from about `per_class` labelled documents of each class that are not held out.

    Only ids, labels and whole texts are read.  Without a label of each class, every text gets the
    share of label 1 (0.5 without labels).
    """
    rows = labelled_sample(docs, labels, "quality", per_class, "quality")
    ys = {y for _, _, y in rows}
    if len(ys) < 2:
        return CompressionModel(b"", b"", (), float(next(iter(ys), 0.5)))
    texts = {y: sorted({t.encode() for _, t, label in rows if label == y}, key=lambda t: hash_of(t)) for y in (0, 1)}
    halves = {y: (t[: (len(t) + 1) // 2], t[(len(t) + 1) // 2 :] or t) for y, t in texts.items()}
    model = CompressionModel(dictionary(halves[1][0]), dictionary(halves[0][0]), (), 0.5)
    sizer = Sizer(model)
    x = np.array([sizer.features(t) for y in (0, 1) for t in halves[y][1]]) * _SCALE
    y = np.repeat([0.0, 1.0], [len(halves[0][1]), len(halves[1][1])])
    return CompressionModel(model.good, model.bad, tuple(_logistic(x, y).tolist()), float(y.mean()))


def hash_of(text: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text, 10)


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row's whole text; null is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def make():
        m = shared.value
        sizer = Sizer(m) if m.weights else None
        weights = np.array(m.weights)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            if sizer is None:
                scores = np.full(len(texts), m.share)
            else:
                x = np.array([sizer.features(t) for t in texts]) * _SCALE
                scores = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], ["doc_id", "score"])

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where score >= threshold) of every row.

    Rows with a null doc_id are scored and never learnt from; repeated rows each get their score.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
