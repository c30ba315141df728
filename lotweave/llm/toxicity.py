"""Toxicity by cumulative-link ordinal regression on sparse words.

P(grade <= k) = logistic(threshold_k - weights . words): one weight per word for all grades, with
thresholds in rising order.  The answer is the expected grade.  Features are the presence of words
and of word stems (first 4 to 6 letters of longer words, for languages that inflect) that occur in
enough training texts and tell their grades apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lotweave.llm.common import arrow_map, held_out, labelled_sample

PER_CLASS = 3000  # labelled texts read per class
WORDS = 2000  # words and stems with a weight
STEMS = (4, 5, 6)  # letters of a stem
LEAST = 5  # texts a word or stem must occur in
RIDGE = 0.001
TOXIC = 0.3  # expected severity from which a document counts as toxic
_WORD = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class OrdinalModel:
    words: tuple[str, ...]
    weights: np.ndarray
    thresholds: np.ndarray  # one fewer than grades, rising


def words_of(text: str) -> set[str]:
    """Lower-cased words of a text, and stems of its words, marked by a hyphen."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "-" for n in STEMS for w in words if len(w) > n}


def grade_texts(toxic: list[int], bags: list[set[str]], telling: set[str]) -> np.ndarray:
    """Severity grades from 0/1 labels: 0 clean, 1 toxic, 2 toxic with more telling words than most toxic texts."""
    hits = np.array([len(b & telling) for b in bags])
    y = np.array(toxic)
    bad = hits[y == 1]
    severe = (y == 1) & (hits > (np.median(bad) if len(bad) else 0))
    return y + severe


def select_words(bags: list[set[str]], y: np.ndarray, most: int = WORDS, least: int = LEAST) -> list[tuple[str, float]]:
    """Words in at least `least` texts, by how far their share among toxic texts is from that among clean ones."""
    from collections import Counter

    counts = [Counter(), Counter()]
    for bag, label in zip(bags, y):
        counts[int(label > 0)].update(bag)
    n = [max(1, int((y == 0).sum())), max(1, int((y > 0).sum()))]
    scored = []
    for word in set(counts[0]) | set(counts[1]):
        a, b = counts[0][word], counts[1][word]
        if a + b >= least:
            p, q = (a + 0.5) / (n[0] + 1), (b + 0.5) / (n[1] + 1)
            pooled = (a + b + 1) / (n[0] + n[1] + 2)
            scored.append((word, (q - p) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))))
    return sorted(scored, key=lambda s: (-abs(s[1]), s[0]))[:most]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(bags: list[set[str]], grades: np.ndarray, words: list[str], rounds: int = 400) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam; thresholds are a first one and positive steps."""
    index = {w: i for i, w in enumerate(words)}
    rows = [np.array(sorted(index[w] for w in b if w in index), np.int64) for b in bags]
    flat_ = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    top = int(grades.max()) if len(grades) else 0
    share = np.array([(grades <= k).mean() for k in range(top)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(len(words)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m = v = np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w = theta[: len(words)]
        cut = np.concatenate([theta[len(words) : len(words) + 1], np.exp(theta[len(words) + 1 :])]).cumsum()
        s = np.bincount(owner, w[flat_], minlength=len(rows))
        upper = np.where(grades < top, _sigmoid(cut[np.minimum(grades, top - 1)] - s), 1.0)
        lower = np.where(grades > 0, _sigmoid(cut[np.maximum(grades - 1, 0)] - s), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        ds = (du - dl) / len(rows)  # of the negative log likelihood
        gcut = np.zeros(top)
        np.add.at(gcut, np.minimum(grades, top - 1), np.where(grades < top, -du, 0) / len(rows))
        np.add.at(gcut, np.maximum(grades - 1, 0), np.where(grades > 0, dl, 0) / len(rows))
        tail = gcut[::-1].cumsum()[::-1]
        g = np.concatenate([np.bincount(flat_, ds[owner], minlength=len(words)) + RIDGE * w / 10, tail[:1], tail[1:] * np.exp(theta[len(words) + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    cut = np.concatenate([theta[len(words) : len(words) + 1], np.exp(theta[len(words) + 1 :])]).cumsum()
    return OrdinalModel(tuple(words), theta[: len(words)], cut)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> OrdinalModel | None:
    """Learn from about `per_class` labelled, not held-out texts of each class; None without both classes."""
    rows = labelled_sample(docs, labels, "toxic", per_class, "toxicity")
    toxic = np.array([y for _, _, y in rows])
    if len(set(toxic.tolist())) < 2:
        return None
    one: dict[str, str] = {}  # one string for all texts that hold a word
    bags = [{one.setdefault(w, w) for w in words_of(t)} for _, t, _ in rows]
    chosen = select_words(bags, toxic)
    telling = {w for w, z in chosen if z > 5}
    return train(bags, grade_texts(toxic.tolist(), bags, telling), [w for w, _ in chosen])


def grade_shares(model: OrdinalModel, sums: np.ndarray) -> np.ndarray:
    """Probability of each grade for the given weighted sums."""
    below = _sigmoid(model.thresholds[None, :] - sums[:, None])
    return np.diff(np.concatenate([np.zeros((len(sums), 1)), below, np.ones((len(sums), 1))], axis=1), axis=1)


def severity(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """doc_id, severity (expected grade), grade (most likely one) and toxic (0/1) of every whole text.

    Null and empty texts are texts without words.  Without a model everything is severity 0.  Ties
    between grades go to the lower one; repeated rows each get their answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most WORDS weights

    def make():
        m = shared.value
        weight = dict(zip(m.words, m.weights.tolist())) if m else {}
        known = frozenset(weight)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            if m is None:
                mean, best = np.zeros(len(texts)), np.zeros(len(texts), np.int32)
            else:
                sums = np.array([sum(weight[w] for w in sorted(words_of(t) & known)) if t else 0.0 for t in texts])
                p = grade_shares(m, sums)
                mean, best = p @ np.arange(p.shape[1]), p.argmax(axis=1).astype(np.int32)
            toxic = (mean >= TOXIC).astype(np.int32)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(mean), pa.array(best), pa.array(toxic)], ["doc_id", "severity", "grade", "toxic"])

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, severity double, grade int, toxic int")


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, severity, grade and toxic of every row of `docs`."""
    return severity(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "severity", "grade", "toxic")
