"""Language ID by string kernels: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge.

The kernel of two texts is the mean, over n-gram lengths 1 to 3, of the share of distinct n-grams
that both have (their number over the root of both texts' numbers).  Landmark texts span the Nystroem
map; one ridge regression per language on that map gives one-versus-rest scores.  A batch of texts is
scored by two matrix products: presence rows times landmark rows, times regression weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import LONGEST, arrow_map, held_out, stratified

PER_LANGUAGE = 600  # labelled texts read per language
LANGUAGES = 256  # languages learned: those with most labelled texts
TEXTS = 20_000  # labelled texts read of all languages together
LANDMARKS = 256  # of those texts span the kernel map, as many of each language
GRAMS = 4096  # n-grams told apart: those in most training texts
LENGTHS = (1, 2, 3)
SLOTS = 1 << 18  # hashed n-grams
RIDGE = 1e-3
SLACK = 0.1  # how far below the least share of known n-grams of labelled texts a text may lie
UNKNOWN = "und"


@dataclass(frozen=True)
class KernelModel:
    languages: tuple[str, ...]
    slots: np.ndarray  # feature of each hashed n-gram, GRAMS where it is none
    sizes: tuple[int, ...]  # features of each n-gram length, in order
    landmarks: np.ndarray  # scaled presence rows
    weights: np.ndarray  # landmarks x languages
    sharpness: float


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str) -> list[np.ndarray]:
    """Hashed n-grams of the lower-cased text, one array per length; digits count as one sign."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes >= 48) & (codes <= 57)] = 48
    out, mixed = [], np.zeros(len(codes), np.uint32)
    for n in LENGTHS:
        if len(codes) < n:
            out.append(np.zeros(0, np.int64))
            continue
        mixed = (mixed[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(n)
        out.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - 18))
    return out


def presence(texts: list[str], slots: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """One row per text: its known n-grams, scaled so that products of rows are kernel values."""
    rows = np.zeros((len(texts), len_ := sum(sizes) + 1), np.float32)
    for row, text in zip(rows, texts):
        for found in grams(text):
            row[slots[found]] = 1
    rows = rows[:, : len_ - 1]
    at = 0
    for size in sizes:
        part = rows[:, at : at + size]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1)) * np.float32(np.sqrt(len(sizes)))
        at += size
    return rows


def train(texts: list[str], languages: list[str]) -> KernelModel:
    """Kernel ridge on the Nystroem map of at most LANDMARKS of the given texts."""
    names = tuple(sorted(set(languages)))
    count = [np.zeros(SLOTS, np.int32) for _ in LENGTHS]
    for text in texts:
        for c, found in zip(count, grams(text)):
            c[np.unique(found)] += 1
    # of each length, the n-grams that most texts have; a slot serves the shortest length that wants it
    slots, sizes, taken = np.full(SLOTS, -1, np.int64), [], 0
    for i, c in enumerate(count):
        free = np.flatnonzero((c > 0) & (slots < 0))
        room = (GRAMS - taken) if i == len(count) - 1 else min(len(free), GRAMS // (8 if i == 0 else 3))
        best = free[np.lexsort((free, -c[free]))][:room]
        slots[best] = taken + np.arange(len(best))
        sizes.append(len(best))
        taken += len(best)
    slots[slots < 0] = taken
    y = np.array([names.index(x) for x in languages])
    of_each = max(1, LANDMARKS // len(names))
    chosen = np.concatenate([np.flatnonzero(y == k)[:of_each] for k in range(len(names))])
    landmarks = presence([texts[i] for i in chosen], slots, tuple(sizes))
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    kernel = np.concatenate([presence(texts[i : i + 256], slots, tuple(sizes)) @ landmarks.T for i in range(0, len(texts), 256)])
    z = kernel.astype(np.float64) @ root
    goal = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=len(names))[y]  # languages count alike
    gram = (z * weight[:, None]).T @ z + RIDGE * np.eye(z.shape[1])
    ridge = np.linalg.solve(gram, (z * weight[:, None]).T @ goal)
    weights = (root @ ridge).astype(np.float32)
    return KernelModel(names, slots, tuple(sizes), landmarks, weights, 4.0)


def labelled(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """(text, lang) of about `per_language` texts of each language, held-out documents left out.

    The LANGUAGES values with most texts are learned (ties: the first in the alphabet), from TEXTS texts
    at most, of LONGEST characters at most, so that a column of free text for a language, or very long
    texts, can't bring the table to the driver.
    """
    short = F.length("text") <= LONGEST
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & short).select("doc_id", "text", "lang")
    most = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    each = min(per_language, max(1, TEXTS // max(1, len(most))))
    rows = stratified(known.filter(F.col("lang").isin(most)), "lang", each, "language", "doc_id").collect()
    return sorted({(r["text"], r["lang"]) for r in rows if has_letters(r["text"])}, key=lambda r: hash_of(r[0]))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> KernelModel | None:
    """Learn from about `per_language` texts of each language, held-out documents left out; None without any."""
    rows = labelled(docs, per_language)
    return train([r[0] for r in rows], [r[1] for r in rows]) if rows else None


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode(), 5)


def scores(model: KernelModel, texts: list[str]) -> np.ndarray:
    """Score of each language, 0 to 1, adding up to 1."""
    raw = presence(texts, model.slots, model.sizes) @ model.landmarks.T @ model.weights
    e = np.exp(model.sharpness * (raw - raw.max(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """doc_id, lang_pred and score of every row's whole text.

    Texts that are null or without letters, and all texts where nothing could be learnt, are `und`
    with score 0.  Ties go to the language first in the alphabet.  Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and n-grams of bounded number

    def make():
        m = shared.value

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            names, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
            real = [i for i, t in enumerate(texts) if m is not None and has_letters(t)]
            for at in range(0, len(real), 256):
                part = real[at : at + 256]
                p = scores(m, [texts[i] for i in part])
                best = p.argmax(axis=1)
                for i, k, s in zip(part, best.tolist(), p.max(axis=1).tolist()):
                    names[i], sure[i] = m.languages[k], s
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learnt from the rows that are not held out."""
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_share(model: KernelModel, text: str) -> float:
    """Share of the text's n-grams, repeats counted, that the model's kernel knows."""
    found = np.concatenate(grams(text))
    return float((model.slots[found] < sum(model.sizes)).mean()) if len(found) else 0.0


def least_share(texts: list[str], languages: list[str]) -> float:
    """Share of known n-grams below which a text is in none of the learned languages.

    Each half of the texts is judged by a model of the other half, as new texts are; the limit lies
    SLACK below the least of their shares, so that texts like them stay.
    """
    shares = []
    for k in (0, 1):
        if texts[k::2] and texts[1 - k :: 2]:
            model = train(texts[k::2], languages[k::2])
            shares += [known_share(model, t) for t in texts[1 - k :: 2]]
    return (1 - SLACK) * min(shares, default=0.0)


def with_language(docs: DataFrame, rejected: tuple[str, ...] = (UNKNOWN,)) -> DataFrame:
    """The rows of `docs`, all columns, without those whose predicted language is rejected.

    `lang` becomes the predicted language.  It is `und` for texts without letters, where nothing could
    be learnt, and where fewer of a text's n-grams are known than `least_share` of the rows that are
    not held out.  `und` is rejected by default.  The model sees doc_id, text and lang only.
    """
    rows = labelled(docs)
    model = train([t for t, _ in rows], [x for _, x in rows]) if rows else None
    limit = least_share([t for t, _ in rows], [x for _, x in rows])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def language(texts):
        import pandas as pd

        m = shared.value
        out = [UNKNOWN] * len(texts)
        real = [i for i, t in enumerate(texts) if m is not None and has_letters(t) and known_share(m, t) >= limit]
        for at in range(0, len(real), 256):
            part = real[at : at + 256]
            for i, k in zip(part, scores(m, [texts.iloc[i] for i in part]).argmax(axis=1).tolist()):
                out[i] = m.languages[k]
        return pd.Series(out, dtype=object)

    from pyspark.sql.functions import pandas_udf

    # not deterministic to the planner, so that it is not computed again for the filter
    named = docs.withColumn("lang", pandas_udf(language, "string").asNondeterministic()("text"))
    return named.filter(~F.col("lang").isin(*rejected))
