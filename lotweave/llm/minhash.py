"""One-permutation MinHash fingerprints: one hash per shingle, optimal densification, packed low bits.

Every shingle is hashed once; the top bits of the hash choose a bin and each bin keeps its least
hash.  An empty bin copies a bin that a universal hash of (bin, attempt) names, trying attempts until
it meets a full one (optimal densification), so that equal sets stay equal and bins stay independent.
The low `BITS` bits of each bin are kept, packed.  Two fingerprints agree in a bin by chance with
probability 2**-BITS, which the likeness takes out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import arrow_map

WORDS = 5  # words of a shingle
BINS = 512
BITS = 4
SEED = 42


def shingles(text: str) -> np.ndarray:
    """A 64-bit hash of each run of five words (A-Z lower-cased, ASCII white space between words).

    Words are hashed once and mixed by place, so a shingle costs five multiplications.  Fewer than
    five words are one shingle; no words, none.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    words = np.fromiter([digest(w, SEED) for w in parts], np.uint64, len(parts))
    n = max(1, len(words) - WORDS + 1)
    mixed = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(words))):
        mixed = (mixed ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _fill_order(bins: int) -> np.ndarray:
    """For each attempt, the bin that each bin asks: a fixed universal hash."""
    i = np.arange(bins, dtype=np.uint64)
    rows = []
    for attempt in range(1, 257):
        x = (i + np.uint64(bins * attempt)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        rows.append(((x >> np.uint64(33)) % np.uint64(bins)).astype(np.int64))
    return np.array(rows)


_ORDER: dict[int, np.ndarray] = {}


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """Least hash per bin, densified; None for no shingles."""
    if not len(hashes):
        return None
    if bins not in _ORDER:
        _ORDER[bins] = _fill_order(bins)
    width = np.uint64(64 - (bins - 1).bit_length())
    hashes = np.sort(hashes)
    edges = np.searchsorted(hashes, np.arange(bins, dtype=np.uint64) << width)
    full = np.r_[edges[1:], len(hashes)] > edges
    least = hashes[np.minimum(edges, len(hashes) - 1)]
    empty = np.flatnonzero(~full)
    for asked in _ORDER[bins]:
        if not len(empty):
            break
        source = asked[empty]
        hit = full[source]
        least[empty[hit]] = least[source[hit]]
        empty = empty[~hit]
    if len(empty):  # all attempts met empty bins: the next full bin of the ring
        places = np.flatnonzero(full)
        least[empty] = least[places[np.searchsorted(places, empty) % len(places)]]
    return least


def packed(least: np.ndarray | None, bins: int = BINS, bits: int = BITS) -> bytes:
    """The low bits of every bin; nothing for a text without words."""
    if least is None:
        return b""
    low = ((least[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(low.ravel()).tobytes()


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated share of common shingles from packed fingerprints, chance agreement taken out.

    Two texts without words are alike (1); a text with and one without are not (0).
    """
    if not a or not b:
        return float(a == b)
    left = np.unpackbits(np.frombuffer(a, np.uint8))[: bins * bits].reshape(bins, bits)
    right = np.unpackbits(np.frombuffer(b, np.uint8))[: bins * bits].reshape(bins, bits)
    agree = float((left == right).all(axis=1).mean())
    chance = 2.0**-bits
    return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


def fingerprint_of(text: str) -> bytes:
    return packed(signature(shingles(text)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex; empty for texts without words) of every whole text; null is empty."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            marks = [fingerprint_of(t or "").hex() for t in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.string())], ["doc_id", "fingerprint"])

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, fingerprint string")


# -- documents beside their successors --------------------------------------------------------------


@dataclass(frozen=True)
class Ring:
    """How rows are dealt: limits of the parts, and the head of each part with the part that looks at it.

    Rows are placed by ~doc_id, which rises as ids fall; null ids follow, by a hash of their text.
    """

    known: np.ndarray  # limits between the parts of known ids
    unknown: np.ndarray  # limits between the parts of null ids
    heads: np.ndarray  # place of each part's first row
    there: np.ndarray  # parts that have rows
    before: np.ndarray  # the part whose last row each part's first row follows

    def part(self, ids: pa.Array, hashes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Part and place of every row."""
        null = ids.is_null().to_numpy(zero_copy_only=False)
        place = np.where(null, hashes.to_numpy(), ~ids.fill_null(0).to_numpy())
        known = np.searchsorted(self.known, place, "right")
        return np.where(null, len(self.known) + 1 + np.searchsorted(self.unknown, place, "right"), known), place


def _limits(places: DataFrame, parts: int) -> np.ndarray:
    """Limits that deal places in about as many even ranges."""
    wanted = [i / parts for i in range(1, parts)]
    found = places.approxQuantile("place", wanted, 0.2 / parts) if wanted else []
    return np.array(sorted({int(x) for x in found}), np.int64)


def _ring(docs: DataFrame) -> tuple[Ring, Column]:
    """The ring of a table and the hash column that its null ids are placed by.  The driver sees one place per part."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, n_null = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    hashes = F.xxhash64("text") if n_null else F.lit(0).cast("long")
    share = min(parts, -(-parts * n_null // n)) if n else 0
    known = _limits(docs.filter("doc_id is not null").select(F.bitwise_not("doc_id").alias("place")), max(1, parts - share))
    unknown = _limits(docs.filter("doc_id is null").select(hashes.alias("place")), max(1, share)) if n_null else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64)
    ring = Ring(known, unknown, none, none.astype(bool), none)
    size = len(known) + len(unknown) + 2

    def first(ids: pa.Array, hashes_: pa.Array) -> pa.Array:
        part, place = ring.part(ids, hashes_)
        return pa.StructArray.from_arrays([pa.array(part.astype(np.int32)), pa.array(place)], ["part", "place"])

    placed = docs.select(F.arrow_udf(first, "struct<part:int,place:long>")("doc_id", hashes).alias("p")).select("p.*")
    heads, there = np.zeros(size, np.int64), np.zeros(size, bool)
    for r in placed.groupBy("part").agg(F.min("place").alias("place")).collect():
        heads[r["part"]], there[r["part"]] = r["place"], True
    order = np.flatnonzero(there)
    before = np.zeros(size, np.int64)
    before[order] = np.roll(order, 1)  # the first part's head ends the ring
    return Ring(known, unknown, heads, there, before), hashes


def beside_next(docs: DataFrame) -> DataFrame:
    """Deal rows by range of doc_id, each range also getting the first document of the range after it.

    Columns doc_id, text, part and extra (1: a row of the range after, there only to be looked at).
    Rows of one part stand together, in descending doc_id, nulls last, ties by a hash of the text.
    The order is a ring: after its last row comes its first.  Texts move once.
    """
    ring, hashes = _ring(docs.select("doc_id", "text"))

    def deal(ids: pa.Array, hashes_: pa.Array) -> pa.Array:
        part, place = ring.part(ids, hashes_)
        head = ring.there[part] & (ring.heads[part] == place)
        rows = np.arange(len(part)).repeat(1 + head)
        extra = np.r_[False, rows[1:] == rows[:-1]]
        to = np.where(extra, ring.before[part[rows]], part[rows]).astype(np.int32)
        limits = np.concatenate([[0], np.cumsum(1 + head)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(limits), pa.StructArray.from_arrays([pa.array(to), pa.array(extra.astype(np.int32))], ["part", "extra"]))

    dealt = docs.select("doc_id", "text", F.explode(F.arrow_udf(deal, "array<struct<part:int,extra:int>>")("doc_id", hashes)).alias("deal"))
    rows = dealt.select("doc_id", "text", "deal.part", "deal.extra")
    return rows.repartitionById(len(ring.heads), F.col("part")).sortWithinPartitions(
        "part", "extra", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text"
    )


def edited(text: str, following: str) -> str:
    """`text` with its last third of code points replaced by as many of the following text's first."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_PAIRED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def near_edits(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint against those of its edited text and of the next document.

    The next document is the one of the next smaller doc_id, after the last the first; a lone
    document follows itself.  Null texts are empty.  Null ids come last in the order, and rows that
    share an id follow each other, both by a hash of their texts.  Columns that are not doc_id or
    text are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PAIRED.split(", ")]
        last = None  # (id, text, fingerprint, part), waiting for its successor
        done = False  # the part's successor from the next range was met
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, part, extra in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = text or ""
                if last is not None and last[3] != part:
                    last, done = None, False
                if done:
                    continue
                mark = fingerprint_of(text)
                if last is not None:
                    changed = edited(last[1], text)
                    mark2 = fingerprint_of(changed)
                    digest = hashlib.sha256(changed.encode()).hexdigest()
                    out.append((last[0], len(last[1]), digest, last[2].hex(), mark2.hex(), likeness(last[2], mark2), likeness(last[2], mark)))
                last, done = (doc_id, text, mark, part), bool(extra)
            if out:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return beside_next(docs.select("doc_id", "text")).mapInArrow(run, _PAIRED)


def like(a: Column, b: Column) -> Column:
    """likeness() of two hex fingerprint columns."""
    import pandas as pd

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if i is None or j is None else likeness(bytes.fromhex(i), bytes.fromhex(j)) for i, j in zip(x, y)], dtype=float)

    return of(a, b)
