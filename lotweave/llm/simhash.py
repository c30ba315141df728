"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are laid out three times, each time with another third of their bits in front.  Two
fingerprints with at most two differing bits agree on a whole third, so in one layout they share that
third's group.  Inside a task the fingerprints are sorted by Gray rank, which keeps codes with common
leading bits together and neighbours one bit apart.  Runs of eight become nodes, runs of eight nodes
become upper nodes, up to one root; a node holds the bits that all its codes share (a mask and a
pattern).  The index is searched against itself from the root: the differences of two nodes' shared
bits only grow on the way down, and a pair of groups whose differences exceed the limit is pruned
whole.  Each task gives links that span what it found, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.llm.bpe import flat
from lotweave.llm.common import arrow_map, stored
from lotweave.llm.components import components

WORDS = 3  # words of a shingle
DIFFERENT = 2  # bits that linked fingerprints may differ in
FAN = 8  # children of an index node
GROUP = 4096  # fingerprints of a group that one task searches; larger groups are split in blocks
PAIRS = 1 << 20  # node pairs looked at together
_THIRDS = (22, 21, 21)  # bits in front in the three layouts; two differing bits leave one third equal


# -- fingerprints ---------------------------------------------------------------------------------


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `words` words, joined by spaces; of the whole sequence if it is shorter."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(parts) - words + 1].tolist()
    stops = (ends - 1)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def fingerprint_of(text: bytes, words: int = WORDS, seed: int = 42) -> int:
    hashes = shingle_hashes(text, words, seed)
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # a very long text takes no more memory than this
        part = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > len(hashes)) if len(hashes) else np.zeros(8, np.uint8)
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every whole text; null texts are empty."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            raw, limits = flat(b.column(1))
            at = limits.tolist()
            codes = np.array([fingerprint_of(raw[i:j], words) for i, j in zip(at, at[1:])], np.uint64)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.view(np.int64))], ["doc_id", "fp"])

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, fp long")


# -- the index of one task ------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order, in which neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def levels(codes: np.ndarray, fan: int = FAN) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask) of the codes themselves, of runs of `fan` codes, and so on up to one root."""
    every, some = codes, codes
    out = [(codes, np.full(len(codes), np.uint64(2**64 - 1)))]
    while len(every) > 1:
        at = np.arange(0, len(every), fan)
        every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
        out.append((every, ~(every ^ some)))
    return out


def search(codes: np.ndarray, different: int = DIFFERENT, fan: int = FAN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in `codes` (in Gray order) that differ in at most `different` bits, in blocks."""
    tree = levels(codes, fan)
    zero = np.zeros(1, np.int64)
    stack = [(len(tree) - 1, zero, zero)]
    while stack:
        level, left, right = stack.pop()
        if level == 0:
            yield left, right
            continue
        pattern, mask = tree[level - 1]
        for at in range(0, len(left), PAIRS // fan**2):
            a = (left[at : at + PAIRS // fan**2, None, None] * fan + np.arange(fan)[None, :, None]).repeat(fan, 2).ravel()
            b = (right[at : at + PAIRS // fan**2, None, None] * fan + np.arange(fan)[None, None, :]).repeat(fan, 1).ravel()
            keep = (a < len(pattern)) & (b < len(pattern)) & ((a < b) if level == 1 else (a <= b))
            a, b = a[keep], b[keep]
            differ = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b])
            keep = differ <= different
            if keep.any():
                stack.append((level - 1, a[keep], b[keep]))


def spanning(codes: np.ndarray, ids: np.ndarray, different: int = DIFFERENT) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, least id of its component) that connect what the search connects."""
    order = np.argsort(gray_rank(codes), kind="stable")
    codes, ids = codes[order], ids[order]
    parent = np.arange(len(codes))
    for a, b in search(codes, different):
        while len(a):
            a, b = parent[a], parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (up := parent[parent]).tolist() != parent.tolist():
                parent = up
    least = np.full(len(codes), np.iinfo(np.int64).max)
    np.minimum.at(least, parent, ids)
    root = least[parent]
    linked = root != ids
    return ids[linked], root[linked]


def links(classes: DataFrame, different: int = DIFFERENT, group: int = GROUP) -> DataFrame:
    """(a, b): links between classes (rep, fp) whose fingerprints differ in at most `different` bits.

    Fingerprints must be distinct.  A group larger than `group` is cut in blocks by a hash, and every
    two of its blocks meet in one task: no pair is lost, and no task gets more than two blocks.
    """
    if different > 2:
        raise ValueError("the three layouts find pairs of up to two differing bits")
    thirds, at = [], 64
    for i, width in enumerate(_THIRDS):
        at -= width
        front = F.shiftrightunsigned(F.col("fp"), at).bitwiseAND((1 << width) - 1)
        thirds.append(F.struct(F.lit(i).alias("layout"), front.alias("front")))
    laid = classes.select("rep", "fp", F.explode(F.array(*thirds)).alias("key")).select("rep", "fp", "key.*")
    large = stored(laid.groupBy("layout", "front").count().filter(F.col("count") > group), "large-groups")
    blocks = F.ceil(F.col("count") / group).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least(own, other).alias("x"), F.greatest(own, other).alias("y")),
    )
    split = (
        laid.join(large, ["layout", "front"], "left")
        .withColumn("blocks", F.coalesce(blocks, F.lit(1)))
        .select("rep", "fp", "layout", "front", F.explode(meets).alias("meet"))
        .select("rep", "fp", "layout", F.xxhash64("layout", "front", "meet").alias("cell"))
        .repartition("cell")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        rep, code = rows["rep"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        layout, cell = rows["layout"].to_numpy(), rows["cell"].to_numpy()
        del got, rows
        for turn in np.unique(layout).tolist():
            mine = np.flatnonzero(layout == turn)
            mine = mine[np.argsort(cell[mine], kind="stable")]
            first = np.flatnonzero(np.r_[True, cell[mine][1:] != cell[mine][:-1]])
            ends = np.r_[first[1:], len(mine)]
            # small cells share one index, as far as `group` codes go; a code counts once
            start = 0
            while start < len(first):
                stop = max(start + 1, int(np.searchsorted(ends, first[start] + 2 * group, "right")))
                part = mine[first[start] : ends[stop - 1]]
                part = part[np.unique(rep[part], return_index=True)[1]]
                shift = np.uint64((64 - sum(_THIRDS[:turn])) % 64)
                turned = (code[part] << (np.uint64(64) - shift)) | (code[part] >> shift) if turn else code[part]
                a, b = spanning(turned, rep[part], different)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                start = stop

    return split.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, different: int = DIFFERENT, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the least doc_id reachable over fingerprints that differ in at most `different`
    bits.  Texts without words (null, empty, white space) have fingerprint zero, linked like others.
    A row with a null doc_id gets its fingerprint, links nothing, and has a null component_id; rows
    that repeat a doc_id each get theirs, and the fingerprints of one doc_id are linked through it.
    Equal fingerprints are one class before any search, so copies are never paired.
    """
    prints = stored(fingerprints(docs, words), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep is not null"), "classes")
    repeated = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low != high")
    searched = classes.select("rep", "fp")
    if not repeated.isEmpty():
        # one doc_id with several texts: classes may share their least id, so number them by fingerprint
        return _with_repeated_ids(prints, different, group)
    roots = components(links(searched, different, group))
    component = classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return _named(prints, component)


def _with_repeated_ids(prints: DataFrame, different: int, group: int) -> DataFrame:
    """The same with fingerprints as the nodes, linked further by the doc_ids that they share."""
    known = prints.filter("doc_id is not null")
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    least = known.groupBy("doc_id").agg(F.min("fp").alias("b"))
    shared = known.join(least, "doc_id").filter("fp != b").select(F.col("fp").alias("a"), "b")
    roots = components(links(classes.select(F.col("fp").alias("rep"), "fp"), different, group).union(shared))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return _named(prints, rooted.join(ids, "root").select("fp", "component_id"))


def _named(prints: DataFrame, component: DataFrame) -> DataFrame:
    return prints.join(component, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, of one document per component: that of the least doc_id.

    Rows with a null doc_id are kept (nothing says what they repeat); of several rows with the kept
    doc_id all are kept, as they are one document.
    """
    ids = near_duplicates(docs.select("doc_id", "text"))
    gone = stored(ids.filter("doc_id is not null and doc_id != component_id").select("doc_id").distinct(), "repeats")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
