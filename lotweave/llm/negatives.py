"""Hard negatives by rotated one-bit codes with a guaranteed interval.

A vector is laid into BITS dimensions by a fixed random rotation and keeps the signs of the result: its
code.  Seen back in the vector's own space the code is a direction c, and the stored alignment is the
cosine between the vector x and c.  With x = s c + r, r at a right angle to c, an inner product is

    <q, x> = s <q, c> + <q, r>,   |<q, r>| <= |q - its part along c| * |r|      (Cauchy-Schwarz)

so code, alignment and length give an interval that holds the inner product for certain.  <q, c> is
counted: an anchor's rotated components are cut to PLANES-bit integers, and each plane meets the codes
by AND and popcount; the rounding of the cut widens the interval by its own bound.  Only pairs whose
interval reaches what the anchor still looks for are scored, in integers.

Rows are dealt to slices of bounded size.  A task holds a slice's codes and lets the anchors of the
whole table pass by in batches; an anchor leaves a slice with no more rows than a result can need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotweave.llm.common import stored

BITS = 512  # of a code
PLANES = 6  # bits that an anchor's rotated components are cut to
SEED = 13
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # a negative's score is between LOW and HIGH per cent of the positive's
SLICE = 32768  # rows of a slice, about
ANCHORS = 256  # anchors that meet a slice together
TILE = 4096  # rows of a slice that meet them at once
FIRST = 4  # times as many pairs as an anchor keeps are scored before the interval decides
SURVIVORS = 1 << 15  # pairs scored together
LARGEST = 1 << 28  # components are smaller than this, so that scores stay exact in 64 bits
SLACK = 1e-9  # of the lengths' product: more than double precision can be off by

# -- codes ------------------------------------------------------------------------------------------


def rotation(dim: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """`dim` orthonormal rows of `bits` components: the same for the same arguments."""
    bits = max(bits, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T


class Codes:
    """Codes of integer vectors with what the interval needs: length, scale on the code and rest."""

    def __init__(self, vectors: np.ndarray, basis: np.ndarray) -> None:
        turned = vectors @ basis
        signs = turned >= 0
        self.words = np.packbits(signs, axis=1).view(np.uint64)
        seen = (2.0 * signs - 1) @ basis.T  # the code in the vectors' own space
        self.size = np.linalg.norm(vectors, axis=1)
        self.reach = np.linalg.norm(seen, axis=1)
        along = (vectors * seen).sum(axis=1)
        #: cosine between vector and code; a zero vector has none and needs none
        self.alignment = np.divide(along, self.size * self.reach, out=np.zeros(len(vectors)), where=(self.size > 0) & (self.reach > 0))


class Planes:
    """Rotated anchors as bit planes: component = low + step * integer, off by no more than half a step."""

    def __init__(self, vectors: np.ndarray, basis: np.ndarray, planes: int = PLANES) -> None:
        turned = vectors @ basis
        self.size = np.linalg.norm(vectors, axis=1)
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**planes - 1), 1e-300)
        cut = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.cut_sum = cut.sum(axis=1)
        self.bits = turned.shape[1]
        self.planes = [np.packbits((cut >> p) & 1 == 1, axis=1).view(np.uint64) for p in range(planes)]
        #: what the cut leaves out: |<left out, signs>| <= |left out| * |signs|
        rest = turned - (self.low[:, None] + self.step[:, None] * cut)
        self.off = np.linalg.norm(rest, axis=1) * np.sqrt(self.bits)

    def of(self, rows: np.ndarray) -> Planes:
        part = object.__new__(Planes)
        part.size, part.low, part.step, part.cut_sum, part.off = (x[rows] for x in (self.size, self.low, self.step, self.cut_sum, self.off))
        part.planes, part.bits = [p[rows] for p in self.planes], self.bits
        return part


def intervals(anchors: Planes, codes: Codes, rows: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (anchors x rows) that hold every inner product."""
    words = codes.words[rows]
    counted = np.zeros((len(anchors.size), len(words)), np.int32)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int32)
    for p, plane in enumerate(anchors.planes):
        both = np.zeros(counted.shape, np.uint16)
        for w in range(words.shape[1]):
            both += np.bitwise_count(plane[:, w, None] & words[None, :, w])
        counted += both.astype(np.int32) << p
    # sum of sign * component = 2 * (sum over set bits) - (sum over all)
    set_sum = anchors.low[:, None] * ones + anchors.step[:, None] * counted
    product = 2 * set_sum - (anchors.low * anchors.bits + anchors.step * anchors.cut_sum)[:, None]
    reach, size, alignment = codes.reach[rows], codes.size[rows], codes.alignment[rows]
    unit = np.divide(1.0, reach, out=np.zeros_like(reach), where=reach > 0)
    on = product * unit  # the anchor's part along the code's direction, but for `off`
    off = anchors.off[:, None] * unit
    middle = on * (size * alignment)
    least = np.maximum(np.abs(on) - off, 0.0)
    rest = np.sqrt(np.maximum(anchors.size[:, None] ** 2 - least * least, 0.0))
    wide = rest * (size * np.sqrt(np.maximum(0.0, 1 - alignment * alignment))) + off * (size * np.abs(alignment)) + SLACK * (1 + anchors.size[:, None] * size)
    return middle - wide, middle + wide


# -- the best of a slice ------------------------------------------------------------------------------


class Best:
    """The first `keep` rows per place (score falling, then id), fed with batches of scored pairs."""

    def __init__(self, places: int, keep: int) -> None:
        self.score = np.full((places, keep), np.iinfo(np.int64).min)
        self.id = np.full((places, keep), np.iinfo(np.int64).max)
        self.held = np.zeros(places, np.int64)

    def bar(self) -> np.ndarray:
        """The least score that still matters at each place."""
        return self.score[:, -1]

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some = score >= self.score[place, -1]
        place, score, ids = place[some], score[some], ids[some]
        if not len(place):
            return
        keep = self.score.shape[1]
        mine = np.unique(place)
        real = np.arange(keep) < self.held[mine][:, None]
        old = np.nonzero(real)
        place = np.concatenate([mine[old[0]], place])
        score = np.concatenate([self.score[mine][real], score])
        ids = np.concatenate([self.id[mine][real], ids])
        order = np.lexsort((ids, -score, place))
        place, score, ids = place[order], score[order], ids[order]
        first = np.searchsorted(place, mine)
        rank = np.arange(len(place)) - first[np.searchsorted(mine, place)]
        top = rank < keep
        self.score[place[top], rank[top]], self.id[place[top], rank[top]] = score[top], ids[top]
        self.held[mine] = np.minimum(keep, np.bincount(np.searchsorted(mine, place), minlength=len(mine)))


class Slice:
    """Rows of one slice, by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, basis: np.ndarray) -> None:
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.basis, self.codes = basis, Codes(self.vectors, basis)
        self.scored = 0

    def _score(self, who: np.ndarray, anchors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(who), SURVIVORS):
            a, r = who[at : at + SURVIVORS], rows[at : at + SURVIVORS]
            self.scored += len(a)
            yield a, r, np.einsum("ij,ij->i", anchors[a], self.vectors[r])

    def positives(self, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, keep: int) -> Best:
        """The first rows of each anchor's own label, itself left out."""
        best, planes = Best(len(ids), keep), Planes(anchors, self.basis)
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            start, stop = np.searchsorted(self.labels, [label, label + 1])
            asked = planes.of(mine)
            for at in range(start, stop, TILE):
                rows = slice(at, min(stop, at + TILE))
                low, high = intervals(asked, self.codes, rows)
                open_ = ids[mine][:, None] != self.ids[rows]
                for turn in (_likely(low + high, open_, FIRST * keep), open_):
                    who, row = np.nonzero(turn & (high >= best.bar()[mine][:, None]))
                    open_[who, row] = False
                    for a, r, score in self._score(mine[who], anchors, row + at):
                        best.add(a, score, self.ids[r])
        return best

    def negatives(self, labels: np.ndarray, anchors: np.ndarray, scores: np.ndarray, keep: int, low_pct: int, high_pct: int) -> Best:
        """The first rows of other labels between the bounds of each (anchor, positive); scores: positives' or least."""
        n, per = scores.shape
        best, planes = Best(n * per, keep), Planes(anchors, self.basis)
        there = scores > np.iinfo(np.int64).min
        whole = np.where(there, scores, 0)
        least, most = -(-low_pct * whole // 100), high_pct * whole // 100  # a whole score is in range if between these
        least = np.where(there, least, np.iinfo(np.int64).max)
        for at in range(0, len(self.ids), TILE):
            rows = slice(at, at + TILE)
            low, high = intervals(planes, self.codes, rows)
            open_ = (labels[:, None] != self.labels[rows]) & there.any(axis=1)[:, None]
            for turn in (_likely(low + high, open_ & (low <= most.max(axis=1, keepdims=True)), FIRST * keep), open_):
                reach = np.zeros(low.shape, bool)
                need = np.maximum(least, best.bar().reshape(n, per))
                for p in range(per):
                    reach |= (high >= need[:, p, None]) & (low <= most[:, p, None])
                who, row = np.nonzero(turn & reach)
                open_[who, row] = False
                for a, r, score in self._score(who, anchors, row + at):
                    for p in range(per):
                        fits = (least[a, p] <= score) & (score <= most[a, p])
                        best.add(a[fits] * per + p, score[fits], self.ids[r[fits]])
        return best


def _likely(middle: np.ndarray, among: np.ndarray, count: int) -> np.ndarray:
    """The `count` pairs of each anchor whose intervals lie highest: scored first, they raise the bar for the rest."""
    guess = np.where(among, middle, -np.inf)
    bar = np.partition(guess, -count, axis=1)[:, [-count]] if guess.shape[1] > count else -np.inf
    return among & (guess >= bar)


# -- tables -----------------------------------------------------------------------------------------


def kept(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): rows with a label and a vector without null or non-finite components, as integers."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    large = F.exists("v", lambda x: F.abs(scale * x.cast("double")) >= LARGEST)
    checked = F.when(large, F.raise_error(F.lit("components are too large for exact scores"))).otherwise(
        F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    )
    return rows.select("vec_id", "label", checked.alias("v"))


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """Labels of rows whose id is divisible by `every` moved on by one: known mistakes to mine against."""
    moved = F.when(F.col(id_col) % every == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col))
    return vectors.withColumn(label_col, moved)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dim)


def _met(rows: DataFrame, asked: DataFrame, dim: int, slices: int, bits: int, work, schema: str) -> DataFrame:
    """work(slice, ids, labels, vectors, scores) of every slice and batch of anchors.

    Anchors go to every slice, rows to one; a task sees a slice's rows first, then its anchors.
    """
    own = F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")
    none = F.lit(None).cast("array<long>")
    held = rows.select(own.alias("slice"), F.lit(0).alias("kind"), "vec_id", "label", "v", none.alias("scores"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    passing = asked.select(every, F.lit(1).alias("kind"), "vec_id", "label", "v", "scores")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = rotation(dim, bits)
        now, state, mine = None, None, []
        for b in batches:
            places, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            turns = np.flatnonzero((np.diff(places) != 0) | (np.diff(kinds) != 0)) + 1
            for i, j in zip([0, *turns.tolist()], [*turns.tolist(), b.num_rows]):
                if i == j:
                    continue
                if places[i] != now:
                    now, state, mine = places[i], None, []
                part = b.slice(i, j - i)
                if kinds[i] == 0:
                    mine.append((part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4), dim)))
                elif mine or state is not None:
                    if state is None:
                        state, mine = Slice(*(np.concatenate(x) for x in zip(*mine)), basis), []
                    for at in range(0, len(part), ANCHORS):
                        few = part.slice(at, ANCHORS)
                        scores = few.column(5)
                        yield work(state, few.column(2).to_numpy(), few.column(3).to_numpy(), _matrix(few.column(4), dim), scores)

    dealt = held.union(passing).repartitionById(slices, F.col("slice")).sortWithinPartitions("slice", "kind")
    return dealt.mapInArrow(run, schema)


def _first(found: DataFrame, keep: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE, bits: int = BITS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    slice_rows: int = SLICE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every anchor and positive.

    `anchors` has the columns of `vectors`.  An anchor's positives are its first rows of its own label,
    another id than its own; scores are inner products of floor(scale * x), higher first, ties to the
    smaller id.  Negatives are the first rows of other labels that score between `low` and `high` per
    cent of the positive's score; a positive without any gives no row.  Rows with a null id, label or
    vector, a null or non-finite component, or another length than the most usual one take no part.
    Rows that repeat id, label and vector count once.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, scale, id_col, vector_col, label_col)
    usual = rows.filter(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return spark.createDataFrame([], _RESULT)
    dim = usual["n"]
    rows = stored(rows.filter(F.size("v") == dim).distinct(), "rows")
    asked = kept(anchors, scale, id_col, vector_col, label_col).filter(F.size("v") == dim).distinct()
    asked = stored(asked.withColumn("scores", F.lit(None).cast("array<long>")), "anchors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(parts, -(-rows.count() // slice_rows))

    def own(state: Slice, ids, labels, vs, _) -> pa.RecordBatch:
        best = state.positives(ids, labels, vs, positives)
        real = np.arange(positives) < best.held[:, None]
        who = np.nonzero(real)[0]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[who]), pa.array(labels[who]), pa.array(best.id[real]), pa.array(best.score[real])],
            ["anchor_id", "anchor_label", "vec_id", "score"],
        )

    found = _met(rows, asked, dim, slices, bits, own, "anchor_id long, anchor_label long, vec_id long, score long")
    chosen = stored(_first(found, positives, "anchor_id", "anchor_label"), "positives")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
    by_anchor = chosen.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_label").alias("label")).agg(scores.alias("scores"))
    ready = asked.drop("scores").join(by_anchor, ["vec_id", "label"])

    def others(state: Slice, ids, labels, vs, lists) -> pa.RecordBatch:
        size = np.diff(lists.offsets.to_numpy())
        wide = np.full((len(ids), positives), np.iinfo(np.int64).min)
        wide[np.arange(positives) < size[:, None]] = lists.flatten().to_numpy()
        best = state.negatives(labels, vs, wide, negatives, low, high)
        real = np.arange(negatives) < best.held[:, None]
        place = np.nonzero(real)[0]
        who, which = place // positives, place % positives
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[who]), pa.array(labels[who]), pa.array((which + 1).astype(np.int32)), pa.array(best.id[real]), pa.array(best.score[real])],
            ["anchor_id", "anchor_label", "which", "vec_id", "score"],
        )

    hard = _met(rows, ready, dim, slices, bits, others, "anchor_id long, anchor_label long, which int, vec_id long, score long")
    hard = _first(hard, negatives, "anchor_id", "anchor_label", "which")
    about = chosen.select("anchor_id", "anchor_label", F.col("rank").alias("which"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(about, ["anchor_id", "anchor_label", "which"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

#: The registered query in SQL: every anchor against every row.
ORACLE = f"""
WITH kept AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_sum([x * r.v[i] for x, i in a.v]) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""
