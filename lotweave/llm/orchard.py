"""Centroid clustering in exact integers, nearest centroids by Orchard's search.

Every centroid keeps the others in order of their distance from it.  A vector starts at some centroid
and goes along that centroid's list; whenever it meets a closer centroid it jumps to the start of that
one's list.  Centroids met once are marked and not compared again.  A list is left where its next
entry is strictly further from its owner than twice the vector's distance: by the triangle inequality
nothing from there on is as close.  All vectors of a batch take their steps together.

Distances, sums and centroids are integers, so results do not hang on the order of additions, on
partitions or on retried tasks.  A round reads the stored vectors once; tasks give a sum per centroid
and component, and the driver sees as many numbers as all centroids have components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import stored
from lotweave.session import literal_rows

CLUSTERS = 16
ROUNDS = 3
SCALE = 64
PARTS = 64  # components of a vector
LARGEST = 1 << 26  # components are smaller than this: squared distances stay exact in 64 bits
BATCH = 8192  # vectors that search together


# -- the search -------------------------------------------------------------------------------------


class Lists:
    """Centroids, the others in order from each, and their squared distances."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        apart = centroids[:, None, :] - centroids[None, :, :]
        far = (apart * apart).sum(axis=2)
        numbers = np.broadcast_to(np.arange(len(centroids)), far.shape)
        self.order = np.lexsort((numbers, far), axis=1)
        self.far = np.take_along_axis(far, self.order, axis=1)
        # vectors start at the centroid whose length is closest to theirs
        size = np.sqrt((centroids * centroids).sum(axis=1).astype(float))
        self.by_size = np.argsort(size, kind="stable")
        size = size[self.by_size]
        self.between = (size[1:] + size[:-1]) / 2

    def start(self, vectors: np.ndarray) -> np.ndarray:
        size = np.sqrt((vectors * vectors).sum(axis=1).astype(float))
        return self.by_size[np.searchsorted(self.between, size)]

    def nearest(self, vectors: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each vector's nearest centroid (ties: the smaller), squared distance, and how many were compared."""
        n, k = len(vectors), len(self.centroids)
        best = (self.start(vectors) if start is None else start).astype(np.int64)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), best] = True
        near = _squared(vectors, self.centroids[best])
        owner, at = best.copy(), np.zeros(n, np.int64)  # whose list a vector is on, and where
        on = np.arange(n)
        while len(on):
            # 4 * near: twice the distance, squared
            on = on[at[on] < k]
            on = on[self.far[owner[on], at[on]] <= 4 * near[on]]
            other = self.order[owner[on], at[on]]
            at[on] += 1
            fresh = ~seen[on, other]
            who, other = on[fresh], other[fresh]
            seen[who, other] = True
            found = _squared(vectors[who], self.centroids[other])
            closer = (found < near[who]) | ((found == near[who]) & (other < best[who]))
            who, other = who[closer], other[closer]
            best[who], near[who] = other, found[closer]
            owner[who], at[who] = other, 0
        return best, near, seen.sum(axis=1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


# -- tables -----------------------------------------------------------------------------------------


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def kept(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows of exactly `parts` components, none null or non-finite, as integers."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") == parts) & finite)
    large = F.exists("v", lambda x: F.abs(scale * x.cast("double")) >= LARGEST)
    checked = F.when(large, F.raise_error(F.lit(f"components of {LARGEST // scale} or more are too large for exact distances"))).otherwise(whole(F.col("v"), scale))
    return rows.select("vec_id", checked.alias("v"))


def seeds(rows: DataFrame, clusters: int, seed: int = 1) -> np.ndarray:
    """The `clusters` vectors with the smallest sha256 of `seed:vec_id`, in that order; null ids are none."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.filter("vec_id is not null").select(mark.alias("mark"), "v").orderBy("mark", "v").limit(clusters).collect()
    return np.array([r["v"] for r in first], np.int64)


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    return b.column(b.schema.get_field_index("v")).flatten().to_numpy().reshape(b.num_rows, -1)


def sums(rows: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(centroid, vectors, their sum) of the centroids that are nearest to any vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        k, width = centroids.shape
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                v = _vectors(b.slice(at, BATCH))
                best, *_ = lists.nearest(v)
                np.add.at(total, best, v)
                count += np.bincount(best, minlength=k)
        some = np.flatnonzero(count)
        each = pa.array(np.tile(np.arange(width, dtype=np.int32), len(some)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, width).astype(np.int32)), each, pa.array(total[some].ravel()), pa.array(np.repeat(count[some], width))],
            ["cluster", "part", "total", "n"],
        )

    found = rows.select("v").mapInArrow(run, "cluster int, part int, total long, n long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")]
    by_cluster: dict[int, tuple[int, list[int]]] = {}
    for r in found.groupBy("cluster", "part").agg(*exact).orderBy("cluster", "part").collect():
        by_cluster.setdefault(r["cluster"], (int(r["n"]), []))[1].append(int(r["total"]))
    return [(c, n, total) for c, (n, total) in sorted(by_cluster.items())]


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floor of the mean of their vectors; those without vectors stay."""
    out = centroids.copy()
    for c, n, total in sums(rows, centroids):
        out[c] = [t // n for t in total]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of every row, and how many centroids it was compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                best, near, compared = lists.nearest(_vectors(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(best.astype(np.int32)), pa.array(near), pa.array(compared.astype(np.int32))],
                    ["vec_id", "cluster", "distance", "compared"],
                )

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long, compared int")


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, compared, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Vectors that are null, of another length, or hold a null or non-finite component take no part.  A
    row with a null id is clustered but is no seed; rows that repeat an id count each; equal vectors go
    to the same cluster.  Fewer vectors than `clusters` give as many centroids.  Without any vector the
    result is empty.  Other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    rows = stored(kept(vectors, parts, scale, id_col, vector_col), "vectors")
    centroids = seeds(rows, clusters)
    if not len(centroids):
        return spark.createDataFrame([], _RESULT)
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = stored(assigned(rows, centroids), "assigned")
    totals = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("total")).collect()
    every = sum(r["total"] for r in totals)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = literal_rows(spark, [(r["cluster"], r["total"], every, digest[r["cluster"]]) for r in totals], "cluster", "total", "every", "digest")
    return found.join(about, "cluster").select(
        "vec_id", "cluster", "distance", F.col("total").cast("long").alias("cluster_inertia"),
        F.col("every").cast("long").alias("inertia"), F.col("digest").alias("centroid_sha256"), "compared",
    )


_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared int"


def _oracle(rounds: int = ROUNDS) -> str:
    """The same result in SQL, every vector against every centroid."""
    apart = "list_sum([(x - c.v[i]) * (x - c.v[i]) for x, i in k.v])"
    steps = [
        f"kept AS (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings "
        f"WHERE len(embedding) = {PARTS} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {CLUSTERS})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS (SELECT vec_id, any_value(k.v) AS v, min({{'d': CAST({apart} AS BIGINT), 'c': c.c}}) AS best FROM kept k CROSS JOIN c{r} c GROUP BY vec_id)"
        )
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT best.c AS c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m "
                f"FROM (SELECT best, unnest(v) AS x, unnest(range({PARTS})) AS i FROM a{r}) GROUP BY best.c, i) GROUP BY c)"
            )
            steps.append(f"c{r + 1} AS (SELECT c{r}.c, coalesce(s{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN s{r} USING (c))")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, "
        "CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON best.c = c{rounds}.c"
    )


ORACLE = _oracle()
