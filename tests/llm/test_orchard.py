"""Orchard's search and the clustering on it against brute force and SQL."""

import hashlib

import numpy as np
import pytest

from lotweave.llm import orchard, queries
from tests.check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("k", "dim", "spread"), [(16, 64, 30), (16, 2, 4), (40, 3, 9), (5, 3, 2), (1, 4, 5), (12, 1, 3)])
def test_search_finds_the_nearest_and_the_smaller_number(k, dim, spread):
    rng = np.random.default_rng(k)
    centroids, vectors = rng.integers(-spread, spread, (k, dim)), rng.integers(-spread, spread, (2000, dim))
    far = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    lists = orchard.Lists(centroids)
    for start in (None, rng.integers(0, k, 2000)):
        best, near, compared = lists.nearest(vectors, start)
        assert (best == far.argmin(axis=1)).all() and (near == far.min(axis=1)).all()
        assert compared.min() >= 1 and compared.max() <= k
    if dim < 4 and k > 10:
        assert compared.mean() < 0.8 * k  # lists are left early


def plain(rows, clusters, rounds):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, vs in groups.items():
            centroids[k] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted((i is None, i or 0, *nearest(v)[::-1], hashlib.sha256(",".join(map(str, centroids[nearest(v)[1]])).encode()).hexdigest()) for i, v in kept)


def test_clusters_against_plain_loops_with_ties_and_nulls(spark):
    rng = np.random.default_rng(4)
    good = [(i, (rng.integers(-6, 7, 3) / 16).tolist()) for i in range(80)]
    good += [(7, good[7][1]), (None, [0.1, 0.2, 0.3]), (90, [0.0, 0.0, 0.0])]
    bad = [(91, None), (92, [1.0, None, 2.0]), (93, [float("nan"), 0.0, 0.0]), (94, [float("inf"), 0.0, 0.0]), (95, [1.0, 2.0]), (96, [])]
    table = spark.createDataFrame([(*r, 1, "x") for r in good + bad], "vec_id long, embedding array<double>, cluster int, v string")
    for clusters, rounds in ((5, 3), (1, 1), (200, 2)):
        got = orchard.cluster(table, clusters, rounds, parts=3).collect()
        assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], r["centroid_sha256"]) for r in got) == plain(good, clusters, rounds)
        assert {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}
        for r in got:
            assert r["cluster_inertia"] == sum(x["distance"] for x in got if x["cluster"] == r["cluster"])


def test_nothing_to_cluster(spark):
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert orchard.cluster(empty).collect() == []


def test_query_equals_sql(spark):
    assert compare(spark, SF, queries.op11_orchard, orchard.ORACLE) == ""


def test_components_beyond_exact_distances_are_refused(spark):
    table = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        orchard.cluster(table, parts=2).collect()
