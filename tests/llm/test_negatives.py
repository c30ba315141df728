"""Hard negatives: intervals hold every product, results equal SQL and plain loops."""

import numpy as np
import pytest

from lotweave.llm import negatives, queries
from tests.check import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("dim", "bits", "planes"), [(64, 512, 6), (64, 128, 2), (3, 64, 1), (70, 64, 4), (1, 512, 8)])
def test_intervals_hold_every_inner_product(dim, bits, planes):
    rng = np.random.default_rng(dim + bits)
    rows = np.concatenate([rng.integers(-300, 300, (400, dim)), np.zeros((2, dim), np.int64), np.full((2, dim), 7), rng.integers(-(2**27), 2**27, (20, dim))])
    asked = np.concatenate([rng.integers(-300, 300, (30, dim)), np.zeros((1, dim), np.int64), np.full((1, dim), -3), rows[:5]])
    basis = negatives.rotation(dim, bits)
    assert np.abs(basis @ basis.T - np.eye(dim)).max() < 1e-12
    low, high = negatives.intervals(negatives.Planes(asked, basis, planes), negatives.Codes(rows, basis), slice(None))
    true = asked @ rows.T
    assert (low <= true).all() and (true <= high).all()


def test_the_filter_leaves_out_most_pairs(spark):
    e = np.array([r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], float)
    whole = np.floor(256 * e).astype(np.int64)
    labels = np.arange(len(whole)) % 2
    part = negatives.Slice(np.arange(len(whole)), labels, whole, negatives.rotation(64))
    best = part.positives(np.arange(50), labels[:50], whole[:50], 5)
    true = (whole[:50] @ whole.T).astype(float)
    true[labels[:50, None] != labels] = -np.inf
    true[np.arange(50), np.arange(50)] = -np.inf
    assert (np.sort(true, axis=1)[:, :-6:-1] == best.score).all()
    assert part.scored < 0.6 * 50 * len(whole) / 2


def test_query_equals_sql(spark):
    assert compare(spark, SF, queries.op13_negatives, negatives.ORACLE) == ""


def plain(rows, anchors, positives, count, low, high):
    rows = sorted({(i, y, tuple(int(np.floor(256 * x)) for x in v)) for i, y, v in rows})
    out = []
    for i, y, v in rows:
        if i not in anchors:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            hard = [x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:count]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("slice_rows", [7, 100_000])
def test_against_plain_loops_with_ties_copies_and_bad_rows(spark, slice_rows):
    rng = np.random.default_rng(9)
    good = [(i, int(rng.integers(0, 3)), (rng.integers(-4, 5, 4) / 64).tolist()) for i in range(60)]
    good += [(i, 1, [0.25, 0.0, 0.0, 0.0]) for i in range(60, 75)] + [(i, 2, [0.21, 0.0, 0.0, 0.0]) for i in range(75, 90)] + [(99, 9, [0.2, 0.1, 0.0, 0.0])]
    bad = [(100, None, [1.0] * 4), (None, 1, [1.0] * 4), (101, 1, None), (102, 1, [1.0, None, 0.0, 0.0]), (103, 1, [float("nan")] * 4), (104, 1, [1.0]), (105, 2, [])]
    table = spark.createDataFrame([(*r, 5, "x") for r in good + good[:3] + bad], "vec_id long, label int, embedding array<double>, score int, slice string")
    some = table.filter("vec_id % 4 = 0 or vec_id = 99")
    got = negatives.mine(table, some, 4, 3, 70, 100, slice_rows=slice_rows)
    want = plain(good, {i for i, *_ in good if i % 4 == 0 or i == 99}, 4, 3, 70, 100)
    assert got.columns == [c.split()[0] for c in negatives._RESULT.split(", ")]
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([(1, 1, None)], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(empty, empty).collect() == []
    lone = spark.createDataFrame([(100, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(lone, lone).collect() == []
