import math

import numpy as np
import pytest

from escalade.llm import whitening as W

SF = "/root/testdata/sf0.001"


def truth(vectors):
    """Fit list, mean, eigenvalues and eigenvectors (falling) by a dense solver."""
    fit = np.array(sorted(set(map(tuple, vectors))), object)
    n, sums = len(fit), fit.sum(0)
    c = np.array([[float(n * v - s) / n for v, s in zip(row, sums)] for row in fit])
    e, q = np.linalg.eigh(c.T @ c / n)
    return n, sums, e[::-1], q[:, ::-1]


def against(out, rows, components=4):
    """Rows of the operator against the dense solver; ``rows``: (vec_id, entries) that remain."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in rows]
    n, sums, e, q = truth(x)
    k = min(components, len(sums))
    got = {}
    for r in out:
        got.setdefault(r.vec_id, []).append(r)
    assert len(out) == k * len(rows)
    sign = {}
    for (vec_id, _), v in zip(rows, x):
        for r in got[vec_id]:
            assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))
            j = r.component - 1
            want = float(np.array([float(n * a - s) / n for a, s in zip(v, sums)]) @ q[:, j]) / math.sqrt(e[j])
            if abs(want) > 1e-3:
                sign.setdefault(j, math.copysign(1, want * r.whitened))
                assert abs(r.whitened * sign[j] - want) < 1e-8 * max(1, abs(want))
            assert abs(r.explained - e[j] / e.sum()) < 1e-10 and r.identity_error <= 1e-9


def test_rank_one_terms_against_a_dense_solver():
    rng = np.random.default_rng(0)
    for d in (1, 2, 5, 24):
        values, vectors, dense = np.zeros(d), np.eye(d), np.zeros((d, d))
        for i in range(60):
            v = rng.normal(size=d) * 10.0 ** rng.integers(-3, 4)
            if i % 5 == 0:
                v[: d // 2] = 0  # untouched directions
            if i % 7 == 0 and i:
                v = vectors[:, rng.integers(d)] * 3.0  # along one eigenvector
            values, vectors = W.rank_one(values, vectors, v)
            dense += np.outer(v, v)
            assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)
            assert np.abs((vectors * values) @ vectors.T - dense).max() < 1e-12 * np.abs(dense).max() * 10
            assert (np.diff(values) >= 0).all()


def test_secular_roots_lie_between_the_poles():
    d, z = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-9, 5.0]), np.array([1.0, 1e-7, 0.5, 1e-6, 2.0])
    found, _ = W.secular(d, z * z)
    want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
    assert np.allclose(found, want, atol=1e-12) and (found >= d).all() and (found[:-1] <= d[1:]).all()


def test_combined_spectra_are_that_of_all():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (90, 6))
    parts = [x[:40], x[40:41], x[41:70], x[70:]]
    import pyarrow as pa
    states = []
    for i, p in enumerate(parts):
        values, vectors, mean = np.zeros(6), np.eye(6), np.zeros(6)
        for n, row in enumerate(p.astype(float)):
            values, vectors = W.rank_one(values, vectors, (row - mean) * np.sqrt(n / (n + 1)))
            mean += (row - mean) / (n + 1)
        states.append(W._state(i, len(p), p.sum(0), W._packed(values, vectors)))
    r = W.combine(pa.Table.from_batches(states)).to_pylist()[0]
    values, vectors = W._unpacked(r["spectrum"], 6)
    c = x - x.mean(0)
    assert r["n"] == 90 and [int(s) for s in r["sums"]] == x.sum(0).tolist()
    assert np.allclose((vectors * values) @ vectors.T, c.T @ c, rtol=1e-11, atol=1e-6)


def test_query_against_a_dense_solver(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    against(W.op11_embedding_whitening(spark, SF).collect(), rows)


def test_edges(table, spark):
    rng = np.random.default_rng(2)
    base = [(i, [float(c) for c in rng.normal(size=6).astype(np.float32)]) for i in range(50)]
    kept = base + [(100, base[0][1]), (101, base[0][1]), (102, [0.0] * 6), (103, [-0.0] * 6), (104, [30.0] * 6)]
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5),
           (204, [float("-inf")] + [0.0] * 5), (205, [])]
    schema = "vec_id long, embedding array<float>, x string, component int"
    frame = table([(*r, "y", 1) for r in kept + bad], schema)
    out = W.whiten(frame, "vec_id", "embedding").collect()
    against(out, kept)
    assert len(W.whiten(table([(*r, "y", 1) for r in kept + [(None, base[1][1])]], schema), "vec_id", "embedding").filter("vec_id is null").collect()) == 4

    few = W.whiten(table([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()
    assert sorted((r.vec_id, r.component, None if r.whitened is None else round(abs(r.whitened), 9), round(r.explained, 9)) for r in few if r.component == 1) \
        == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    assert all(r.whitened is None and r.explained == 0 for r in few if r.component == 2)
    one = W.whiten(table([(1, [1.0, 2.0])], "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()
    assert len(one) == 2 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in one)
    assert W.whiten(table([], "vec_id long, embedding array<float>"), "vec_id", "embedding").count() == 0
    assert W.whiten(table(bad, "vec_id long, embedding array<float>"), "vec_id", "embedding").count() == 0
    with pytest.raises(ValueError, match="entries"):
        W.whiten(table([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    huge = W.whiten(table([(1, [1e30, 2.0]), (2, [-1e30, 2.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert len(huge.collect()) == 6  # deviations beyond 64 bits are null


def test_many_partitions_are_combined_in_rounds(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(400, 5)) * [900, 500, 300, 100, 20]).astype(int)
    W.C.workers(spark)
    frame = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(70)
    r = W._gathered(frame.mapInArrow(W.absorb, W.STATE), 70, W.combine)
    values, vectors = W._unpacked(r["spectrum"], 5)
    c = x - x.mean(0)
    assert r["n"] == 400 and [int(s) for s in r["sums"]] == x.sum(0).tolist()
    assert np.allclose((vectors * values) @ vectors.T, c.T @ c, rtol=1e-11, atol=1e-6 * 900)
