import math

import numpy as np
import pytest

from trackgraph.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def table(spark, rows, parts=5):
    return spark.createDataFrame([(k, v, 9, "clash") for k, v in rows], SCHEMA).repartition(parts)


def brute(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    y = x * n - s
    dev = (y * y).sum(axis=1)
    cov = (y.T @ y).astype(float) / float(n) ** 3
    e, v = np.linalg.eigh(cov)
    return n, dev, (y / n).astype(float), e[::-1], v[:, ::-1]


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(4)
    mixed = rnd.normal(size=(70, 70)) * np.linspace(0.02, 0.9, 70)
    return [(k, v.tolist()) for k, v in enumerate(rnd.normal(size=(5000, 70)) @ mixed / 8 + rnd.normal(size=70))]


def test_against_exact_sums(spark, vectors):
    odd = [(10_000, None), (10_001, []), (10_002, [None] * 70), (10_003, [float("nan")] * 70), (10_004, [float("inf")] + [0.0] * 69), (10_005, [1.0] * 3), (10_006, [1e30] * 70)]
    again = [vectors[3], (None, vectors[4][1])]
    good = vectors + again
    got = whitening.whitened(table(spark, good + odd)).collect()
    n, dev, y, e, v = brute([x for _, x in good])
    assert len(got) == 8 * len(good) and {r.n for r in got} == {n}
    assert 0 <= got[0].identity_error < 1e-9
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 * r.explained
    sign = None
    for (i, _), d, row in zip(good, dev, y):
        w = np.array([rows[(i, d)][c][0] for c in range(1, 9)])
        want = row @ v[:, :8] / np.sqrt(e[:8])
        sign = np.sign(w * want) if sign is None else sign
        assert np.allclose(w, want * sign, atol=1e-7)


def test_partitions_do_not_matter(spark, vectors):
    one, two = (whitening.fit(whitening.usable(table(spark, vectors, k), "vec_id", "embedding")) for k in (1, 7))
    assert one.sums == two.sums and (one.values == two.values).all()


def test_without_variance(spark):
    got = whitening.whitened(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in got) == [(i, c, 2, 0, None, None) for i in (1, 2) for c in (1, 2)]
    got = whitening.whitened(table(spark, [(1, [0.5, 0.25]), (2, [0.75, 0.25])])).orderBy("vec_id", "component").collect()
    assert [abs(r.whitened) if r.whitened is not None else None for r in got] == [1.0, None, 1.0, None] and got[0].explained == 1.0


def test_large_entries_stay_exact(spark):
    rows = [(k, [9e8 * (k % 2), float(k)]) for k in range(40)]
    n, dev, *_ = brute([v for _, v in rows])
    got = {r.vec_id: r.deviation for r in whitening.whitened(table(spark, rows)).collect()}
    assert got == {k: int(d) if d < 2**63 else None for (k, _), d in zip(rows, dev)}
    a = np.array([[2**40, -3], [2**40 - 1, 5]])
    assert (whitening.products(a, a) == a.astype(object).T @ a.astype(object)).all()


def test_no_vectors(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None)])).count() == 0
