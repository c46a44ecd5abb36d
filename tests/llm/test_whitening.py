import math

import numpy as np
import pytest

from ticketveil.llm.whitening import Spectrum, fit, secular_roots, whiten

from .helpers import EXTRA


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, *["x"] * len(EXTRA)) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, " + ", ".join(f"{c} string" for c in EXTRA))


def brute(vectors, k=16):
    """Exact sums in whole numbers, then one eigendecomposition."""
    whole = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    distinct = sorted(set(map(tuple, whole)))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[n * a - s for a, s in zip(x, sums)] for x in distinct], float) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in whole]
    own = np.array([[n * a - s for a, s in zip(x, sums)] for x in whole], float) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        return n, deviations, values, (own @ turn / np.sqrt(np.maximum(values, 0)))[:, :k]


def check(df, vectors, tolerance=1e-7):
    got = {}
    for r in whiten(df).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    n, deviations, values, whitened = brute(vectors)
    assert len(got) == len(vectors)
    for i, rows in got.items():
        assert sorted(rows) == list(range(1, min(16, len(vectors[i])) + 1))
        assert {(r.n, r.deviation) for r in rows.values()} == {(n, deviations[i])}
    for j in range(whitened.shape[1]):
        mine = np.array([got[i][j + 1].whitened for i in range(len(vectors))])
        assert min(np.abs(mine - whitened[:, j]).max(), np.abs(mine + whitened[:, j]).max()) < tolerance
        assert abs(got[0][j + 1].explained - values[j] / values.sum()) < 1e-9
    assert got[0][1].identity_error < 1e-9
    return got


def test_given_table(spark, data_dir):
    df = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    rows = {r.vec_id: list(map(float, r.embedding)) for r in df.collect()}
    assert sorted(rows) == list(range(len(rows)))
    check(df, [rows[i] for i in range(len(rows))])


def test_many_rows_and_a_hot_vector(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(2000, 20)) * np.geomspace(3, 0.2, 20)).tolist()
    vectors[1000:] = [vectors[0]] * 1000
    check(frame(spark, vectors).repartition(7), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(50, 3)).tolist()
    odd = [None, [], [None, 1.0, 2.0], [math.nan, 0.0, 1.0], [math.inf, 0.0, 1.0], [1.0, 2.0], [2.0**46, 0.0, 0.0], [1e300] * 3]
    got = whiten(frame(spark, vectors + odd + [vectors[7]] * 4, [*range(58), None, 7, 7, 3])).collect()
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, []).append(r)
    assert rows.keys() == {*range(50), None} and len(rows[7]) == 9 and len(rows[3]) == 6 and len(rows[None]) == 3
    n, deviations, _, _ = brute(vectors)
    assert {r.n for r in got} == {50} and {r.deviation for r in rows[9]} == {deviations[9]}
    # beyond 64 bits
    large = frame(spark, [[2.0**45], [-(2.0**45)], [1.0]])
    assert {r.deviation for r in whiten(large).collect()} - {None}
    assert all(r.deviation is None for r in whiten(large).filter("vec_id < 2").collect())


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_no_variance(spark, vectors):
    rows = whiten(frame(spark, vectors)).collect()
    assert len(rows) == 2 * len(vectors)
    assert {(r.whitened, r.explained, r.identity_error, r.n, r.deviation) for r in rows} == {(None, None, None, 1, 0)}


def test_some_variance(spark):
    """Components without variance have no whitened value; the others are whole."""
    vectors = [[float(i % 5), float(i % 5) * 2, 3.0, float(i % 3)] for i in range(15)]
    rows = whiten(frame(spark, vectors)).collect()
    assert {r.component for r in rows if r.whitened is not None} == {1, 2} and rows[0].identity_error < 1e-9
    assert len(rows) == 60 and abs(sum(r.explained for r in rows[:4]) - 1) < 1e-12


def test_empty_table(spark):
    assert whiten(frame(spark, [])).count() == 0 and fit(frame(spark, [])) is None
    assert whiten(frame(spark, [None, []])).collect() == []


def test_secular_roots():
    rng = np.random.default_rng(0)
    for d in (np.sort(rng.normal(size=40) ** 2), np.array([0.0]), np.array([0, 1e-9, 1.0, 1 + 1e-9]), np.geomspace(1e-12, 1e6, 30)):
        z = rng.normal(size=len(d)) + 0.1
        z /= np.linalg.norm(z)
        for rho in (1e-6, 1.0, 1e5):
            values, distances = secular_roots(d, z * z, rho)
            want = np.linalg.eigvalsh(np.diag(d) + rho * np.outer(z, z))
            assert np.abs(values - want).max() <= 1e-13 * max(d[-1], rho)
            assert (values >= d).all() and (np.diag(distances) > 0).all()


@pytest.mark.parametrize("kind", ["normal", "low rank", "equal values", "axes"])
def test_updates(kind):
    """Row by row and in two halves: the scatter of all rows, with orthogonal vectors."""
    rng = np.random.default_rng(2)
    x = {
        "normal": lambda: rng.normal(size=(400, 24)) * 8,
        "low rank": lambda: np.round(rng.normal(size=(400, 3)) * 3) @ np.round(rng.normal(size=(3, 24)) * 5),
        "equal values": lambda: np.concatenate([np.eye(24), -np.eye(24)] * 4) * 5,
        "axes": lambda: np.eye(24)[rng.integers(0, 24, 400)] * 3,
    }[kind]()
    halves = [Spectrum.empty(24), Spectrum.empty(24)]
    for i, row in enumerate(x):
        halves[i % 2].add(row)
    one, other = halves
    one.merge(other)
    one.merge(Spectrum.empty(24))
    want = np.cov(x.T, bias=True) * len(x)
    assert one.count == len(x) and np.abs(one.mean - x.mean(0)).max() < 1e-12
    assert np.abs(one.vectors.T @ one.vectors - np.eye(one.vectors.shape[1])).max() < 1e-12
    assert np.abs(one.vectors * one.values @ one.vectors.T - want).max() < 1e-12 * np.abs(want).max()
