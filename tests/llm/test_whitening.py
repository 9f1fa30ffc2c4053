import numpy as np
import pytest

from millwatch.llm import entry
from millwatch.llm import whitening as w
from millwatch.llm.storage import table

SF = "/root/testdata/sf0.01"


def brute(x):
    """Eigenpairs of the covariance, falling."""
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(c))
    return c, values[::-1], vectors[:, ::-1]


def test_query_is_a_full_decomposition(spark):
    rows = entry.op12_whitening(spark, SF).toPandas()
    source = table(spark, SF, "embeddings").toPandas()
    x = np.floor(64 * np.stack(source.embedding.to_list()).astype(float)) + 1_000_000
    c, values, vectors = brute(x)
    n = len(x)
    assert len(rows) == 32 * n and set(rows.n) == {n}
    assert rows.identity_error.max() <= 1e-10
    exact = np.square(n * x.astype(np.int64) - x.astype(np.int64).sum(axis=0)).sum(axis=1)
    assert dict(zip(rows.vec_id, rows.deviation, strict=True)) == dict(zip(source.vec_id, exact, strict=True))
    for k, part in rows.groupby("component"):
        want = dict(zip(source.vec_id, c @ vectors[:, k - 1] / np.sqrt(values[k - 1]), strict=True))
        got = part.whitened.to_numpy()
        want = np.array([want[i] for i in part.vec_id])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert part.explained.iloc[0] == pytest.approx(values[k - 1] / values.sum(), rel=1e-10)


@pytest.mark.parametrize("spectrum", ["falling", "near", "equal", "one"])
def test_pairs_are_certified_whatever_the_spectrum(spark, spectrum):
    rng, d = np.random.default_rng(4), 40
    scale = {"falling": 50.0 * 0.8 ** np.arange(d), "near": 10 + 0.01 * np.arange(d), "equal": np.full(d, 5.0), "one": np.where(np.arange(d) < 1, 100.0, 0.5)}[spectrum]
    data = (rng.standard_normal((400, d)) * scale).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(3)
    model = w.fit(w.whole(df, "embedding"), count=6, guard=4)
    c, values, vectors = brute(np.floor(64 * np.array(data)) + 1_000_000)
    assert np.allclose(model.values, values[:6], rtol=1e-10)
    assert np.abs(c.T @ (c @ model.components) / len(c) - model.components * model.values).max() < 1e-10 * values[0]
    assert model.identity_error < 1e-9 and model.residual < 1e-12


def test_filter_damps_the_unwanted_spectrum():
    values = np.concatenate(([100.0, 60.0, 50.0], np.linspace(1, 20, 27)))
    v = np.diag(values)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((30, 6)))[0]
    theta = np.linalg.eigvalsh(q.T @ v @ q)[::-1]
    after = w._filtered(lambda x: v @ x, q, theta, 0)
    outside = lambda q: np.linalg.norm(np.eye(30)[:, :3] - q @ q[:3].T)
    assert outside(after) < outside(q) / 10


def test_odd_rows(spark):
    good = [(i, [float(i % 5), float(i % 3), -1.0]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [1.0, float("inf"), 2.0]), (104, [1.0, 2.0]), (105, []), (None, [4.0, 1.0, -1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS x", "1 AS N", "2 AS at")
    rows = w.whiten(df, keep=["vec_id", "at"]).collect()
    assert {r.vec_id for r in rows} == {*range(30), None} and {r.component for r in rows} == {1, 2}  # the third entry never varies
    assert all(r.at == 2 for r in rows)
    assert w.whiten(df.where("false"), keep=["vec_id"]).count() == 0
    assert w.whiten(df.where("vec_id = 3"), keep=["vec_id"]).count() == 0
    assert w.whiten(df.where("vec_id in (105)"), keep=["vec_id"]).count() == 0
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    got = w.whiten(huge, keep=["vec_id"]).collect()
    assert len(got) == 3 and all(r.deviation is None or r.deviation >= 0 for r in got)
