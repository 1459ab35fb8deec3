import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, rows, parts=5):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("n", "x", "white", "component", "part")}).repartition(parts)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.outer(np.arange(n), np.arange(n)), np.eye(n), np.zeros((n, n)), np.diag(10.0 ** -np.arange(n))):
        a = a + a.T
        values, vecs = whitening.symmetric_qr(a.astype(float))
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.abs(a).max()))
        assert np.allclose(vecs.T @ vecs, np.eye(n), atol=1e-13 * n)
        assert np.allclose(vecs * values @ vecs.T, a, atol=1e-12 * n * max(1, np.abs(a).max()))


def test_merged_moments_equal_those_of_all_rows():
    x = np.random.default_rng(1).integers(99_000, 101_000, (500, 6)).astype(float)
    whole = whitening.Moments()
    for part in np.array_split(x, [1, 1, 40, 41, 300]):
        own = whitening.Moments()
        for row in part:
            own.add(row)
            own.sums += row.astype(np.int64)
        whole.merge(own)
    assert whole.n == 500 and (whole.sums == x.sum(axis=0)).all()
    assert np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-12, atol=1e-6)


def test_equals_a_dense_solution(spark):
    rng = np.random.default_rng(2)
    e = (rng.normal(size=(300, 12)) * np.linspace(2, 0.1, 12)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(e)] + [(0, e[0].tolist()), (None, e[1].tolist())]
    bad = [(900, None), (901, [1.0] * 11 + [float("nan")]), (902, [1.0] * 11 + [None]), (903, [1.0] * 11 + [float("-inf")])]
    got = whitening.whiten(table(spark, rows + bad, 70)).toPandas()
    x = np.floor(np.concatenate([e, e[:2]]).astype(float) * 1024).astype(np.int64) + 100_000
    values, vecs = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vecs = values[::-1], vecs[:, ::-1]
    assert len(got) == 302 * 8 and (got["n"] == 302).all()
    of = {c: got[got.component == c + 1].sort_values("deviation") for c in range(8)}
    apart = ((302 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    order = np.argsort(apart, kind="stable")
    for c in range(8):
        want = ((x - x.mean(axis=0)) @ vecs[:, c] / np.sqrt(values[c]))[order]
        have = of[c].whitened.values
        assert (of[c].deviation.values == apart[order]).all()
        assert min(abs(have - want).max(), abs(have + want).max()) < 1e-9
        assert of[c].explained.iloc[0] == pytest.approx(values[c] / values.sum(), rel=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


def test_components_without_variance(spark):
    same = whitening.whiten(table(spark, [(k, [1.0, 2.0, 3.0]) for k in range(4)])).collect()
    assert len(same) == 12 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] == 0 and r["deviation"] == 0 for r in same)
    flat = whitening.whiten(table(spark, [(k, [float(k), 0.5]) for k in range(4)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)}
    assert {round(r["explained"], 9) for r in flat} == {0, 1}


def test_one_row_and_none(spark):
    assert [r["whitened"] for r in whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect()] == [None, None]
    for rows in ([], [(1, None)], [(1, [])]):
        got = whitening.whiten(table(spark, rows))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_vectors_of_two_lengths_are_refused(spark):
    with pytest.raises(Exception, match="vectors of"):
        whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0])])).collect()


def test_a_deviation_beyond_a_long_is_refused(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        whitening.whiten(table(spark, [(1, [4e9]), (2, [-4e9])])).collect()


def test_only_the_sum_of_squares_itself_has_to_fit_a_long(spark):
    """One large entry among 64 is no reason to refuse the row (F1 of round 4): 64 times its square would not fit."""
    rows = [(k, [0.0] * 63 + [(-1.0) ** k * 1e6]) for k in range(2)]
    got = {(r["vec_id"], r["deviation"]) for r in whitening.whiten(table(spark, rows)).collect()}
    assert got == {(0, 2048000000**2), (1, 2048000000**2)} and 64 * 2048000000**2 >= 2**63


def test_the_border_of_a_long_is_exact():
    most = 3037000499  # the largest whole number whose square is below 2 ** 63
    rest = 2**63 - 1 - most * most
    for row, good in ([most, 0], True), ([most, int(rest**0.5)], True), ([most, int(rest**0.5) + 1], False), ([most + 1, 0], False):
        apart = np.array([row, [0, 0]])
        assert whitening.fits(apart, apart.astype(float)) == good
    wrapped = np.array([[5]])  # 2 ** 64 + 5, had it fitted
    assert not whitening.fits(wrapped, np.array([[2.0**64 + 5]]))
