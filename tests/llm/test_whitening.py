"""Whitening against a plain eigendecomposition, the eigensolver on spectra with gaps, ties and none, and odd tables."""

from collections import defaultdict

import numpy as np
import pytest

from penprint.llm import feast, whitening
from penprint.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
KINDS = "vec_id long, embedding array<double>"


def matrix(kind, size):
    rng = np.random.default_rng(size)
    if kind == "equal":
        return 3.0 * np.eye(size)
    rows = rng.standard_normal((400, size))
    if kind == "spikes":
        rows += 10 * rng.standard_normal((400, 9)) @ rng.standard_normal((9, size))
    if kind == "low rank":
        rows = 50 * rng.standard_normal((400, 2)) @ rng.standard_normal((2, size))
    rows -= rows.mean(0)
    out = rows.T @ rows / len(rows)
    if kind == "tie":  # the fourth and fifth are equal
        values, vectors = np.linalg.eigh(out)
        values[-4] = values[-5]
        out = vectors * values @ vectors.T
        out = (out + out.T) / 2
    return out


@pytest.mark.parametrize("kind,size", [("plain", 1), ("plain", 2), ("plain", 5), ("plain", 64), ("spikes", 64), ("low rank", 64), ("equal", 30), ("tie", 40)])
def test_eigenpairs(kind, size):
    m = matrix(kind, size)
    values, vectors = feast.largest_eigenpairs(m, 4)
    want = np.linalg.eigvalsh(m)[::-1]
    assert len(values) == (2 if kind == "low rank" else min(4, size))
    assert np.abs(values - want[:len(values)]).max() < 1e-12 * want[0]
    assert np.abs(m @ vectors.T - vectors.T * values).max() < 1e-12 * want[0] and np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    for bound in np.linspace(-want[0], 1.1 * want[0], 9):
        assert feast.count_above(m, bound) == (want > bound).sum()


def test_inertia_with_zero_diagonal():
    m = np.array([[0.0, 2, 0], [2, 0, 0], [0, 0, -1]])
    assert feast.negative_pivots(m) == 2 and feast.negative_pivots(-m) == 1 and feast.negative_pivots(0 * m) == 0


def plain(rows, k=4):
    """(vec_id, deviation, whitened) of the rows that take part, n and shares of variance."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(x) for _, x in kept), default=0)
    kept = [(i, x) for i, x in kept if len(x) == width]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x) - np.array(sums) / n) @ vectors[:, :k] / np.sqrt(values[:k])) for i, x in kept]
    return out, n, values / values.sum()


def agree(rows, want, n, shares, k=4):
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.component):
        assert r.n == n and abs(r.explained / shares[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        found[r.vec_id, r.deviation].append(r.whitened)
    got = {(i, d): np.array(w).reshape(-1, k) if len(w) % k == 0 else None for (i, d), w in found.items()}
    assert set(got) == {(i, d) for i, d, _ in want}
    signs = np.ones(k)
    i, d, w = max(want, key=lambda r: np.abs(r[2]).min())
    signs = np.sign(got[i, d][0] * w)
    for i, d, w in want:
        assert np.abs(np.array(found[i, d])[:k] * signs - w).max() < 1e-8


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = QUERIES["op11_whitening"](spark, FOLDER).collect()
    want, n, shares = plain(rows)
    assert len(got) == 4 * len(want)
    agree(got, want, n, shares)


def test_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(40)]
    rows += [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5), (105, [1.0, 2.0])]
    rows += [(7, rows[7][1]), (200, rows[7][1]), (201, [-0.0] * 5)]  # a repeated row, a copy under another id, negative zeros
    df = spark.createDataFrame(rows, KINDS).selectExpr("*", "'x' AS whitened", "1 AS n")
    model = whitening.fit(df, k=4)
    got = whitening.component_rows(whitening.transform(df, model, carry=["vec_id"]), model, ["vec_id"]).collect()
    want, n, shares = plain(rows)
    assert model.n == n == 41 and len(got) == 4 * len(want)
    agree([r for r in got if r.vec_id != 7] + [r for r in got if r.vec_id == 7][:4], want, n, shares)
    assert whitening.transform(df, model).columns == ["vec_id", "embedding", "n", "whitened", "deviation"]
    none = spark.createDataFrame([(None, [1.0] * 5)], KINDS)
    assert whitening.transform(none, model, carry=["vec_id"]).first()["vec_id"] is None


def test_no_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, KINDS)
        model = whitening.fit(df)
        assert len(model.variances) == 0 and whitening.component_rows(whitening.transform(df, model), model, ["vec_id"]).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], KINDS)
    model = whitening.fit(line)
    assert len(model.variances) == 1 and abs(model.variances[0] / model.total - 1) < 1e-12


def test_deviations_beyond_a_product_of_longs():
    model = whitening.Whitening(3, np.array([2**31, 0]), np.zeros((0, 2)), np.zeros(0), 1.0, 0.0)
    assert model.deviations(np.array([[2**30, 1]])).tolist() == [(3 * 2**30 - 2**31) ** 2 + 9]
    with pytest.raises(OverflowError):
        model.deviations(np.array([[2**40, 1]]))
