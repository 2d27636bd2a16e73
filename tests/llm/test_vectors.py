"""Embedding whitening against plain numpy."""

import math

import numpy as np
import pytest

from veritally.llm import whitening as W


def plain_whitening(rows, components, weights):
    """Rows (id, vector) to {(place, component): (n, deviation, |whitened|, explained)}."""
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good}) if weights == "one" else [tuple(x) for _, x in good]
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(len(fit[0]))]
    z = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    out = []
    for i, x in good:
        d = [n * a - s for a, s in zip(x, sums, strict=True)]
        for k in range(min(components, len(sums))):
            e, v = values[-1 - k], vectors[:, -1 - k]
            out.append((i, k + 1, n, sum(a * a for a in d), float(np.array(d) / n @ v / math.sqrt(e)), e / values.sum()))
    return out


def by_row(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4])))


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_is_brute_force(spark, weights):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # a third is one vector
    rows += [(None, rows[7][1]), (8, rows[8][1]), (2, None), (3, [1.0, None] + [0.0] * 4), (4, [1.0, float("nan")] + [0.0] * 4), (5, [float("-inf")] * 6), (6, [])]
    df = spark.createDataFrame([(i, v, 1, 2, "z") for i, v in rows], "vec_id long, embedding array<double>, k1 int, component int, x string").repartition(5)
    got = by_row(W.whitened(df, 4, weights).collect())
    want = by_row(plain_whitening(rows, 4, weights))
    assert [tuple(r[:4]) for r in got] == [w[:4] for w in want]
    signs = {}
    for g, w in zip(got, want, strict=True):
        assert abs(g["whitened"]) == pytest.approx(abs(w[4]), rel=1e-8, abs=1e-8)
        assert g["explained"] == pytest.approx(w[5], rel=1e-10)
        assert g["identity_error"] < 1e-9
        if abs(w[4]) > 1e-6:
            signs.setdefault(g["component"], set()).add(g["whitened"] * w[4] > 0)
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


def test_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got, want = by_row(W.whitened(df).collect()), by_row(plain_whitening(rows, 16, "one"))
    assert [tuple(r[:4]) for r in got] == [w[:4] for w in want] and got
    assert all(abs(g["whitened"]) == pytest.approx(abs(w[4]), abs=1e-6) for g, w in zip(got, want, strict=True))


def test_tables_without_variance_and_empty_ones(spark):
    schema = "vec_id long, embedding array<float>"
    assert W.whitened(spark.createDataFrame([], schema)).collect() == []
    assert W.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = W.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one) == [
        (i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    flat = W.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0, 2.0])], schema)).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True}
    assert {r["identity_error"] < 1e-12 for r in flat} == {True}


def test_entries_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e17]), (2, [2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        W.whitened(df).collect()
    with pytest.raises(ValueError, match="one length"):
        W.whitened(spark.createDataFrame([(1, [1.0]), (2, [2.0, 3.0])], "vec_id long, embedding array<double>")).collect()
