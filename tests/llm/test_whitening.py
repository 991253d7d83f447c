from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from oracle import FOLDER

from tarn.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, x string, _key int"


def usable(vector) -> bool:
    return vector is not None and len(vector) > 0 and all(c is not None and math.isfinite(c) for c in vector)


def hold(rows, vectors: list[tuple], components: int = 4) -> None:
    """Against numpy's own eigenvectors of the covariance of the distinct vectors, with Python's whole numbers."""
    kept = [(k, tuple(math.floor(256 * float(c)) for c in v)) for k, v in vectors]
    distinct = sorted({x for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    x = np.array(distinct, float)
    values, directions = np.linalg.eigh(np.cov(x.T, bias=True))
    values, directions = values[::-1], directions[:, ::-1]
    got = defaultdict(list)
    for r in rows:
        got[r.vec_id].append(r)
    want = defaultdict(list)
    for key, v in kept:
        want[key].append(v)
    assert set(got) == set(want)
    signs = {}
    for key, own in want.items():
        mine = sorted(got[key], key=lambda r: (r.component, r.whitened))
        assert len(mine) == components * len(own)
        for c in range(1, components + 1):
            plain = sorted((np.array(v) - np.array(sums) / n) @ directions[:, c - 1] / math.sqrt(values[c - 1]) for v in own)
            found = [r for r in mine if r.component == c]
            if len(own) == 1 and abs(plain[0]) > 1e-3:
                assert signs.setdefault(c, np.sign(found[0].whitened * plain[0])) == np.sign(found[0].whitened * plain[0])
            assert sorted(abs(r.whitened) for r in found) == pytest.approx(sorted(map(abs, plain)), abs=1e-8)
            assert all(r.n == n and r.identity_error < 1e-10 and r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-10) for r in found)
            assert sorted(r.deviation for r in found) == sorted(sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in own)


def test_query_against_plain_eigenvectors(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    hold(queries.op13_jacobi_whitening(spark, FOLDER).collect(), [v for v in vectors if usable(v[1])])


def test_odd_rows(spark):
    """Null, NaN, infinite and empty vectors, another length, repeated rows and keys, a common vector, clashing columns."""
    draw = np.random.default_rng(3)
    good = [(i, [float(c) for c in draw.normal(size=5) * [4, 3, 2, 1, 0.5]]) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(200)] + [good[1], good[1], (None, good[2][1]), (7, good[9][1])]
    bad = [(1, None), (2, [1.0, None, 0.0, 0.0, 0.0]), (3, [float("nan")] * 5), (4, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (5, []), (6, [1.0, 2.0])]
    df = spark.createDataFrame([(k, v, "a", "b", 1) for k, v in good + bad], SCHEMA)
    stored = {(r.vec_id, tuple(r.embedding)) for r in df.filter("size(embedding) = 5").collect() if usable(r.embedding)}
    rows = [(k, v) for k, v in ((k, next(s[1] for s in stored if s[0] == k and np.allclose(s[1], v, atol=1e-5))) for k, v in good)]
    hold(whitening.whiten(df).collect(), rows)


def test_too_little_to_whiten(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == []
    one = spark.createDataFrame([(k, [1.0, 2.0], "", "", 0) for k in range(5)], SCHEMA)
    assert whitening.whiten(one).collect() == []
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0], "", "", 0) for k in range(5)], SCHEMA)
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_what_does_not_fit_is_an_error(spark):
    wide = spark.createDataFrame([(1, [1e30, 0.0], "", "", 0), (2, [0.0, 1.0], "", "", 0)], SCHEMA)
    with pytest.raises(Exception, match="does not fit a long"):
        whitening.whiten(wide).collect()
    far = spark.createDataFrame([(k, [1e9 * k, float(k * k)], "", "", 0) for k in range(9)], SCHEMA)
    with pytest.raises(Exception, match="does not fit a long"):
        whitening.whiten(far, 1).collect()


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_jacobi_keeps_small_eigenvalues(size):
    draw = np.random.default_rng(size)
    scale = np.logspace(0, -7, size)
    inner = draw.normal(size=(4 * size, size))
    matrix = (inner.T @ inner) * scale[:, None] * scale
    values, vectors = whitening.jacobi(matrix)
    assert (np.diff(values) <= 0).all()
    assert abs(vectors @ vectors.T - np.eye(size)).max() < 1e-13
    want = np.linalg.svd(inner * scale, compute_uv=False) ** 2
    assert values == pytest.approx(want, rel=1e-9)
    assert whitening.jacobi(np.zeros((size, size)))[0].tolist() == [0.0] * size
