import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import queries, whitening

SMALL = "/root/testdata/sf0.001"


def exact(vectors):
    """n, sums and the covariance in fractions."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, size = len(x), len(x[0])
    sums = [sum(row[i] for row in x) for i in range(size)]
    centred = [[Fraction(row[i]) - Fraction(sums[i], n) for i in range(size)] for row in x]
    return n, x, sums, [[sum(c[i] * c[j] for c in centred) / n for j in range(size)] for i in range(size)]


def check(found, rows, components=32):
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    n, x, sums, exact_cov = exact([v for _, v in good])
    cov = np.array([[float(c) for c in row] for row in exact_cov])
    values = np.linalg.eigvalsh(cov)[::-1]
    wide = min(components, len(values))
    assert len(found) == n * wide and all(r["n"] == n for r in found)
    by = {}
    for r in found:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    assert sorted(by) == list(range(1, wide + 1))
    far = {}
    for (i, _), row in zip(good, x):
        far.setdefault(i, []).append(sum((n * v - s) ** 2 for v, s in zip(row, sums)))
    for own in by.values():
        assert {i: sorted(r["deviation"] for r in rs) for i, rs in own.items()} == {i: sorted(v) for i, v in far.items()}
    w = np.array([[by[k][i][0]["whitened"] for k in sorted(by)] for i, _ in good])
    assert np.abs(w.T @ w / n - np.eye(wide)).max() < 1e-8 and found[0]["identity_error"] < 1e-8
    for k in by:
        assert abs(by[k][good[0][0]][0]["explained"] - values[k - 1] / cov.trace()) < 1e-9
    z = np.array(x, float) - np.array([float(Fraction(s, n)) for s in sums])
    for k in range(wide):                                  # whitened values are projections on an eigenvector, over the root
        axis = np.linalg.lstsq(z, w[:, k] * math.sqrt(values[k]), rcond=None)[0]
        assert abs(np.linalg.norm(axis) - 1) < 1e-8 and np.abs(cov @ axis - values[k] * axis).max() < 1e-6 * values[0]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_against_fractions(spark):
    draw = np.random.default_rng(5)
    mix = draw.normal(size=(6, 6))
    rows = [(i, (draw.normal(size=6) @ mix + [0, 5, -3, 0, 100, 0]).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 6) for i in range(300)]
    bad = [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [float("nan")] + [0.0] * 5), (2003, [float("inf")] * 6), (2004, [1.0]),
           (2005, []), (2006, [3e38] * 6)]
    vectors = table(spark, rows + bad).withColumns({c: F.lit("x") for c in ("x", "n", "_id", "component")})
    check(whitening.report(spark, vectors.repartition(5)).collect(), rows)
    check(whitening.report(spark, vectors, components=2).collect(), rows, 2)


def test_far_from_zero_and_beyond_64_bits(spark):
    """A mean of 2^40 with a spread of a few units, which sums of squares as doubles would lose."""
    rows = [(i, [float(2**34 + 4096 * (i % 5)), float(i % 7) - 2.0**20, float(i * i % 11)]) for i in range(60)]
    check(whitening.report(spark, table(spark, rows)).collect(), rows)
    wide = [(i, [1e13 * (i % 3), 2e13 * (i % 5)]) for i in range(30)]
    found = whitening.report(spark, table(spark, wide)).collect()
    assert len(found) == 60 and sum(r["deviation"] is None for r in found) > 50 and found[0]["identity_error"] < 1e-8
    rows = whitening.integers(table(spark, wide), "vec_id", "embedding")
    model, rows = whitening.fit(rows)
    n, x, sums, cov = exact([[float(np.float32(c)) for c in v] for _, v in wide])
    assert np.array_equal(model.covariance, [[float(c) for c in row] for row in cov])
    far = {r["_id"]: int(r["deviation"]) for r in whitening.projected(spark, rows, model).collect()}
    assert far == {i: sum((n * v - s) ** 2 for v, s in zip(row, sums)) for i, row in enumerate(x)}


def test_constant_and_dependent_dimensions(spark):
    rows = [(i, [float(i % 9), float(i % 9), 4.0, float(i % 4)]) for i in range(36)]
    found = whitening.report(spark, table(spark, rows)).collect()
    assert {r["component"] for r in found} == {1, 2} and found[0]["identity_error"] < 1e-9
    assert sum({r["component"]: r["explained"] for r in found}.values()) == pytest.approx(1)
    for none in ([(1, [1.0, 2.0])], [(1, [1.0])] * 3, [(1, None)], []):
        assert whitening.report(spark, table(spark, none)).collect() == []
    assert whitening.report(spark, table(spark, [])).columns[:3] == ["vec_id", "component", "n"]


def test_limbs():
    for total in (0, 1, -1, 2**32, -2**40 - 5, 2**150 + 12345, -2**158):
        assert sum(v << 32 * k for k, v in enumerate(whitening.limbs(total))) == total


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check(queries.op13_embedding_whitening(spark, SMALL).collect(), rows)
