import math

import numpy as np
import pytest

from plazaworks.llm import whitening
from plazaworks.llm.queries import QUERIES
from plazaworks.llm.whitening import counts_below, fit_list, largest_eigenvalues, leading_eigenvectors, tridiagonal, turned_back, whitened_vectors

FOLDER = "/root/testdata/sf0.001"


def plain(rows, k=8):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of (vec_id, vector), by numpy's own eigenvectors."""
    fit = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(fit), range(len(fit[0][1]))
    sums = [sum(x[j] for _, x in fit) for j in dims]
    c = np.array([[(n * x[j] - sums[j]) / n for j in dims] for _, x in fit])
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    z = c @ vectors / np.sqrt(values)
    return {(i, j + 1): (n, sum((n * x[d] - sums[d]) ** 2 for d in dims), abs(z[r, j]), values[j] / np.trace(v)) for r, (i, x) in enumerate(fit) for j in range(len(values))}


def same(found, wanted):
    assert len(found) == len(wanted) and {(r.vec_id, r.component) for r in found} == wanted.keys()
    for r in found:
        n, deviation, size, share = wanted[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - size) < 1e-7 and abs(r.explained / share - 1) < 1e-9 and r.identity_error < 1e-7
    # One sign for all rows.
    for j in {r.component for r in found}:
        total = sum(r.whitened * r.whitened for r in found if r.component == j)
        assert abs(sum(r.whitened for r in found if r.component == j)) < 0.5 * math.sqrt(total)


def matrices():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64, 130):
        a = rng.normal(size=(n, n))
        yield a @ a.T
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    yield q @ np.diag([5.0] * 6 + [5 - 1e-12] * 3 + [1.0] * 31) @ q.T
    yield np.diag([3.0, 3.0, 2.0, 2.0, 1.0])
    yield np.diag(np.arange(21.0) - 10) ** 2 + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1) + 2 * np.eye(21)
    yield np.ones((30, 30))
    yield 1e-12 * q @ np.diag(10.0 ** -np.arange(40)) @ q.T


@pytest.mark.parametrize("a", list(matrices()), ids=lambda a: str(len(a)))
def test_eigenvectors_equal_the_definition(a):
    a = (a + a.T) / 2
    d, e, reflections = tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    size = np.abs(a).max() * len(a)
    back = turned_back(np.eye(len(a)), reflections)
    assert np.abs(back @ t @ back.T - a).max() < 1e-13 * size and np.abs(back.T @ back - np.eye(len(a))).max() < 1e-13
    whole = np.linalg.eigvalsh(a)[::-1]
    assert np.abs(largest_eigenvalues(d, e, len(a)) - whole).max() < 1e-13 * size
    middle = (whole[:1] + whole[-1:]) / 2 + 1e-9 * size
    assert counts_below(d, e, middle)[0] == (whole < middle).sum()
    values, vectors = leading_eigenvectors(a, 8)
    k = len(values)
    assert np.abs(values - whole[:k]).max() < 1e-13 * size and all(whole[k:8] <= 1e-13 * size)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * size
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    found = QUERIES["op13_embedding_whitening"](spark, FOLDER).collect()
    same(found, plain([(r.vec_id, r.embedding) for r in rows]))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(1)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(size=3) * (1, 3, 1e3)], k) for k in range(40)]
    rows += [(40, rows[0][1], 0), (40, rows[0][1], 0), (None, rows[1][1], 0)]
    bad = [(50, None, 0), (51, [], 0), (52, [1.0, None, 1.0], 0), (53, [1.0, float("nan"), 1.0], 0), (54, [float("-inf"), 0.0, 1.0], 0), (55, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, x int").repartition(7)
    found = whitened_vectors(df).collect()
    wanted = plain([(i, v) for i, v, _ in rows])
    # Two rows share an id and a vector, and none has an id.
    assert len(found) == 43 * 3 and len(wanted) == 42 * 3
    same([*{(r.vec_id, r.component): r for r in found}.values()], wanted)
    assert whitened_vectors(df, k=2).count() == 43 * 2


def test_too_few_directions(spark):
    schema = "vec_id long, embedding array<double>"
    made = lambda rows: whitened_vectors(spark.createDataFrame(rows, schema))
    line = made([(k, [0.5 * k, 1.5 * k, -k / 2]) for k in range(9)]).collect()
    assert len(line) == 9 and all(r.component == 1 and abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in line)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert made(rows).columns == line[0].__fields__ and made(rows).count() == 0


def test_large_entries(spark):
    rows = [(k, [float(2**49) * (-1) ** k, 1.0 * k]) for k in range(4)] + [(9, [2.0**60, 0.0])]
    found = whitened_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    # What a long can't hold is null; a vector that can't be made whole is left out.
    assert {r.vec_id for r in found} == {0, 1, 2, 3} and {r.n for r in found} == {4} and {r.deviation for r in found} == {None}
    assert fit_list(spark.createDataFrame([(1, [0.0] * 5)], "vec_id long, embedding array<double>")).first().x == [100_000] * 5
