"""Whitening of vectors: their covariance, its leading eigenvectors, and the vectors in those directions with variance 1.

Sums and covariances are made by Spark, from partial ones of each partition;
only what is as large as the vectors are long comes to the driver: a vector of
sums and a square matrix. There the matrix is brought to tridiagonal form by
Householder reflections, its largest eigenvalues are bracketed by counts of
Sturm sequences, and their vectors found by inverse iteration, in which those
of close eigenvalues are kept orthogonal. The components then go to all
executors with the projection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaworks.llm.shared import release, stored

#: Entries become whole numbers: floor(SCALE * c) + SHIFT. Components that are kept, and partial covariances that are added up at a time.
SCALE, SHIFT = 1024, 100_000
COMPONENTS, FAN = 8, 32
#: Longest vectors: their covariance, 128 MB at this length, must fit into the driver. Entries whose whole numbers and their distances are longs.
MOST_LENGTH, MOST_ENTRY = 4096, float(1 << 50)
#: Sums are kept as multiples of this and a rest, so that neither leaves a long below 2^31 vectors a partition and 2^31 partitions.
_HIGH = 1 << 32


# --- the eigenvectors of a symmetric matrix, on the driver


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix by Householder reflections; reflection k leaves the first k + 1 entries alone."""
    a = np.array(a, float)
    reflections = []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        size = math.sqrt(float(x @ x))
        v = x.copy()
        if size > 0:
            v[0] += math.copysign(size, x[0])
            v /= math.sqrt(float(v @ v))
            rest = a[k + 1 :, k + 1 :]
            w = rest @ v
            w -= (w @ v) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = a[k, k + 1] = -math.copysign(size, x[0])
        reflections.append(v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflections


def turned_back(vectors: np.ndarray, reflections: list[np.ndarray]) -> np.ndarray:
    """Vectors (columns) of the tridiagonal matrix as those of the matrix it was made from."""
    vectors = vectors.copy()
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    return vectors


def counts_below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are smaller than each x: negative terms of its Sturm sequence."""
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(e * e, initial=0.0)))
    q = d[0] - x
    n = (q < 0).astype(int)
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[k] - x - e[k - 1] * e[k - 1] / q
        n += q < 0
    return n


def largest_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, by bisection of all at once, until no double lies between the bounds."""
    n = len(d)
    around = np.concatenate([[0.0], np.abs(e), [0.0]])
    reach = around[:-1] + around[1:]
    low, high = np.full(k, float(np.min(d - reach))), np.full(k, float(np.max(d + reach)))
    high += np.abs(high) * 1e-12 + np.finfo(float).tiny
    # The j-th largest has n - 1 - j below it.
    below = n - 1 - np.arange(k)
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        right = counts_below(d, e, middle) <= below
        low, high = np.where(right, middle, low), np.where(right, high, middle)


def _factored(d: np.ndarray, e: np.ndarray, shift: float, least: float) -> tuple[np.ndarray, ...]:
    """Elimination with row exchanges of the tridiagonal matrix less the shift: pivots, the two diagonals right of them, factors, exchanges."""
    n = len(d)
    u, v, w = d - shift, np.append(e, 0.0), np.zeros(n)
    factor, swapped = np.zeros(n), np.zeros(n, bool)
    for k in range(n - 1):
        low, diagonal, right = e[k], u[k + 1], v[k + 1]
        if abs(low) > abs(u[k]):
            swapped[k] = True
            factor[k] = u[k] / low
            u[k + 1], v[k + 1] = v[k] - factor[k] * diagonal, -factor[k] * right
            u[k], v[k], w[k] = low, diagonal, right
        else:
            if abs(u[k]) < least:
                u[k] = least
            factor[k] = low / u[k]
            u[k + 1] = diagonal - factor[k] * v[k]
    if abs(u[-1]) < least:
        u[-1] = least
    return u, v, w, factor, swapped


def _solved(factors: tuple[np.ndarray, ...], b: np.ndarray) -> np.ndarray:
    u, v, w, factor, swapped = factors
    b, n = b.copy(), len(b)
    for k in range(n - 1):
        if swapped[k]:
            b[k], b[k + 1] = b[k + 1], b[k] - factor[k] * b[k + 1]
        else:
            b[k + 1] -= factor[k] * b[k]
    b[-1] /= u[-1]
    if n > 1:
        b[-2] = (b[-2] - v[-2] * b[-1]) / u[-2]
    for k in range(n - 3, -1, -1):
        b[k] = (b[k] - v[k] * b[k + 1] - w[k] * b[k + 2]) / u[k]
    return b


def tridiagonal_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling eigenvalues by inverse iteration.

    Each is made orthogonal to those before it whose eigenvalues are within a
    thousandth of the matrix's size; equal eigenvalues are shifted apart.
    """
    n, eps = len(d), np.finfo(float).eps
    size = float(np.max(np.abs(d) + np.append(np.abs(e), 0) + np.append(0, np.abs(e)), initial=0.0)) or 1.0
    rng = np.random.default_rng(0)
    found: list[np.ndarray] = []
    shift, first = math.inf, 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            first = k
        shift = min(float(value), shift - 10 * eps * size) if k > first else float(value)
        factors = _factored(d, e, shift, eps * size)
        x = rng.uniform(-1, 1, n)
        for _ in range(5):
            x = _solved(factors, x / np.linalg.norm(x))
            # Twice, as once leaves what rounding put back.
            for _ in range(2):
                for near in found[first:]:
                    x -= (near @ x) * near
        found.append(x / np.linalg.norm(x))
    return np.column_stack(found) if found else np.empty((n, 0))


def leading_eigenvectors(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the k largest eigenvalues of a covariance that differ from 0, as doubles tell."""
    n = len(matrix)
    scale = float(np.max(np.abs(matrix), initial=0.0))
    if n == 0 or scale == 0:
        return np.empty(0), np.empty((n, 0))
    d, e, reflections = tridiagonal(matrix / scale)
    values = largest_eigenvalues(d, e, min(k, n))
    values = values[values > n * np.finfo(float).eps * values[0]]
    return values * scale, turned_back(tridiagonal_vectors(d, e, values), reflections)


# --- sums, covariance and projection, by Spark


@dataclass(frozen=True)
class Whitening:
    """What whitening needs of the fit list: n vectors with their sums, the trace of the covariance, and its leading components as columns."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    components: np.ndarray


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def fit_list(vectors: DataFrame, vec_col: str = "embedding", name: str = "x") -> DataFrame:
    """vectors with their entries as whole numbers in column name, without those that are null or empty, hold null, what isn't finite or
    numbers beyond MOST_ENTRY, or are of another length than most (of the longest, if several lengths are as common)."""
    v = F.col(f"`{vec_col}`")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= MOST_ENTRY))
    fit = vectors.filter(F.coalesce((F.size(v) > 0) & sound, F.lit(False)))
    common = fit.groupBy(F.size(v).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = common["length"] if common else 0
    if length > MOST_LENGTH:
        raise ValueError(f"vectors of {length} numbers; the covariance is made for at most {MOST_LENGTH}")
    return fit.filter(F.size(v) == length).select(*[F.col(f"`{c}`") for c in vectors.columns], whole_numbers(v).alias(name))


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _partials(fit: DataFrame, name: str, schema: str, made) -> DataFrame:
    """Rows that made() gives for each partition's matrices, with the partition's number in column part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = made(_matrix(batch.column("x")))
                total, at = part if total is None else total + part, batch.column("part")[0].as_py()
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [at] * len(total), "row": range(len(total)), "values": list(total)}, schema=target)

    kind = pa.int64() if "bigint" in schema else pa.float64()
    target = pa.schema([("part", pa.int64()), ("row", pa.int64()), ("values", pa.list_(kind))])
    read = fit.select(F.col(name).alias("x"), F.spark_partition_id().cast("long").alias("part"))
    return read.mapInArrow(work, f"part long, row long, values {schema}")


def _added_up(partials: DataFrame, parts: int, schema: str) -> DataFrame:
    """The sum of the partitions' rows: FAN of them at a time meet in one task, in the order of their numbers."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(rows.sort_values("part")["values"].to_numpy())
        return pd.DataFrame({"part": [rows["part"].min() // FAN], "row": [rows["row"].iloc[0]], "values": [values.sum(axis=0)]})

    while parts > 1:
        partials = partials.groupBy((F.col("part") / FAN).cast("long").alias("_to"), "row").applyInPandas(add, f"part long, row long, values {schema}")
        parts = -(-parts // FAN)
    return partials


def sums_of(fit: DataFrame, name: str = "x") -> tuple[int, tuple[int, ...]]:
    """(n, sums by place) of the fit list, exact; (0, ()) for an empty one."""
    partials = _partials(fit, name, "array<bigint>", lambda x: np.concatenate([[len(x)], (x // _HIGH).sum(axis=0), (x % _HIGH).sum(axis=0)])[None, :])
    rows = _added_up(partials, fit.rdd.getNumPartitions(), "array<bigint>").collect()
    if not rows:
        return 0, ()
    n, *halves = map(int, rows[0]["values"])
    length = len(halves) // 2
    return n, tuple(high * _HIGH + low for high, low in zip(halves[:length], halves[length:], strict=True))


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x less the mean: whole numbers first, so that no digit is lost."""
    whole = np.array([s // n for s in sums])
    part = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - part


def covariance(fit: DataFrame, n: int, sums: tuple[int, ...], name: str = "x") -> np.ndarray:
    """The fit list's covariance with divisor n, each vector centred before it is multiplied."""

    def products(x: np.ndarray) -> np.ndarray:
        c = centred(x, n, sums)
        return c.T @ c

    added = _added_up(_partials(fit, name, "array<double>", products), fit.rdd.getNumPartitions(), "array<double>")
    rows = sorted(added.select("row", "values").collect())
    return np.array([r["values"] for r in rows]) / n


def fitted(fit: DataFrame, k: int = COMPONENTS, name: str = "x") -> Whitening:
    """The whitening of a fit list (see fit_list()), which is read twice."""
    n, sums = sums_of(fit, name)
    if not n:
        return Whitening(0, (), 0.0, np.empty(0), np.empty((0, 0)))
    matrix = covariance(fit, n, sums, name)
    values, vectors = leading_eigenvectors(matrix, k)
    return Whitening(n, sums, float(np.trace(matrix)), values, vectors)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The sum of (n * x - sums)^2 of each row, exact; None where it is beyond a long."""
    # Of each place n * (x - whole) - rest, which is as large as the distance from the mean and not as the sum.
    whole, rest = np.array([s // n for s in sums]), np.array([s % n for s in sums])
    rough = np.square(centred(x, n, sums) * n).sum(axis=1)
    safe = rough < 4e18
    gaps = np.where(safe[:, None], x - whole, 0) * n - np.where(safe[:, None], rest, 0)
    small = np.square(gaps).sum(axis=1)
    exact = lambda row: int(np.square((row - whole).astype(object) * n - rest.astype(object)).sum())
    found = [int(small[k]) if ok else exact(x[k]) for k, ok in enumerate(safe)]
    return [v if v < 1 << 63 else None for v in found]


def projected(fit: DataFrame, whitening: Whitening, name: str = "x") -> DataFrame:
    """fit without column name, but with deviation and whitened, an array of as many numbers as there are components.

    The components reach all executors with the task's code: at most
    COMPONENTS vectors of at most MOST_LENGTH numbers.
    """
    w = whitening
    onto = w.components / np.sqrt(w.values)
    keep = [c for c in fit.columns if c != name]
    out = fit.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(name))
                z = centred(x, w.n, w.sums) @ onto
                columns = [batch.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(_deviations(x, w.n, w.sums), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], [*keep, "deviation", "whitened"])

    return fit.mapInArrow(work, out)


def identity_error(whitened: DataFrame, k: int, name: str = "whitened") -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity; 0 without components."""
    pairs = list(combinations_with_replacement(range(k), 2))
    if not pairs:
        return 0.0
    entry = lambda j: F.get(name, F.lit(j))
    errors = [F.abs(F.covar_pop(entry(a), entry(b)) - float(a == b)) for a, b in pairs]
    return float(whitened.agg(F.array_max(F.array(*errors)).alias("error")).first()["error"] or 0.0)


def whitened_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each vector of the fit list and each of its leading components.

    Components are numbered from 1 by falling eigenvalue; there are fewer than
    k where the fit list's vectors span fewer directions (none for a single
    vector, or if all are equal: no rows then). Null vectors, vectors with
    null or other than finite entries, and those of an unusual length (see
    fit_list()) are left out. Rows that repeat an id or a vector, and null ids,
    are rows like others. deviation is null where it is beyond a long. Other
    columns are left out.
    """
    named = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").alias("embedding"))
    fit = stored(fit_list(named).select("vec_id", "x"), "whitening-x")
    w = fitted(fit, k)
    if not len(w.values):
        empty = fit.select("vec_id", F.lit(0).alias("component"), *[F.lit(0).cast("long").alias(c) for c in ("n", "deviation")], *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
        return empty.filter(F.lit(False))
    found = stored(projected(fit, w), "whitening-z")
    release(fit)
    error = identity_error(found, len(w.values))
    shares = F.array(*[F.lit(float(e) / w.trace) for e in w.values])
    rows = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
