"""Viewers against what lies near them, many pairs at a time: the arithmetic of similarity, time and geo on arrays, for tables of viewers.

Values are added and divided in the order of the column functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from plazaworks.functions import geo
from plazaworks.functions.time import DAY

#: Viewers that are compared at a time; what lies beyond the reach of all of them isn't compared.
GROUP = 64
#: The least whole number, which no moment is.
NONE = np.iinfo(np.int64).min


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batches cut where one of the key's columns, which are long, changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in key]
        changes = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            changes |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def fields(values: pa.StructArray) -> dict[str, pa.Array]:
    return dict(zip([f.name for f in values.type], values.flatten(), strict=True))


def numbers(values: pa.Array) -> np.ndarray:
    """As doubles, nulls as NaN."""
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def flags(values: pa.Array) -> np.ndarray:
    return values.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def moments(values: pa.Array) -> np.ndarray:
    """Times as whole numbers in their order, nulls first."""
    if pa.types.is_date(values.type):
        values = values.cast(pa.timestamp("us"))
    return values.cast(pa.int64()).fill_null(NONE + 1).to_numpy(zero_copy_only=False)


def distinct(values: list) -> tuple[list, np.ndarray]:
    """The different ones of hashable values, and which of them each is."""
    known: dict = {}
    at = np.fromiter((known.setdefault(v, len(known)) for v in values), dtype=np.int64, count=len(values))
    return list(known), at


def tuples(values: pa.Array) -> list[tuple | None]:
    return [None if v is None else tuple(v) for v in values.to_pylist()]


def places(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different places, and which of them each is."""
    found, at = np.unique(np.column_stack([lat, lon]), axis=0, return_inverse=True)
    return found[:, 0], found[:, 1], at.reshape(-1)


def meters(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """geo.haversine_m() of all of the first with all of the second."""
    a, b = lat2[None, :], lat1[:, None]
    h = np.sin(np.radians(b - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(b)) * np.sin(np.radians(lon1[:, None] - lon2[None, :]) / 2) ** 2
    return 2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, np.maximum(0.0, h))))


def common(some: list, others: list) -> np.ndarray:
    """How many elements each of some has in common with each of others; both are lists of tuples without repeats, or None."""
    known: dict = {}
    a = [(i, known.setdefault(x, len(known))) for i, xs in enumerate(some) for x in xs or ()]
    b = [(i, known[x]) for i, xs in enumerate(others) for x in xs or () if x in known]
    left, right = np.zeros((len(some), len(known)), dtype=np.float32), np.zeros((len(others), len(known)), dtype=np.float32)
    for matrix, cells in ((left, a), (right, b)):
        if cells:
            matrix[tuple(np.array(cells).T)] = 1
    return left @ right.T


class Vectors:
    """Vectors of any lengths, or none, with their norms."""

    def __init__(self, values: list, norms: np.ndarray):
        self.values, self.norms = values, norms
        self.sizes = np.array([-1 if v is None else len(v) for v in values], dtype=np.int64)
        self.given = self.sizes >= 0

    def __getitem__(self, at: np.ndarray) -> Vectors:
        return Vectors([self.values[i] for i in at], self.norms[at])


def cosines(some: Vectors, others: Vectors) -> np.ndarray:
    """similarity.cosine_of() of all of some with all of others, all of them given; products are added one after the other, so that a value doesn't hang on what is beside it."""
    found = np.zeros((len(some.values), len(others.values)))
    for size in np.unique(some.sizes[some.sizes > 0]):
        i, j = np.flatnonzero(some.sizes == size), np.flatnonzero(others.sizes == size)
        if not len(i) or not len(j):
            continue
        a, b = (np.array([v.values[k] for k in at], dtype=np.float64) for v, at in ((some, i), (others, j)))
        total = np.zeros((len(i), len(j)))
        for x, y in zip(a.T, np.ascontiguousarray(b.T), strict=True):
            total += x[:, None] * y[None, :]
        norms = some.norms[i][:, None] * others.norms[j][None, :]
        with np.errstate(all="ignore"):
            value = total / norms
        found[np.ix_(i, j)] = np.where(np.isnan(value) | (norms == 0), 0.0, value)
    return found


class Profiles:
    """similarity.traits() of people, those of viewers among them."""

    def __init__(self, age: list, band: np.ndarray, level: np.ndarray, tags: list, lonely: np.ndarray, company: np.ndarray, vectors: Vectors):
        self.age, self.band, self.level, self.tags, self.lonely, self.company, self.vectors = age, band, level, tags, lonely, company, vectors

    @classmethod
    def read(cls, traits: pa.StructArray) -> Profiles:
        f = fields(traits)
        vectors = Vectors([None if v is None else np.array(v, dtype=np.float64) for v in f["vector"].to_pylist()], numbers(f["norm"]))
        return cls(f["age"].to_pylist(), numbers(f["band"]), numbers(f["level"]), tuples(f["tags"]), flags(f["lonely"]), flags(f["company"]), vectors)

    def __getitem__(self, at: np.ndarray) -> Profiles:
        return Profiles([self.age[i] for i in at], self.band[at], self.level[at], [self.tags[i] for i in at], self.lonely[at], self.company[at], self.vectors[at])

    def kinds(self) -> tuple[Profiles, np.ndarray]:
        """The different profiles, and which of them each is."""
        level = [None if np.isnan(x) else x for x in self.level.tolist()]
        vector = [None if v is None else v.tobytes() for v in self.vectors.values]
        _, at = distinct(list(zip(self.age, level, self.tags, self.lonely.tolist(), self.company.tolist(), vector, strict=True)))
        _, first = np.unique(at, return_index=True)
        return self[first], at


def likeness(some: Profiles, others: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """similarity.traits_similarity() of all of some with all of others, and the cosines, NaN where a vector is missing."""
    names = {a: i for i, a in enumerate(dict.fromkeys([*some.age, *others.age])) if a is not None}
    a, b = (np.array([names.get(x, -1) for x in p.age])[s] for p, s in ((some, np.s_[:, None]), (others, np.s_[None, :])))
    gap = np.abs(some.band[:, None] - others.band[None, :])
    age = np.where(np.isnan(gap), a == b, np.where(gap == 0, 1.0, np.where(gap == 1, 0.5, 0.0)))
    present = (a >= 0) & (b >= 0)
    total, n = np.where(present, age, 0.0), present.astype(np.float64)

    def add(part: np.ndarray, present: np.ndarray) -> None:
        np.add(total, part, out=total, where=present)
        np.add(n, 1, out=n, where=present)

    sport = 1 - np.abs(some.level[:, None] - others.level[None, :]) / 3
    add(sport, ~np.isnan(sport))
    mine, at = distinct(some.tags)
    theirs, their_at = distinct(others.tags)
    both = common(mine, theirs).astype(np.float64)
    sizes = [np.array([len(t or ()) for t in x], dtype=np.float64) for x in (mine, theirs)]
    with np.errstate(all="ignore"):
        jaccard = both / (sizes[0][:, None] + sizes[1][None, :] - both)
    tagged = (sizes[0] > 0)[:, None] & (sizes[1] > 0)[None, :]
    named = [[tuple(x for x in t or () if x is not None) for t in x] for x in (mine, theirs)]
    shared = common(*named) > 0
    pick = np.ix_(at, their_at)
    add(jaccard[pick], tagged[pick])
    cosine = np.full(total.shape, np.nan)
    i, j = np.flatnonzero(some.vectors.given), np.flatnonzero(others.vectors.given)
    if len(i) and len(j):
        cosine[np.ix_(i, j)] = cosines(some.vectors[i], others.vectors[j])
    add(cosine, ~np.isnan(cosine))
    lonely, company = (some.lonely[:, None], others.lonely[None, :]), (some.company[:, None], others.company[None, :])
    add(np.ones_like(total), lonely[0] & company[1] | lonely[1] & company[0] | company[0] & company[1] & shared[pick])
    return np.where(n > 0, total / np.maximum(n, 1), 0.0), cosine


def segments(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans [a, b) and [0, d) of time's windows; NaN is null."""
    bad = (start > DAY) | (end > DAY) | (start < 0) | (end < 0)
    a = np.where(bad | (start == end), 0.0, start)
    b = np.where(bad, 0.0, np.where(start >= end, float(DAY), end))
    return a, b, np.where(~bad & (start > end), end, 0.0)


def fits(start: np.ndarray, end: np.ndarray, minute: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """time.time_fit() of all windows at all minutes, NaN where it is null, and which minutes surely lie outside a window."""
    a, b, d = (x[:, None] for x in segments(start, end))
    m, s, e = minute[None, :], start[:, None], end[:, None]
    inside = (m >= a) & (m < b) | (m < d)
    unknown = np.isnan(m) | np.isnan(b) & (m >= a)
    outside = ~np.isnan(s) & ~inside & ~unknown
    size = np.mod(e - s, DAY)
    with np.errstate(all="ignore"):
        fit = 1 - np.abs(np.mod(m - s, DAY) - size / 2.0) / size
    return np.where(np.isnan(s) | np.isnan(e) | (size == 0), 1.0, np.where(outside, 0.0, fit)), outside


def meets(start: np.ndarray, end: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """time.windows_overlap() of all of the first with all of the second; those without a window meet all."""
    a, b, d = (x[:, None] for x in segments(start, end))
    e, f, h = (x[None, :] for x in segments(start2, end2))
    zero = np.zeros((1, 1))
    meet = lambda x, y, z, w: np.fmax(x, z) < np.fmin(y, w)
    found = meet(a, b, e, f) | meet(a, b, zero, h) | meet(zero, d, e, f) | meet(zero, d, zero, h)
    return found | np.isnan(start)[:, None] | np.isnan(start2)[None, :]


class Viewers:
    """A block of viewers, in groups of neighbours that are all cold or all known."""

    def __init__(self, rows: pa.StructArray):
        f = self.columns = fields(rows)
        self.names = f["viewer"]
        self.lat, self.lon, self.start, self.end = (numbers(f[c]) for c in ("lat", "lon", "start_minute", "end_minute"))
        self.cold, self.women, self.wheels = (flags(f[c]) for c in ("cold", "women", "wheels"))
        self.disliked = tuples(f["disliked"])
        self.profiles = Profiles.read(f["me"])
        # Squares of about 4 km, in which those with windows of like lengths follow each other.
        size = np.nan_to_num(np.where(self.end == self.start, DAY, np.mod(self.end - self.start, DAY)), nan=DAY)
        order = np.lexsort((size, np.floor(self.lon * 16), np.floor(self.lat * 25), self.cold))
        ends = [0, int((~self.cold).sum()), len(order)]
        self.groups = [order[k : min(k + GROUP, b)] for a, b in zip(ends, ends[1:], strict=False) for k in range(a, b, GROUP)]

    def ruled_out(self, group: np.ndarray, kinds: list[tuple]) -> np.ndarray:
        """Which viewers of the group none of a kind (blocked, for_women, words) are for."""
        blocked, women = (np.array([k[i] for k in kinds], dtype=bool) for i in (0, 1))
        out = self.wheels[group][:, None] & blocked | ~self.women[group][:, None] & women
        return out | (common([tuple(dict.fromkeys(self.disliked[i] or ())) for i in group], [tuple(x for x in k[2] or () if x is not None) for k in kinds]) > 0)
