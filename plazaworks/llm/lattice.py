"""Near-duplicate vectors by lattice hashing.

Each table projects vectors at random to eight dimensions and decodes the
projection to the nearest point of the E8 lattice, the cell. A vector is
listed under its own cell and looks into the neighbouring cells nearest to
its projection; pairs that meet in any table are verified by cosine.

Groups of near copies aren't compared pair by pair. Vectors within half the
angle of the threshold from the first one of a cell form its ball, and all in
a ball are linked with one another. Balls meet in the cells of their members;
the angle between centres, less or more the radii, settles most pairs of balls
as a whole, and only where it doesn't are their members compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaworks.llm.components import components
from plazaworks.llm.shared import release, stored
from plazaworks.llm.shingles import mixed

THRESHOLD = 0.93
#: Independent tables, cells probed in each (the own one included), and the factor of the projections: more of it makes
#: more and smaller cells. At a cosine of 0.93 a table misses about four pairs in ten, all tables fewer than one in a thousand.
TABLES, PROBES, SCALE = 8, 8, 0.9
#: Angles nearer to a bound than this are not trusted; the cosine itself decides there.
MARGIN = 1e-7
#: Bits of a sign hash, and how many deviations more bits than expected may differ before a pair isn't looked at: linked pairs lost, fewer than one in a million.
BITS, DEVIATIONS = 64, 6.5
SEED = 29


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, in halves of a unit."""
    found = []
    for i in range(8):
        for j in range(i):
            for a in (2, -2):
                for b in (2, -2):
                    v = [0] * 8
                    v[i], v[j] = a, b
                    found.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            found.append([-1 if bits >> k & 1 else 1 for k in range(8)])
    return np.array(found, dtype=np.int8)


_NEIGHBOURS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum: round, then turn the worst coordinate the other way if the sum is odd."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    gap = x[odd] - near[odd]
    worst = np.abs(gap).argmax(axis=1)
    near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points of the rows of x, in halves of a unit: E8 is D8 and D8 shifted by a half everywhere."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.rint(2 * np.where(closer[:, None], half, whole)).astype(np.int16)


def _projections(dim: int, tables: int, scale: float, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(tables, dim, 8)) * scale


def _keys(cells: np.ndarray) -> np.ndarray:
    """One 64-bit number for each cell: a byte for each coordinate, kept from running over."""
    bytes_ = np.clip(cells, -127, 127).astype(np.int8)
    return np.ascontiguousarray(bytes_).view(np.int64)[..., 0]


def cells_of(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(cells, probed): for each unit vector its cell in each table, and the cells it looks into, its own first."""
    own = np.zeros((len(vectors), tables), dtype=np.int64)
    seen = np.zeros((len(vectors), tables, probes), dtype=np.int64)
    for t, turn in enumerate(_projections(vectors.shape[1], tables, scale, seed)):
        x = vectors @ turn
        cell = decode_e8(x)
        own[:, t] = _keys(cell)
        seen[:, t, 0] = own[:, t]
        if probes > 1:
            # The nearest neighbours are those most in line with what the cell leaves over.
            left = x - cell / 2
            order = np.argsort(-(left @ _NEIGHBOURS.T.astype(float)), axis=1, kind="stable")[:, : probes - 1]
            seen[:, t, 1:] = _keys(cell[:, None, :] + _NEIGHBOURS[order])
    return own, seen


def _signs(vectors: np.ndarray, seed: int) -> np.ndarray:
    """On which side of random planes each vector lies, a bit for each plane."""
    planes = np.random.default_rng([seed, vectors.shape[1], 1]).normal(size=(vectors.shape[1], BITS))
    return np.packbits(vectors @ planes > 0, axis=1, bitorder="little").view(np.int64)[:, 0]


def _placed(tables: int, probes: int, scale: float, seed: int):
    """Rows that end in a vector to rows that end in its sign hash, its cells and the cells it probes instead; cells of different tables differ."""

    def lists(cells: np.ndarray) -> pa.Array:
        n, width = cells.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(cells.ravel()))

    def keyed(cells: np.ndarray) -> np.ndarray:
        """Cells (row, table, ...) as numbers, a row's in one line."""
        turn = (np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(1, tables, *[1] * (cells.ndim - 2))
        return mixed(cells.view(np.uint64) ^ turn).view(np.int64).reshape(len(cells), -1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 1024):
                batch = whole.slice(k, 1024)
                vectors = batch.columns[-1]
                flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
                begin = np.cumsum(sizes) - sizes
                for size in np.unique(sizes):
                    of = np.flatnonzero(sizes == size)
                    unit = flat[begin[of][:, None] + np.arange(size)]
                    unit = unit / np.abs(unit).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    own, seen = cells_of(unit, tables, probes, scale, seed)
                    rest = batch.take(pa.array(of))
                    yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.array(_signs(unit, seed)), lists(keyed(own)), lists(keyed(seen))], [*batch.schema.names[:-1], "signs", "own", "seen"])

    return work


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _cosine(a: str, b: str) -> Column:
    """Of v_a and v_b by their norms."""
    return _dot(f"v_{a}", f"v_{b}") / (F.col(f"norm_{a}") * F.col(f"norm_{b}"))


def _angle(a: str, b: str) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _cosine(a, b))))


def _alike(a: str, b: str, angle: Column) -> Column:
    """No more of the signs differ than vectors within the angle may have different."""
    share = F.least(F.lit(0.5), angle / math.pi)
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= BITS * share + DEVIATIONS * F.sqrt(BITS * share * (1 - share))


def _named(df: DataFrame, end: str, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{end}") for c in columns])


def _balls(classes: DataFrame, placed: DataFrame, reach: float) -> DataFrame:
    """(c, ball, d): for each class the centre of its ball and the angle to it.

    A centre is the first class of a cell that lies near no other cell's first one.
    """
    listed = placed.select("c", "signs", F.explode("own").alias("cell"), "g").select("c", "signs", F.xxhash64("g", "cell").alias("cell"))
    first = listed.groupBy("cell").agg(F.min("c").alias("lead"), F.min_by("signs", "c").alias("signs_lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = listed.join(first, "cell").filter((F.col("lead") < F.col("c")) & _alike("signs", "signs_lead", F.lit(reach))).select("c", "lead").distinct()
    sides = met.join(_named(classes, "a", "c", "g", "v", "norm"), F.col("c") == F.col("c_a")).join(_named(classes, "b", "c", "g", "v", "norm"), F.col("lead") == F.col("c_b"))
    near = stored(sides.filter("g_a = g_b").select("c", "lead", _angle("a", "b").alias("d")).filter(F.col("d") <= reach), "near-first")
    centres = near.select(F.col("lead").alias("centre")).distinct().join(near.select("c"), F.col("centre") == F.col("c"), "left_anti")
    inner = near.join(centres, F.col("lead") == F.col("centre")).groupBy("c").agg(F.min("centre").alias("ball"), F.min_by("d", "centre").alias("d"))
    found = stored(classes.select("c").join(inner, "c", "left").select("c", F.coalesce("ball", "c").alias("ball"), F.coalesce("d", F.lit(0.0)).alias("d")), "balls")
    release(near)
    return found


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of df.

    Rows of one label are linked at a cosine of at least threshold (above 0).
    Equal vectors of a label are one class, so that copies meet nothing twice;
    vectors of different length are never linked. Null labels, null, empty or
    zero vectors and those with null or non-finite components link with
    nothing. A row without id links with nothing: its component is null, and
    it is kept. Rows that repeat an id are one vector: the smallest of its
    components and the most of its links stand for all. Other columns are not
    read; an empty table gives an empty table.
    """
    widest = math.acos(threshold)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    infinite = F.lit(float("inf"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("v", lambda x: x != 0)
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    # Adding 0 makes -0.0 the 0.0 that it equals.
    rows = stored(rows.select("vec_id", F.when(good, F.col("label")).alias("label"), F.when(good, F.transform("v", lambda x: x + 0.0)).alias("v")), "vectors")
    rows = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit("v"), "v")})
    classes = rows.filter("label IS NOT NULL").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("vec"), F.count_distinct("vec_id").alias("held"), F.first("v").alias("v"))
    # Squares of what is very large or small leave the range of doubles, so such vectors are divided by their largest component.
    top = F.array_max(F.transform("v", F.abs))
    scaled = F.when(top.between(1e-140, 1e140), F.col("v")).otherwise(F.transform("v", lambda x: x / top))
    classes = classes.withColumns({"v": scaled, "g": F.xxhash64("label", F.size("v")), "c": F.monotonically_increasing_id()})
    classes = stored(classes.withColumn("norm", F.sqrt(_dot("v", "v"))), "classes")

    place = _placed(tables, 1, scale, seed)
    placed = stored(classes.select("c", "g", "v").mapInArrow(place, "c long, g long, signs long, own array<long>, seen array<long>"), "cells")
    member = _balls(classes, placed, widest / 2 - MARGIN)
    sums = member.join(classes.select("c", "held"), "c").groupBy("ball").agg(F.count("*").alias("n"), F.sum("held").alias("weight"), F.max("d").alias("r"))
    balls = stored(sums.join(placed.select(F.col("c").alias("ball"), "signs"), "ball").join(classes.select(F.col("c").alias("ball"), "g", "v", "norm"), "ball"), "ball-sums")

    # Balls are listed under the cells of all their members, and look into those that any of them probes.
    told = member.select("c", "ball").join(balls.select("ball", "n", "r", F.col("signs").alias("centre")), "ball").join(classes.select("c", "g", "v"), "c").drop("c")
    schema = "ball long, n long, r double, centre long, g long, signs long, own array<long>, seen array<long>"
    probed = stored(told.select("ball", "n", "r", "centre", "g", "v").mapInArrow(_placed(tables, probes, scale, seed), schema), "probes")

    def listed(which: str, end: str) -> DataFrame:
        each = probed.select("ball", "n", "r", "centre", "g", F.explode(which).alias("cell")).select("ball", "n", "r", "centre", F.xxhash64("g", "cell").alias("cell"))
        once = each.filter("n = 1").unionByName(each.filter("n > 1").distinct())
        return once.select("cell", *[F.col(c).alias(f"{c}_{end}") for c in ("ball", "r", "centre")])

    meets = (F.col("ball_a") != F.col("ball_b")) & _alike("centre_a", "centre_b", widest + F.col("r_a") + F.col("r_b"))
    met = listed("seen", "a").join(listed("own", "b"), "cell").filter(meets).select(F.least("ball_a", "ball_b").alias("x"), F.greatest("ball_a", "ball_b").alias("y")).distinct()
    side = ("ball", "n", "weight", "r", "g", "v", "norm")
    pairs = met.join(_named(balls, "a", *side), F.col("x") == F.col("ball_a")).join(_named(balls, "b", *side), F.col("y") == F.col("ball_b")).filter("g_a = g_b")
    pairs = pairs.withColumns({"cos": _cosine("a", "b"), "angle": _angle("a", "b")})
    alone, radii = (F.col("n_a") == 1) & (F.col("n_b") == 1), F.col("r_a") + F.col("r_b")
    how = F.when(alone, F.when(F.col("cos") >= threshold, "all")).when(F.col("angle") + radii <= widest - MARGIN, "all").when(F.col("angle") - radii <= widest + MARGIN, "some")
    pairs = stored(pairs.withColumn("how", how).filter("how IS NOT NULL").select("ball_a", "ball_b", "n_a", "n_b", "weight_a", "weight_b", "how"), "ball-pairs")
    whole = pairs.filter("how = 'all'")

    # Of the others the members of the larger ball, each against the whole smaller one (f) ...
    swap = F.col("n_a") > F.col("n_b")
    some = pairs.filter("how = 'some'").select(F.when(swap, F.col("ball_b")).otherwise(F.col("ball_a")).alias("f"), F.when(swap, F.col("ball_a")).otherwise(F.col("ball_b")).alias("of"))
    each = some.join(member.select(F.col("c").alias("w"), F.col("ball").alias("of")), "of")
    each = each.join(_named(classes, "w", "c", "held", "v", "norm"), F.col("w") == F.col("c_w")).join(_named(balls, "f", "ball", "n", "weight", "r", "v", "norm"), F.col("f") == F.col("ball_f"))
    each = each.withColumns({"cos": _cosine("w", "f"), "angle": _angle("w", "f")})
    how = F.when(F.col("n_f") == 1, F.when(F.col("cos") >= threshold, "all")).when(F.col("angle") + F.col("r_f") <= widest - MARGIN, "all").when(F.col("angle") - F.col("r_f") <= widest + MARGIN, "some")
    each = stored(each.withColumn("how", how).filter("how IS NOT NULL").select("f", "of", "w", "held_w", "weight_f", "angle", "how"), "member-pairs")
    singly = each.filter("how = 'all'")
    # ... and where that doesn't settle it either, member against member.
    last = each.filter("how = 'some'").select("f", "of", "w", "angle").join(member.select(F.col("c").alias("u"), F.col("ball").alias("f"), "d"), "f").filter(F.abs(F.col("angle") - F.col("d")) <= widest + MARGIN)
    last = last.join(_named(classes, "w", "c", "held", "v", "norm"), F.col("w") == F.col("c_w")).join(_named(classes, "u", "c", "held", "v", "norm"), F.col("u") == F.col("c_u"))
    last = stored(last.filter(_cosine("w", "u") >= threshold).select("f", "of", "w", "u", "held_w", "held_u"), "links")

    more = [(whole, "ball_a", "weight_b"), (whole, "ball_b", "weight_a"), (singly, "f", "held_w")]
    by_ball = _added(more).withColumnRenamed("node", "ball").withColumnRenamed("more", "of_ball")
    own = _added([(singly, "w", "weight_f"), (last, "w", "held_u"), (last, "u", "held_w")]).withColumnRenamed("node", "c").withColumnRenamed("more", "of_own")
    edges = whole.select(F.col("ball_a").alias("a"), F.col("ball_b").alias("b"))
    for df_ in (singly, last):
        edges = edges.unionByName(df_.select(F.col("f").alias("a"), F.col("of").alias("b")).distinct())
    labels = components(edges)

    zero = F.lit(0)
    outcome = classes.select("label", "k1", "k2", "vec", "c").join(member.select("c", "ball"), "c").join(balls.select("ball", "weight"), "ball")
    outcome = outcome.join(by_ball, "ball", "left").join(own, "c", "left").join(labels, F.col("ball") == F.col("node"), "left").withColumn("part", F.coalesce("component", "ball"))
    outcome = outcome.select("label", "k1", "k2", "vec", "part", (F.col("weight") - 1 + F.coalesce("of_ball", zero) + F.coalesce("of_own", zero)).alias("n_links"))
    outcome = stored(outcome, "outcome")
    least = outcome.groupBy("part").agg(F.min("vec").alias("component"))
    found = rows.join(outcome.join(least, "part").drop("vec", "part"), ["label", "k1", "k2"], "left").select("vec_id", F.coalesce("n_links", zero).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    if not rows.filter("vec_id IS NOT NULL").groupBy("vec_id").count().filter("count > 1").isEmpty():
        one = found.groupBy(F.col("vec_id").alias("vec")).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
        found = rows.select("vec_id").join(one, F.col("vec_id").eqNullSafe(F.col("vec"))).select("vec_id", "n_links", "component_id")
    release(classes, placed, member, balls, probed, pairs, each, last, labels)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _added(parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(node, more): the sum of a column for each node, over all parts."""
    found = None
    for df, node, more in parts:
        part = df.select(F.col(node).alias("node"), F.col(more).alias("more"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("node").agg(F.sum("more").alias("more"))
