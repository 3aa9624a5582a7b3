"""Joins of places that lie near each other: by cells, so that each row meets those of its own and the neighbouring cells only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaworks.functions import geo

#: Rows of one cell up to which they meet in one task; fuller cells are dealt into parts.
HOT_ROWS = 100_000
#: Pairs that a part of a cell makes at most, and a task in the mean where there are many.
MOST_PAIRS = 10_000_000
#: Tasks' worth of pairs up to which Spark divides the join as it sees fit.
FEW_TASKS = 4
#: The columns that tell blocks of rows apart, which meet in one task, and the tasks that blocks have at most.
BLOCK = ["band", "cell", "part", "slice"]
MOST_TASKS = 8192
#: Coordinates that differ by no more than this, in degrees, are of one place.
SAME_PLACE = 0.002


def cell_join(probes: DataFrame, rows: DataFrame, key: list[str], part_by: Column, hot: int = HOT_ROWS, most: int = MOST_PAIRS, more: DataFrame | None = None, more_by: str | None = None) -> DataFrame:
    """probes with the rows of the same key.

    A key with more than hot rows, or more than most pairs, is dealt into
    parts: rows by part_by, probes by all their columns, most often the side
    that has more; the other side meets each part. Cells have few bytes and
    many pairs, so a job of its own counts the pairs first, and the join gets
    as many tasks as they fill, whatever its size. That job doesn't read more,
    whose columns rows get by more_by.
    """
    n, m = F.col("_rows"), F.col("_probes")
    counts = rows.groupBy(*key).agg(F.count("*").alias("_rows")).join(probes.groupBy(*key).agg(F.count("*").alias("_probes")), key)
    need = F.ceil(m.cast("double") * n / most)
    by_row = F.greatest(F.ceil(n / hot), F.when(n > m, need).otherwise(1)).cast("int")
    dealt = counts.select(*key, by_row.alias("_by_row"), F.greatest(F.ceil(need / by_row), F.lit(1)).cast("int").alias("_by_probe"))
    full = dealt.filter((F.col("_by_row") > 1) | (F.col("_by_probe") > 1))
    tasks = math.ceil((counts.agg(F.sum(m.cast("double") * n)).first()[0] or 0) / most)
    by_row, by_probe = F.coalesce("_by_row", F.lit(1)), F.coalesce("_by_probe", F.lit(1))
    part = lambda by, parts: F.pmod(F.xxhash64(*by), parts).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    whole = rows if more is None else rows.join(more, more_by, "left")
    some = whole.join(full, key, "left").withColumn("_row_part", part([part_by], by_row)).withColumn("_probe_part", each(by_probe)).drop("_by_row", "_by_probe")
    met = probes.join(full, key, "left").withColumn("_probe_part", part(probes.columns, by_probe)).withColumn("_row_part", each(by_row)).drop("_by_row", "_by_probe")
    on = [*key, "_row_part", "_probe_part"]
    if tasks > FEW_TASKS:
        some, met = (df.repartition(tasks, *on) for df in (some, met))
    return met.join(some, on).drop("_row_part", "_probe_part")


def _in_band(band: Column, lon: Column, reach: float, steps: tuple[int, ...] = (0,)) -> Column:
    """Structs (band, cell) of a band of latitudes: its cells are as wide as what lies within reach of any place in it spans; near a pole one cell."""
    south = F.abs(band * F.lit(reach) - 90)
    north = F.abs((band + 1) * F.lit(reach) - 90)
    widest = F.greatest(south, north) + reach
    cells = F.when(widest < 89, F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(widest)) / reach))).otherwise(F.lit(1)).cast("long")
    at = F.floor((lon + 180) / 360 * cells)
    return F.array_distinct(F.array(*[F.struct(band.cast("long").alias("band"), F.pmod(at + k, cells).alias("cell")) for k in steps]))


def _band(lat: Column, reach: float) -> Column:
    return F.floor((lat + 90) / F.lit(reach))


def circle_cell(lat: Column, lon: Column, radius_m: float) -> Column:
    """The cell (band, cell) of a place, for circles of that radius."""
    reach = radius_m / geo.DEGREE_M
    return F.get(_in_band(_band(lat, reach), lon, reach), F.lit(0))


def circle_cells(lat: Column, lon: Column, radius_m: float) -> Column:
    """The cells, each once, in which all places within the radius lie: the own one and its neighbours, across the antimeridian and around a pole too."""
    reach = radius_m / geo.DEGREE_M
    # No lambda, so that it stays within generated code.
    return F.flatten(F.array(*[_in_band(_band(lat, reach) + k, lon, reach, (-1, 0, 1)) for k in (-1, 0, 1)]))


def within(centres: DataFrame, places: DataFrame, radius_m: float, place_id: str, hot: int = HOT_ROWS, most: int = MOST_PAIRS, more: DataFrame | None = None) -> DataFrame:
    """Each of centres with each of places within the radius (its edge included), and distance_m.

    Both have lat and lon; other columns must have different names. Coordinates
    that are null or not finite are near nothing. more (place_id and other
    columns) is joined to places, which get a row for each of its rows.
    """
    sound = lambda df: df.filter(geo.finite(F.col("lat"), F.col("lon")))
    probes = sound(centres).withColumn("_cell", F.explode(circle_cells(F.col("lat"), F.col("lon"), radius_m)))
    probes = probes.withColumnsRenamed({"lat": "_lat", "lon": "_lon"}).select("*", "_cell.band", "_cell.cell").drop("_cell")
    keyed = sound(places).withColumn("_at", circle_cell(F.col("lat"), F.col("lon"), radius_m)).select("*", "_at.band", "_at.cell").drop("_at")
    met = cell_join(probes, keyed, ["band", "cell"], F.col(place_id), hot, most, more, place_id).drop("band", "cell")
    met = met.withColumn("distance_m", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    return met.filter(F.col("distance_m") <= radius_m).drop("_lat", "_lon")


def blocks(centres: DataFrame, places: DataFrame, radius_m: float, centre_id: str, place_id: str, most: int, pairs: float) -> tuple[DataFrame, DataFrame, int, bool]:
    """(centres, places, number of blocks, whether each centre is in one only), both with columns BLOCK and once for each block they are in.

    A centre meets in its blocks all places within the radius, and others, each
    in one of them. A block has the centres of a cell, or a part of them so
    that they are hardly more than most; where it would make more than pairs,
    its places are dealt to several. Places are repeated for each block near
    them, of which there are the fewer the larger most is. A job of its own
    counts both by cells.
    """
    sound = lambda df: df.filter(geo.finite(F.col("lat"), F.col("lon")))
    apart = lambda df, cells: df.withColumn("_cell", cells).select(*df.columns, "_cell.band", "_cell.cell")
    around = F.explode(circle_cells(F.col("lat"), F.col("lon"), radius_m))
    own = apart(sound(centres), circle_cell(F.col("lat"), F.col("lon"), radius_m))
    m, n = F.col("_centres"), F.col("_places")
    cells = own.groupBy("band", "cell").agg(F.count("*").alias("_centres"))
    # Many places may be at one spot, whose cells are found once; those of no centre go.
    near = apart(sound(places).groupBy("lat", "lon").agg(F.count("*").alias("_n")), around).join(cells, ["band", "cell"]).persist()
    counts = near.groupBy("band", "cell").agg(F.sum("_n").alias("_places"), F.max("_centres").alias("_centres"))
    slices = F.ceil(F.least(m, F.lit(most)).cast("double") * n / pairs).cast("int")
    dealt = counts.select("band", "cell", F.ceil(m / most).cast("int").alias("_parts"), slices.alias("_slices"))
    number, widest = dealt.agg(F.sum(F.col("_parts").cast("long") * F.col("_slices")), F.max("_slices")).first()
    met = sound(places).join(near.select("lat", "lon", "band", "cell").join(dealt, ["band", "cell"]), ["lat", "lon"])
    one = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("long")
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of).cast("long") - 1))
    own = own.join(dealt, ["band", "cell"]).withColumn("part", one(centre_id, "_parts")).withColumn("slice", each("_slices"))
    met = met.withColumn("part", each("_parts")).withColumn("slice", one(place_id, "_slices"))
    return own.drop("_parts", "_slices"), met.drop("_parts", "_slices"), number or 0, (widest or 0) <= 1


def in_blocks(first: DataFrame, then: DataFrame, number: int, order: list[str]) -> DataFrame:
    """(columns BLOCK, kind, first, then): the rows of both, each as a struct, a block's in one task; first's (kind 0) come before then's (kind 1), which come in an order of their columns."""
    row = lambda df: F.struct(*[c for c in df.columns if c not in BLOCK])
    none = lambda df: F.lit(None).cast(df.select(row(df).alias("row")).schema["row"].dataType)
    both = first.select(*BLOCK, F.lit(0).cast("long").alias("kind"), row(first).alias("first"), none(then).alias("then")).unionByName(then.select(*BLOCK, F.lit(1).cast("long").alias("kind"), none(first).alias("first"), row(then).alias("then")))
    # More tasks than blocks, so that few have two.
    return both.repartition(min(max(1, 2 * number), MOST_TASKS), *BLOCK).sortWithinPartitions(*BLOCK, "kind", *[f"then.{c}" for c in order])


def same_place(proposed: DataFrame, known: DataFrame, known_id: str, tolerance: float = SAME_PLACE, hot: int = HOT_ROWS, most: int = MOST_PAIRS) -> DataFrame:
    """Each of proposed with each of known whose lat and lon both differ by no more than the tolerance; each pair once.

    known's lat and lon are known_lat and known_lon in the result; other
    columns must have different names. Null coordinates are those of no place.
    """
    # A little wider than the tolerance, so that no rounding puts a pair two cells apart.
    size = tolerance * (1 + 1e-6)
    at = lambda c: F.floor(F.col(c) / F.lit(size))
    around = F.array(*[F.struct((at("lat") + i).alias("row"), (at("lon") + j).alias("column")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sound = lambda df: df.filter(geo.finite(F.col("lat"), F.col("lon")))
    probes = sound(proposed).withColumn("_cell", F.explode(around)).select("*", "_cell.row", "_cell.column").drop("_cell")
    keyed = sound(known).withColumns({"row": at("lat"), "column": at("lon")}).withColumnsRenamed({"lat": "known_lat", "lon": "known_lon"})
    met = cell_join(probes, keyed, ["row", "column"], F.col(known_id), hot, most).drop("row", "column")
    return met.filter(geo.same_coordinates(F.col("lat"), F.col("lon"), F.col("known_lat"), F.col("known_lon"), tolerance))
