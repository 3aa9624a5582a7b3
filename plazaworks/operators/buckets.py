"""Tables whose rows are hashed to buckets, so that a batch of changes rewrites only the buckets it touches.

Each bucket is a folder of Parquet files with one row more, its mark: the number
of the last batch that changed it, and how many buckets there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table. At most one row for each is gathered on the driver.
BUCKETS = 64
BUCKET, MARK, OF = "_bucket", "_mark", "_of"

#: The rows of some buckets and a batch's rows for them, to the buckets' new rows.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key]), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: list[int], of: int, number: int, mode: str) -> None:
    """rows with their bucket, and a mark for each of these buckets. A bucket of very many rows is written by several tasks."""
    spark = rows.sparkSession
    rest = [f for f in rows.schema.fields if f.name != BUCKET]
    marks = spark.range(of).filter(F.col("id").isin(buckets)).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest], F.col("id").cast("int").alias(BUCKET), F.lit(number).cast("long").alias(MARK), F.lit(of).alias(OF))
    whole = rows.withColumns({MARK: F.lit(None).cast("long"), OF: F.lit(None).cast("int")}).unionByName(marks).hint("rebalance", BUCKET)
    whole.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create(rows: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> None:
    """A new table at path; the path must not be there. key decides the bucket and must be the same for all changes."""
    taken = {BUCKET, MARK, OF} & {c.lower() for c in rows.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are the table's own")
    _write(rows.withColumn(BUCKET, bucket_of(key, buckets)), path, list(range(buckets)), buckets, 0, "error")


def marks(spark: SparkSession, path: str) -> dict[int, int]:
    """The last batch of each bucket; an error if a bucket is gone, as where a writer died while it moved files into place."""
    rows = spark.read.parquet(path).filter(F.col(MARK).isNotNull()).select(BUCKET, MARK, OF).collect()
    found = {r[BUCKET]: r[MARK] for r in rows}
    missing = sorted(set(range(max((r[OF] for r in rows), default=1))) - found.keys())
    if missing:
        raise ValueError(f"{path} lacks the buckets {missing}")
    return found


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows as they are now."""
    return spark.read.parquet(path).filter(F.col(MARK).isNull()).drop(BUCKET, MARK, OF)


def change(spark: SparkSession, path: str, key: list[str], batch: DataFrame, number: int, merge: Merge) -> list[int]:
    """Changes the table by a batch and gives the buckets that were rewritten; the files of all others stay as they are.

    merge is given the old rows and the batch's rows of the touched buckets, so
    it may be any change by key: mutations.upsert(), insert_ignore(), patch(),
    latest_wins() over both, replace_children() where key is the parent, or an
    anti join with the keys to forget. A bucket left without rows keeps its
    mark.

    Batches have rising numbers. A bucket whose mark is the batch's number or a
    later one is left alone, so a batch that is run again changes nothing, and
    one that came to its end in a part of the buckets only is completed. There
    is one writer at a time; a reader that lists files while they are moved into
    place may miss some, as with any overwrite of Parquet folders. An empty
    batch touches nothing.
    """
    last = marks(spark, path)
    old = spark.read.parquet(path)
    kinds = dict(old.dtypes)
    typed = batch.withColumns({c: F.col(f"`{c}`").cast(kinds[c]) for c in key}).withColumn(BUCKET, bucket_of(key, len(last)))
    touched = sorted(b for (b,) in typed.select(BUCKET).distinct().collect() if last[b] < number)
    if not touched:
        return []
    here = F.col(BUCKET).isin(touched)
    rows = old.filter(here & F.col(MARK).isNull()).drop(BUCKET, MARK, OF)
    merged = merge(rows, typed.filter(here).drop(BUCKET)).select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in rows.columns])
    _write(merged.withColumn(BUCKET, bucket_of(key, len(last))), path, touched, len(last), number, "overwrite")
    return touched
