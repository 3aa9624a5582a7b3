"""What the corpus operators share: the cluster's shared folder and column names that can't clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: White space as the operators know it, for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder's address below the folder that the driver and all executors share.

    That folder is the session's spark.checkpoint.dir. A local session without
    it gets a temporary folder; on a cluster that is an error, as executors
    don't share theirs.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, written to the shared folder and read again.

    Later steps neither repeat the work nor depend on any executor's disk.
    """
    where = shared_dir(df.sparkSession, tag)
    df.write.parquet(where)
    return kept_at(df.sparkSession.read.schema(df.schema).parquet(where), where)


def kept_at(df: DataFrame, where: str) -> DataFrame:
    """df, of which release() knows the folder."""
    df._stored_at = where
    return df


def release(*stored_ones: DataFrame) -> None:
    """Deletes what stored() has written for these, which nothing may read any more: neither a result nor a later step."""
    for df in stored_ones:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from the given ones that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def filesystem(uri: str):
    """(file system, path) of an address in the shared folder, for byte-range reads and plain files within tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
