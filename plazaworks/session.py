"""The package on the executors, and the folder they share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """The session, whose Python tasks can import this package from now on, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession, tag: str) -> str:
    """The address of a new folder below spark.checkpoint.dir, which driver and executors share; a local session without it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="tables-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
