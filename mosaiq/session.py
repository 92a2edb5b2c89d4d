"""Session set-up that operators with Python functions need."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; call it before a Python function enters a plan."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="mosaiq-ship-")) / "mosaiq.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only in a local session that names none."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.mosaiq.shared", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="mosaiq-")
        spark.conf.set("spark.mosaiq.shared", path)
    return f"{path.rstrip('/')}/mosaiq-{spark.sparkContext.applicationId}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(place) if f.isDirectory()) if system.exists(place) else []


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a table that was written to its end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
