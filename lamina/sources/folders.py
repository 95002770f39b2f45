"""Small files beside the tables: names in a folder, and a text that appears whole or not at all.

A classic session has Hadoop's file system at hand, which answers in a
millisecond. A session without it (Spark Connect) does the same by Spark's
readers and writers, whose commit also moves a file into place as its last step.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F


def hadoop(spark: SparkSession, folder: str):
    """(path, file system) of a folder, or None without access to them."""
    try:
        context = spark.sparkContext
    except Exception:
        return None
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names right inside a folder, hidden ones left out; none if there is no such folder."""
    found = hadoop(spark, folder)
    if found is None:
        try:
            files = spark.read.schema("value string").text(folder).inputFiles()
        except AnalysisException:
            return []
        last = "/" + folder.rpartition("/")[2] + "/"
        return sorted({unquote(f).rsplit(last, 1)[1].split("/")[0] for f in files})
    path, system = found
    if not system.exists(path):
        return []
    shown = (status.getPath().getName() for status in system.listStatus(path))
    return sorted(name for name in shown if not name.startswith(".") and ("=" in name or not name.startswith("_")))


def put_text(spark: SparkSession, folder: str, text: str) -> str:
    """Add a file to a folder, and return its name where it is known."""
    found = hadoop(spark, folder)
    if found is None:
        spark.range(0, 1, 1, 1).select(F.lit(text).alias("value")).write.mode("append").text(folder)
        return ""
    path, system = found
    kind, name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, f"part-{uuid.uuid4().hex}.txt"
    draft = kind(path, f".{name}")
    out = system.create(draft)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not system.rename(draft, kind(path, name)):
        raise OSError(f"{folder}/{name} could not be put in place")
    return name


def get_text(spark: SparkSession, file: str) -> str:
    return spark.read.text(file, wholetext=True).first().value
