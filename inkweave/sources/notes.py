"""Reading a folder of Markdown files, listing notes, publishing a new snapshot."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, paths


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """All ``.md`` files below ``root`` whose path has no dot-prefixed part.

    Columns path (relative), name, folder, content, content_hash, mtime.  Spark's own
    listing also leaves out names that start with ``_``.
    """
    files = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.md")
        .load(root)
        .select(
            F.col("value").alias("content"),
            F.col("_metadata.file_path").alias("_uri"),
            F.col("_metadata.file_modification_time").alias("mtime"),
        )
    )
    # The file path is a percent-encoded URI in which a plus sign is literal.
    decoded = F.url_decode(F.replace(F.col("_uri"), F.lit("+"), F.lit("%2B")))
    inside = F.substring_index(decoded, root.split("://")[-1].rstrip("/") + "/", -1)
    return (
        files.withColumn("path", inside)
        .filter(~F.col("path").rlike(r"(^|/)\."))
        .select(
            "path",
            paths.stem(F.col("path")).alias("name"),
            paths.folder(F.col("path")).alias("folder"),
            "content",
            hashing.content_hash(F.col("content")).alias("content_hash"),
            "mtime",
        )
    )


def list_notes(notes: DataFrame, prefix: str = "") -> DataFrame:
    """Paths below ``prefix`` and their URIs, which carry no extension."""
    return notes.filter(F.col("path").startswith(prefix)).select("path", paths.strip_md(F.col("path")).alias("uri"))


MANIFESTS, DATA = "versions", "data"


def _files(spark: SparkSession, location: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(location)
    return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, location: str) -> dict[int, str]:
    """Published versions and the data folder of each; a commit that was not finished is none."""
    jvm, fs = _files(spark, location)
    folder = jvm.org.apache.hadoop.fs.Path(f"{location.rstrip('/')}/{MANIFESTS}")
    out = {}
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        stream = fs.open(status.getPath())
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if text.endswith("\n"):
            out[int(status.getPath().getName())] = text.strip()
    return out


def publish(notes: DataFrame, location: str, version: int | None = None) -> int:
    """Write a whole snapshot and make it a version, the next one unless a number is given.

    The rows go to a folder of their own; one small file then names it as the version.  That file can only
    be created once, so of two writers of one version one fails, and readers never see half a snapshot.
    """
    spark, location = notes.sparkSession, location.rstrip("/")
    name = uuid.uuid4().hex
    notes.write.mode("errorifexists").parquet(f"{location}/{DATA}/{name}")
    if version is None:
        version = max(versions(spark, location), default=0) + 1
    jvm, fs = _files(spark, location)
    target = jvm.org.apache.hadoop.fs.Path(f"{location}/{MANIFESTS}/{version:012d}")
    if fs.exists(target):
        raise FileExistsError(f"version {version} exists")
    stream = fs.create(target, False)  # fails where another writer was first
    stream.write(bytearray(f"{name}\n".encode()))
    stream.close()
    return version


def read_version(spark: SparkSession, location: str, version: int | None = None) -> DataFrame:
    """The notes of a version, the latest one unless a number is given."""
    known = versions(spark, location)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {version if version is not None else ''} in {location}")
    return spark.read.parquet(f"{location.rstrip('/')}/{DATA}/{known[max(known) if version is None else version]}")


def sweep_attempts(spark: SparkSession, location: str, older_than: float = 86_400.0) -> int:
    """Delete the folders of writes that never became a version, once they are ``older_than`` seconds old."""
    jvm, fs = _files(spark, location)
    folder = jvm.org.apache.hadoop.fs.Path(f"{location.rstrip('/')}/{DATA}")
    listed = [(s.getPath(), s.getModificationTime()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
    known = set(versions(spark, location).values())  # read after the listing, so a fresh commit is known
    gone = [p for p, at in listed if p.getName() not in known and time.time() - at / 1000 >= older_than]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
