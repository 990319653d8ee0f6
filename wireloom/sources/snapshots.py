"""Several tables under one path that change together: staged folders, and a commit file that makes one of them valid.

A commit writes its tables into a folder of its own and then renames one small file to the next number, which fails if
another commit took that number.  Readers resolve the highest number, so a commit that dies on the way changes nothing,
and the tables that it replaces stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit was made since the one that this is based on."""


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits under the path, ascending."""
    place, fs = _place(spark, f"{path}/commits")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(place) if s.getPath().getName().isdigit()) if fs.exists(place) else []


def _folder(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/commits/{version:010d}").first()[0])


def tables(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame] | None:
    """The tables of a commit, the last one by default; None if there is none."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        return None
    said = _folder(spark, path, known[-1] if version is None else version)
    return {name: spark.read.parquet(f"{path}/snapshots/{said['snapshot']}/{name}") for name in said["tables"]}


def commit(spark: SparkSession, made: dict[str, DataFrame], path: str, base: int | None = None) -> int:
    """Write all tables and make them valid at once; returns the commit's number.

    base: the number of the commit that made was derived from (0 for none); any later one is a ``Conflict``.  Without
    base the commit follows whatever is there.
    """
    base = base if base is not None else max(versions(spark, path), default=0)
    snapshot = uuid.uuid4().hex
    for name, df in made.items():
        df.write.parquet(f"{path}/snapshots/{snapshot}/{name}")
    staged, fs = _place(spark, f"{path}/snapshots/{snapshot}/commit")
    out = fs.create(staged, False)
    out.write(json.dumps({"snapshot": snapshot, "tables": sorted(made)}).encode())
    out.close()
    jvm = spark.sparkContext._jvm
    final, _ = _place(spark, f"{path}/commits/{base + 1:010d}")
    fs.mkdirs(final.getParent())
    if max(versions(spark, path), default=0) != base:
        raise Conflict(f"{path} has commits after {base}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # never over a commit of that number
    try:
        context.rename(fs.makeQualified(staged), fs.makeQualified(final), options)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"{path} has a commit {base + 1}") from e
        raise
    return base + 1


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the last commits and their tables, and folders of commits that died; none may be under way."""
    known = versions(spark, path)
    held = {_folder(spark, path, v)["snapshot"] for v in known[-keep:]}
    for v in known[:-keep]:
        place, fs = _place(spark, f"{path}/commits/{v:010d}")
        fs.delete(place, False)
    place, fs = _place(spark, f"{path}/snapshots")
    for status in fs.listStatus(place) if fs.exists(place) else []:
        if status.getPath().getName() not in held:
            fs.delete(status.getPath(), True)
