"""Tables in versions: each commit appends only the rows that changed, and any version can be read.

    data-<id>/    rows of one commit
    gone-<id>/    keys that a commit removes
    manifest/     one row a version: its number and the id of its folders

A commit's manifest row is written last, so a version exists whole or not at all; folders that no row names are left over from a
commit that failed and are never read. Commits come from one writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, id string, key string, fields string"


def _entries(spark: SparkSession, path: str) -> list:
    """The manifest: one row a version."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest").orderBy("version").collect()


def _put(df: DataFrame, removed: DataFrame | None, path: str, version: int, key: str) -> int:
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/data-{name}")
    gone = spark.createDataFrame([], f"`{key}` string") if removed is None else removed.select(F.col(key).cast("string").alias(key)).distinct()
    gone.write.parquet(f"{path}/gone-{name}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.createDataFrame([(version, name, key, fields)], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def create(df: DataFrame, path: str, key: str = "path") -> int:
    """Version 0 holds all of ``df``; ``key`` is unique and a string."""
    return _put(df, None, path, 0, key)


def latest(spark: SparkSession, path: str) -> int:
    return _entries(spark, path)[-1].version


def commit(changed: DataFrame, path: str, removed: DataFrame | None = None) -> int:
    """A new version: rows of ``changed`` replace those of their keys or are new, keys of ``removed`` go. Returns its number."""
    spark = changed.sparkSession
    last = _entries(spark, path)[-1]
    columns = spark.createDataFrame([], last.fields).columns
    return _put(changed.select(*columns), removed, path, last.version + 1, last.key)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of ``version`` (default: the latest).

    What a commit wrote counts unless a later one touched its key: an anti join with the keys, not with the rows, of later
    commits, so that a small commit costs little on a large table.
    """
    entries = _entries(spark, path)
    known = [e for e in entries if version is None or e.version <= version]
    if not known or (version is not None and known[-1].version != version):
        raise ValueError(f"no version {version} in {path}")
    parts, later = [], None
    for e in reversed(known):
        rows = spark.read.schema(e.fields).parquet(f"{path}/data-{e.id}")
        parts.append(rows if later is None else rows.join(later, e.key, "left_anti"))
        gone = spark.read.schema(f"`{e.key}` string").parquet(f"{path}/gone-{e.id}")
        touched = rows.select(e.key).unionByName(gone)
        later = touched if later is None else later.unionByName(touched)
    return reduce(DataFrame.unionByName, reversed(parts))
