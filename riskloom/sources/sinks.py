"""Sinks: event lines and new table versions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskloom.session import scratch_dir


def write_events(events: DataFrame, path: str) -> None:
    """One JSON object per line."""
    events.write.mode("append").json(path)


def write_version(df: DataFrame, base: str | None = None) -> str:
    """Write a table as a new version and return its path; earlier versions stay untouched."""
    path = scratch_dir(df.sparkSession, "version") if base is None else base
    df.write.mode("errorifexists").parquet(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read, so none of them repeats the work behind it."""
    return df.sparkSession.read.schema(df.schema).parquet(write_version(df))
