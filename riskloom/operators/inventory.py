"""File inventory: pruning, multi-root merge, extractor dispatch, metadata, budget and statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import paths as P
from riskloom.operators.ordering import cutoff, running_totals

STATS = ("text_files", "pdfs", "csvs", "dbs", "chats", "skipped_large_files")
STAT_OF_KIND = {"text": "text_files", "pdf": "pdfs", "csv": "csvs", "db": "dbs", "chat": "chats"}


def _reached(path: Column, root: str, max_depth: int | None) -> Column:
    """A root reaches a file unless a directory below the root is hidden or too deep.

    A root that names a store (``s3a://bucket/data``) reaches paths of that store only; one without
    (``/data``, ``hdfs:///data``) is compared with the path inside whatever store the file is in.
    """
    named = re.match(r"[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?/+", root)
    store = named and (named.group(1) or "//")[2:]
    if not store:
        root, path = "/" + root[named.end() :] if named else root, P.without_store(path)
    base = root.rstrip("/") + "/"
    relative = F.substring(path, len(base) + 1, 1 << 30)
    dirs = F.regexp_extract(relative, "^(.*/)?[^/]*$", 1)
    depth = F.char_length(dirs) - F.char_length(F.replace(dirs, F.lit("/"), F.lit("")))
    reached = F.startswith(path, F.lit(base)) & ~dirs.rlike(r"(^|/)\.")
    return reached if max_depth is None else reached & (depth <= max_depth)


def visit(files: DataFrame, roots: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """Keep the files a walk from ``roots`` visits, each under the first root that reaches it.

    A path decides by itself which roots reach it, so overlapping roots need no duplicate removal.
    """
    path = F.col("path")
    root_ord = F.coalesce(*[F.when(_reached(path, r, max_depth), F.lit(i)) for i, r in enumerate(roots)])
    return files.withColumn("root_ord", root_ord).filter("root_ord IS NOT NULL")


def unique_paths(files: DataFrame, keep_first: str = "root_ord") -> DataFrame:
    """One row per normalised path for inventories that list a file twice; narrow columns only."""
    rest = [c for c in files.columns if c not in ("path", "content")]
    return (
        files.select(P.normalized("path").alias("path"), *rest)
        .groupBy("path")
        .agg(F.min_by(F.struct(*rest), F.col(keep_first)).alias("_row"))
        .select("path", "_row.*")
    )


def dispatch(files: DataFrame, max_file_size_mb: float | None = None) -> DataFrame:
    """Add ``outcome`` (error, skipped, large, unsupported or read) and ``kind`` (the extractor).

    An optional ``error`` column tells why a file could not be read. Formats that hold no plain text
    are unsupported as raw bytes; an inventory whose ``content`` is text already has been parsed.
    """
    path = F.col("path")
    failed = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    large = F.lit(False) if max_file_size_mb is None else F.col("size") > int(max_file_size_mb * 1024 * 1024)
    raw = dict(files.dtypes).get("content") == "binary"
    sealed = ((F.col("kind") == "pdf") | (F.col("kind") == "db") | (P.extension(path) == ".xlsx")) & F.lit(raw)
    named = files.withColumns({"_skip": P.is_skipped(path), "kind": P.extract_kind(path)})
    outcome = (
        F.when(failed, "error")
        .when(F.col("_skip"), "skipped")
        .when(large, "large")
        .when(F.col("kind").isNull() | sealed, "unsupported")
        .otherwise("read")
    )
    judged = named.withColumn("outcome", outcome)
    return judged.withColumn("kind", F.when(F.col("outcome").isin("read", "unsupported"), F.col("kind"))).drop("_skip")


def with_metadata(files: DataFrame, as_of: Column) -> DataFrame:
    """Add the file type and the metadata columns of every file."""
    path, modified = F.col("path"), F.col("modified")
    utc = F.to_utc_timestamp(modified, F.current_timezone())
    # Microseconds are shown only where there are any.
    fraction = F.when(F.unix_micros(modified) % 1_000_000 != 0, F.date_format(utc, ".SSSSSS")).otherwise("")
    return files.select(
        "*",
        P.file_type(path).alias("file_type"),
        P.basename(path).alias("filename"),
        P.extension(path).alias("extension"),
        P.dirname(path).alias("directory"),
        (F.unix_micros(modified) / 1_000_000).alias("modified_unix"),
        F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00")).alias("modified_iso"),
        P.age_days(modified, as_of).alias("age_days"),
        P.location_risk(path).alias("location_risk"),
    )


def within_budget(visited: DataFrame, max_files: int) -> DataFrame:
    """The first ``max_files`` visited files by root, then path.

    Only the cut-off key is looked up; wide columns never move. Fewer files than the budget give no
    cut-off and keep everything.
    """
    if max_files <= 0:
        return visited.limit(0)
    keys = ["root_ord", "path"]
    cut = cutoff(visited, [(k, False) for k in keys], max_files).scalar()
    return visited.filter(F.coalesce(F.struct(*keys) <= cut, F.lit(True)))


def _counted(kind: str) -> Column:
    return F.col("kind") == kind


def stat_flags() -> dict[str, Column]:
    """One flag per counter: kinds count before the empty-content check, totals before every check."""
    flags = {"total_files": F.lit(1)}
    flags |= {name: _counted(kind) for kind, name in STAT_OF_KIND.items()}
    return flags | {"skipped_large_files": F.col("outcome") == "large"}


def scan_stats(visited: DataFrame, roots: Sequence[str], closed: DataFrame | None = None) -> DataFrame:
    """The nine counters per root and, with ``root_ord`` NULL, over all roots, in one aggregate.

    Every root has a row, also one without files, and so has the total of an empty scan. Directories that could not be listed
    (``closed``, with ``root_ord``) count as errors but not as files.
    """
    flags = stat_flags() | {"permission_errors": F.col("outcome") == "error"}
    flagged = visited.select("root_ord", *[c.cast("long").alias(n) for n, c in flags.items()])
    if closed is not None:
        shut = closed.select("root_ord", *[F.lit(int(n == "permission_errors")).cast("long").alias(n) for n in flags])
        flagged = flagged.unionByName(shut)
    # One row of nothing per root keeps roots without files in the result.
    none = flagged.sparkSession.range(len(roots)).select(
        F.col("id").cast("int").alias("root_ord"), *[F.lit(0).cast("long").alias(n) for n in flags]
    )
    counts = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in flags]
    return flagged.unionByName(none).rollup("root_ord").agg(*counts).select(
        "root_ord",
        *flags,
        F.when(F.col("root_ord").isNull(), len(roots)).otherwise(1).cast("long").alias("paths_scanned"),
    )


def running_stats(visited: DataFrame) -> DataFrame:
    """The counters as they stand after each file, in (root, path) order."""
    return running_totals(visited, ["root_ord", "path"], stat_flags())
