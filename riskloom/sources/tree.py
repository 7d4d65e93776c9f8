"""Complete listings of directory trees: every name, empty files, and what could not be read as rows of their own.

A tree is listed one level a job: the directories found so far are a table, spread over the cluster, and each task lists its share. The
driver knows the roots only. Directories that no root reaches are not opened. Paths are of a file system that all executors mount.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import paths as P
from riskloom.operators.inventory import visit
from riskloom.sources.sinks import materialize

ENTRY = "path string, entry string, size long, modified timestamp, error string"
#: Bytes of contents after which a batch leaves its task, and rows that it holds at most.
BATCH_BYTES, BATCH_ROWS = 32 << 20, 500
#: Directories a task lists.
DIRECTORIES = 200


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands in each directory; a directory or file that cannot be opened becomes a row with the reason."""
    import os
    from datetime import UTC, datetime

    schema = pa.schema([("path", pa.string()), ("entry", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("error", pa.string())])

    def why(error: OSError) -> str:
        return f"{type(error).__name__}: {error.strerror}"

    def within(directory: str) -> Iterator[tuple]:
        try:
            with os.scandir(directory) as found:
                for e in found:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            yield e.path, "dir", None, None, None
                            continue
                        if e.is_symlink() and e.is_dir():
                            continue  # links to directories are not followed
                        seen = e.stat()
                        yield e.path, "file", seen.st_size, datetime.fromtimestamp(seen.st_mtime, UTC), None if os.access(e.path, os.R_OK) else "PermissionError: Permission denied"
                    except OSError as error:
                        yield e.path, "file", None, None, why(error)
        except OSError as error:
            yield directory, "closed", None, None, why(error)

    for batch in batches:
        for directory in batch.column("path").to_pylist():
            rows = list(within(directory))
            for at in range(0, len(rows), 10_000):
                columns = zip(*rows[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def list_tree(spark: SparkSession, roots: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """``path, entry, size, modified, error`` of each file that the roots reach (``file``), and of directories that cannot be listed (``closed``).

    Names that begin with a dot or an underscore and empty files are there. A link to a directory is neither followed nor listed; a
    file that cannot be looked at has an error.
    """
    clean = sorted({"/" + r.removeprefix("file:").strip("/") for r in roots})
    inside = [r + "/" for r in clean]
    # Roots that lie in another one are met on the way to them.
    frontier = spark.createDataFrame([(r,) for r in clean if not any(r != o and r.startswith(o + "/") for o in clean)], "path string")
    levels: list[DataFrame] = []
    while True:
        parts = 1 if not levels else max(1, min(frontier.count() // DIRECTORIES + 1, 10_000))
        listed = materialize(frontier.repartition(parts, "path").mapInArrow(_listed, ENTRY))
        levels.append(listed.filter("entry <> 'dir'"))
        directories = listed.filter("entry = 'dir'").select("path")
        # A file in it would be visited, or a root lies in it.
        wanted = visit(directories.select(F.concat("path", F.lit("/.")).alias("path")), clean, max_depth).select(F.expr("left(path, length(path) - 2)").alias("path"))
        above = reduce(lambda a, b: a | b, [F.startswith(F.lit(r), F.concat("path", F.lit("/"))) for r in inside])
        frontier = wanted.unionByName(directories.filter(above)).distinct()
        if not frontier.take(1):
            return reduce(DataFrame.unionByName, levels)


def closed_directories(listed: DataFrame, roots: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """``path, error, root_ord`` of directories that could not be listed."""
    probe = listed.filter("entry = 'closed'").withColumn("path", F.concat("path", F.lit("/.")))
    return visit(probe, roots, max_depth).select(F.expr("left(path, length(path) - 2)").alias("path"), "error", "root_ord")


def inventory_of(listed: DataFrame) -> DataFrame:
    """The files of a listing as an inventory; names that a scan skips anyway are never an error."""
    skipped = P.is_skipped(F.col("path"))
    files = listed.filter("entry = 'file'").drop("entry")
    return files.withColumn("error", F.when(~skipped, F.col("error"))).withColumn("size", F.coalesce("size", F.lit(0)))


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the bytes of their files; what cannot be read any more has none."""

    def read(path: str) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return f.read()
        except OSError:
            return None

    for batch in batches:
        at = batch.schema.get_field_index("content")
        names = batch.column(batch.schema.get_field_index("path")).to_pylist()
        begun, held, size = 0, [], 0
        for k, path in enumerate(names):
            held.append(read(path))
            size += len(held[-1] or b"")
            if size >= BATCH_BYTES or len(held) >= BATCH_ROWS or k + 1 == len(names):
                part = batch.slice(begun, len(held))
                yield part.set_column(at, "content", pa.array(held, pa.binary()))
                begun, held, size = k + 1, [], 0


def with_contents(files: DataFrame) -> DataFrame:
    """``files`` with ``content`` read from ``path``, in batches of bounded size."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(_loaded, fields)
