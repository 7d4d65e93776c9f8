"""Streaming scan: files or documents arrive, events, detections and ledger entries leave."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.inventory import STATS, dispatch, stat_flags, visit, within_budget
from riskloom.operators.ordering import running_totals
from riskloom.session import scratch_dir
from riskloom.sources.sinks import materialize


def stream_table(spark: SparkSession, path: str, schema: str, glob: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def stream_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table as a stream, be its path one file or a folder of files."""
    # A stream's plain path must be a folder; a pattern that only this path fits may name either.
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def stream_tree(spark: SparkSession, root: str, per_trigger: int | None = None) -> DataFrame:
    """Files below a root as a stream of ``path, size, modified, content``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(root).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        "content",
    )


def new_paths(stream: DataFrame, within: str | None = None) -> DataFrame:
    """Each path once; with ``within`` a path is remembered for that long after it arrived.

    The watermark follows the time of arrival, so a file is never late, however old it is.
    """
    if within is None:
        return stream.dropDuplicates(["path"])
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within)
    return arrived.dropDuplicatesWithinWatermark(["path"]).drop("_arrived")


def file_events(visited: DataFrame) -> DataFrame:
    """``file`` for files whose text is read, ``error`` for unreadable ones, ``skip`` for the others."""
    outcome = F.col("outcome")
    return visited.withColumn("event", F.when(outcome == "read", "file").when(outcome == "error", "error").otherwise("skip"))


def scan_events(stream: DataFrame, roots: Sequence[str], **limits: float) -> DataFrame:
    """The stateless part of a streaming scan: prune, dispatch and name the event per file."""
    depth = {k: v for k, v in limits.items() if k == "max_depth"}
    size = {k: v for k, v in limits.items() if k == "max_file_size_mb"}
    return file_events(dispatch(visit(stream, roots, **depth), **size))


def run_available(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    mode: str = "append",
    state: str | None = None,
) -> StreamingQuery:
    """Process everything that is available, one micro-batch after another, then stop.

    ``write`` is called with each micro-batch; state and offsets live under the shared folder.
    """
    spark = df.sparkSession
    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", state or scratch_dir(spark, "state"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return query


def to_parquet(df: DataFrame, path: str, by: Sequence[str] = (), state: str | None = None) -> StreamingQuery:
    """Exactly-once file sink for everything available."""
    spark = df.sparkSession
    writer = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", state or scratch_dir(spark, "state"))
        .trigger(availableNow=True)
    )
    query = (writer.partitionBy(*by) if by else writer).start(path)
    query.awaitTermination()
    return query


def to_json_lines(df: DataFrame, path: str, state: str | None = None) -> StreamingQuery:
    """Event lines for everything available."""
    query = (
        df.writeStream.format("json")
        .option("checkpointLocation", state or scratch_dir(df.sparkSession, "state"))
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query


def counters(events: DataFrame, *keys: str) -> DataFrame:
    """Running counts per event kind; use output mode ``complete`` or ``update``."""
    return events.groupBy(*(keys or ("event",))).count()


def scan_log(
    stream: DataFrame,
    roots: Sequence[str],
    path: str,
    max_files: int | None = None,
    content: Column | None = None,
) -> str:
    """Write ``start``, the file events, ``limit_reached`` when the budget ends, then ``complete``.

    The budget is kept across micro-batches by counting what is already written; a batch that would
    exceed it is cut at the budget by path.
    """
    spark = stream.sparkSession
    schema = "seq int, event string, path string, kind string, outcome string, root_ord int"

    def log(seq: int, event: str) -> None:
        spark.createDataFrame([(seq, event, None, None, None, None)], schema).write.mode("append").json(path)

    log(0, "start")
    events = scan_events(stream, roots)
    shown = events.select(
        F.lit(1).alias("seq"), "event", "path", "kind", "outcome", "root_ord"
    )
    reached, written = [], {}

    def earlier(batch_id: int) -> int:
        """Rows of earlier batches: counted from the log after a restart, then kept up to date."""
        if not written:
            logged = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
            own = F.contains(F.input_file_name(), F.lit(f"/batch_id={batch_id}/"))
            written[-1] = logged.filter((F.col("seq") == 1) & ~own).count()
        return sum(n for b, n in written.items() if b != batch_id)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if max_files is not None:
            left = max(max_files - earlier(batch_id), 0)
            size = batch.count()
            if size > left:
                reached.append(batch_id)
                rows = within_budget(batch, left)
            written[batch_id] = min(size, left)
        # A replayed batch overwrites its own folder, so a restart neither loses nor repeats rows.
        rows.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")

    run_available(shown, write)
    if reached:
        log(2, "limit_reached")
    log(3, "complete")
    return path


def read_log(spark: SparkSession, path: str) -> DataFrame:
    schema = "seq int, event string, path string, kind string, outcome string, root_ord int"
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


COUNTERS = ("total_files", *STATS, "permission_errors")
_LOGGED = "seq int, event string, path string, kind string, outcome string, root_ord int, " + ", ".join(f"{c} long" for c in COUNTERS)
_TOTALS = "root_ord int, reached boolean, " + ", ".join(f"{c} long" for c in COUNTERS)


def counted_log(stream: DataFrame, roots: Sequence[str], path: str, max_files: int | None = None, state: str | None = None, **limits: float) -> str:
    """A scan's events with the counters of their root so far: ``start`` of each root, the files, ``limit_reached`` once, ``complete`` of each root.

    What a micro-batch adds up to is written beside its events, one row a root; together these rows are the state that the next
    batch starts from. A replayed batch overwrites both, so neither a restart nor a lost executor counts twice. Inside a batch the
    counters are running totals over range partitions, and the budget, shared by all roots, is a cut-off key: no task sees a
    whole root. Rows are in order of batch, root and path.
    """
    spark = stream.sparkSession
    zero = [F.lit(0).cast("long").alias(c) for c in COUNTERS]
    blank = [F.lit(None).cast("string").alias(c) for c in ("path", "kind", "outcome")]
    every = spark.range(len(roots)).select(F.col("id").cast("int").alias("root_ord"), *zero)

    def log(folder: str, seq: int, event: str, rows: DataFrame) -> None:
        shown = rows.select(F.lit(seq).alias("seq"), F.lit(event).alias("event"), *blank, "root_ord", *COUNTERS)
        shown.write.mode("overwrite").json(f"{path}/events/{folder}")

    def totals(before: int | None = None) -> DataFrame:
        """Rows of earlier batches; the folder's name is the batch."""
        read = spark.read.schema(_TOTALS).option("recursiveFileLookup", True).json(f"{path}/totals")
        batch = F.regexp_extract(F.input_file_name(), "/batch-([0-9]+)/", 1).cast("long")
        return read if before is None else read.filter(batch < before)

    every.withColumn("reached", F.lit(False)).write.mode("overwrite").json(f"{path}/totals/batch-0")
    log("start", 0, "start", every)
    flags = stat_flags() | {"permission_errors": F.col("outcome") == "error"}

    def write(batch: DataFrame, batch_id: int) -> None:
        number = batch_id + 1
        earlier = totals(number).groupBy("root_ord").agg(*[F.sum(c).alias(f"_e_{c}") for c in COUNTERS])
        rows, reached = materialize(batch), False
        if max_files is not None:
            left = max(max_files - earlier.agg(F.sum("_e_total_files")).first()[0], 0)
            reached = rows.count() > left
            rows = within_budget(rows, left) if reached else rows
        # One row a root, here and above: what the roots before it add in this batch goes off its running totals again.
        mine = every.select("root_ord").join(rows.groupBy("root_ord").agg(*[F.count_if(F.coalesce(f.cast("boolean"), F.lit(False))).alias(c) for c, f in flags.items()]), "root_ord", "left")
        mine = materialize(mine.fillna(0))
        others = Window.orderBy("root_ord").rowsBetween(Window.unboundedPreceding, -1)
        shift = mine.join(earlier, "root_ord").select("root_ord", *[(F.col(f"_e_{c}") - F.coalesce(F.sum(c).over(others), F.lit(0))).alias(f"_s_{c}") for c in COUNTERS])
        along = running_totals(rows, ["root_ord", "path"], flags).join(F.broadcast(shift), "root_ord")
        shown = along.select(F.lit(1).alias("seq"), "event", "path", "kind", "outcome", "root_ord", *[(F.col(c) + F.col(f"_s_{c}")).alias(c) for c in COUNTERS])
        shown.write.mode("overwrite").json(f"{path}/events/batch-{number}")
        mine.withColumn("reached", F.lit(reached)).write.mode("overwrite").json(f"{path}/totals/batch-{number}")

    columns = ["event", "path", "kind", "outcome", "root_ord"]
    run_available(scan_events(stream, roots, **limits).select(*columns), write, state=state)
    final = totals().groupBy("root_ord").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("reached").alias("reached"))
    if final.agg(F.max("reached")).first()[0]:
        whole = final.agg(*[F.sum(c).alias(c) for c in COUNTERS])
        log("limit", 2, "limit_reached", whole.withColumn("root_ord", F.lit(None).cast("int")))
    log("complete", 3, "complete", final)
    return path


def read_counted_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_LOGGED).option("recursiveFileLookup", True).json(f"{path}/events")
