"""Append-only audit ledger kept as Parquet partitioned by type."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.ordering import numbered

SCHEMA = "id long, timestamp timestamp, type string, source string, payload string, metadata string"
COLUMNS = ("id", "timestamp", "type", "source", "payload", "metadata")
VIEW = "ledger_entries"


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys at every level; NULL becomes an empty object."""
    return F.to_json(F.parse_json(F.coalesce(text, F.lit("{}"))))


def stamped(entries: DataFrame, at: Column) -> DataFrame:
    """Entries with their time; type and source are required."""
    missing = (F.coalesce("type", F.lit("")) == "") | (F.coalesce("source", F.lit("")) == "")
    kind = F.when(missing, F.raise_error(F.lit("type and source are required")).cast("string")).otherwise(F.col("type"))
    optional = {c: F.col(c) if c in entries.columns else F.lit(None).cast("string") for c in ("payload", "metadata")}
    return entries.select(
        at.alias("timestamp"), kind.alias("type"), "source", *[c.alias(name) for name, c in optional.items()]
    )


def with_ids(entries: DataFrame, after: int = 0) -> DataFrame:
    """Dense ids in (timestamp, type, source, payload, metadata) order, in one exchange; equal entries spread over tasks."""
    order = ["timestamp", "type", "source", "payload", "metadata"]
    return numbered(entries, order, "_id").select((F.col("_id") + after).alias("id"), *order)


def canonical(entries: DataFrame) -> DataFrame:
    """Payload and metadata as JSON with sorted keys."""
    return entries.withColumns({c: canonical_json(F.col(c)) for c in ("payload", "metadata")})


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select(*COLUMNS)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a ledger was written at ``path``; only a missing path counts as none, other errors are raised."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def append(entries: DataFrame, path: str, at: Column) -> DataFrame:
    """Append one batch (single writer per table) and return the rows written, ids included."""
    spark = entries.sparkSession
    last = (read(spark, path).agg(F.max("id")).first()[0] or 0) if exists(spark, path) else 0
    # Numbering comes first: it reads its input twice, the JSON work should run once.
    numbered = with_ids(stamped(entries, at), last)
    canonical(numbered).write.mode("append").partitionBy("type").parquet(path)
    return read(spark, path).filter(F.col("id") > last)


def page(rows: DataFrame, limit: int | None, offset: int) -> DataFrame:
    """Rows after ``offset``, at most ``limit`` when one is given."""
    rest = rows.offset(offset) if offset else rows
    return rest if limit is None else rest.limit(limit)


def history(
    ledger: DataFrame, type: str | None = None, source: str | None = None, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """Entries in id order, all of them or one page; a type filter prunes partitions."""
    rows = ledger
    if type:
        rows = rows.filter(F.col("type") == type)
    if source:
        rows = rows.filter(F.col("source") == source)
    return page(rows.orderBy("id"), limit, offset)


def where(ledger: DataFrame, predicate: str, args: list[Any] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A parameterised predicate over the ledger, in id order."""
    sql = f"SELECT * FROM {{ledger}} WHERE {predicate} ORDER BY id"
    named = {"args": args} if args is not None else {}
    return page(ledger.sparkSession.sql(sql, **named, ledger=ledger), limit, offset)


def query(ledger: DataFrame, sql: str, args: list[Any] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Any SELECT over the view ``ledger_entries``: its whole result, or the page asked for."""
    ledger.createOrReplaceTempView(VIEW)
    return page(ledger.sparkSession.sql(sql, args=args), limit, offset)
