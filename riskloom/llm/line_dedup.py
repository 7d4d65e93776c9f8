"""Line deduplication that moves hashes, not text.

Long lines become 128-bit keys. They are range-partitioned by key and sorted by key, document (largest first) and position, so that
each task streams over whole keys: the first document of a key keeps its lines, those after it lose theirs if enough documents follow.
Keys that a sample finds in a notable share of all lines are spread over several ranges each; for these few, what a
stream can't know is counted exactly before. Results are run-length bitmaps of kept lines for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, SPACES, UPPER, text_of, written
from riskloom.session import ranges

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Rows of the sample that looks for hot keys, the part of a range from which a key is one, and the pieces that it is dealt into. They
#: decide where a line is looked at, never what becomes of it.
SAMPLED, HOT_PART, PIECES = 200_000, 8, 1024


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc``, ``text_hash``, ``n_lines``, ``key`` (16 bytes) and 0-based position ``at`` of each long line."""
    keys = F.transform(F.split(text_of(text), "\n"), line_key)
    lines = docs.select(F.col(doc).alias("doc"), F.xxhash64(text_of(text)).alias("text_hash"), keys.alias("keys"))
    lines = lines.withColumn("n_lines", F.size("keys"))
    rows = lines.select("doc", "text_hash", "n_lines", F.posexplode_outer("keys").alias("at", "line"))
    rows = rows.filter(F.length("line") >= least_chars)
    return rows.select("doc", "text_hash", "n_lines", F.unhex(F.md5("line")).alias("key"), "at")


def hot_keys(rows: DataFrame, parts: int, sampled: int = SAMPLED) -> DataFrame:
    """``key``, ``hot_docs`` (documents that hold it) and ``hot_first`` (the largest of them) of keys with a notable share of ``rows``.

    At most ``HOT_PART`` keys a range can have that share of a sample. Their documents are counted over all rows.
    """
    total = rows.count()
    share = min(1.0, sampled / max(total, 1))
    sample = rows.sample(share, 7) if share < 1 else rows
    least = total * share / (HOT_PART * parts)
    keys = written(sample.groupBy("key").agg(F.count("*").alias("n")).filter((F.col("n") > least) & (F.col("n") > 1)).select("key"), "hot_keys")
    per_doc = rows.join(F.broadcast(keys), "key", "left_semi").groupBy("key", "doc").agg(F.lit(1).alias("one"))
    return written(per_doc.groupBy("key").agg(F.count("*").alias("hot_docs"), F.max("doc").alias("hot_first")), "hot_docs")


def later_lines(rows: DataFrame, least_docs: int = LEAST_DOCS, sampled: int = SAMPLED) -> DataFrame:
    """The ``doc``, ``text_hash``, ``n_lines`` and ``at`` of ``rows`` (a written table) that repeat a line of a larger document.

    One exchange: the ranges that it makes are also the groups of the windows, so nothing else moves.
    """
    parts = ranges(rows)
    rows = rows.join(F.broadcast(hot_keys(rows, parts, sampled)), "key", "left")
    piece = F.when(F.col("hot_docs").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc", "at"), F.lit(PIECES)) + 1)
    stream = rows.withColumn("piece", piece.cast("int")).repartitionByRange(parts, "key", "piece")
    whole = Window.partitionBy("key", "piece")
    stream = stream.withColumn("place", F.dense_rank().over(whole.orderBy(F.desc("doc"))))
    stream = stream.withColumn("n_docs", F.max("place").over(whole))
    cold = (F.col("place") > 1) & (F.col("n_docs") >= least_docs)
    hot = (F.col("doc") != F.col("hot_first")) & (F.col("hot_docs") >= least_docs)
    return stream.filter(F.when(F.col("hot_docs").isNull(), cold).otherwise(hot)).select("doc", "text_hash", "n_lines", "at")


def keep_bitmaps(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc``, ``text_hash``, ``n_lines`` and ``keep`` of each document that loses lines.

    ``keep`` is the run-length form of the bitmap of kept lines: structs of ``start`` and ``length``, in order.

    A line stays in the largest document that holds it, every time it stands there. Rows without a document id neither count as
    documents nor lose lines. Rows of one id and different texts count as one document and have a row each.
    """
    rows = written(keyed_lines(docs, doc, text, least_chars).filter("doc IS NOT NULL"), "line_keys")
    # A row of documents that stands there twice names its lines twice.
    gone = F.sort_array(F.collect_set("at"))
    per_doc = later_lines(rows, least_docs).groupBy("doc", "text_hash").agg(F.max("n_lines").alias("n_lines"), gone.alias("gone"))
    walls = per_doc.withColumn("walls", F.concat(F.array(F.lit(-1)), "gone", F.array("n_lines")))
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("gone")),
        lambda i: F.struct((F.get("walls", i) + 1).alias("start"), (F.get("walls", i + 1) - F.get("walls", i) - 1).alias("length")),
    )
    return walls.select("doc", "text_hash", "n_lines", F.filter(gaps, lambda r: r["length"] > 0).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``n_lines``, ``n_dropped`` and ``kept_text`` for every row of ``docs``: a null or empty text is one empty line."""
    rows = docs.select(F.col(doc).alias("doc"), text_of(text).alias("_text")).withColumn("text_hash", F.xxhash64("_text"))
    joined = rows.join(bitmaps.select("doc", "text_hash", "keep"), ["doc", "text_hash"], "left")
    joined = joined.select("doc", "keep", "_text", F.split("_text", "\n").alias("_lines"))
    kept = F.flatten(F.transform("keep", lambda r: F.slice("_lines", r["start"] + 1, r["length"])))
    joined = joined.withColumn("_kept", F.when(F.col("keep").isNotNull(), kept))
    return joined.select(
        F.col("doc").alias(doc),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("keep").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n")).alias("kept_text"),
    )
