"""Numbers and totals in a global order, and the stream log that builds on them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from riskloom.operators import ledger as L
from riskloom.operators import ordering as O
from riskloom.plans import corpus as C
from riskloom.streaming import scan as T


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning")


def test_running_totals_equal_a_plain_sum(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.choice(["a", None, "b"]), rng.randrange(5), rng.random() > 0.5) for _ in range(800)]
    df = spark.createDataFrame(rows, "k int, s string, a long, b boolean").repartition(7)
    got = O.running_totals(df, ["k", "s", "a", "b"], {"sum_a": F.col("a"), "n_b": F.col("b")}, parts=6).collect()
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2], r[3]))
    want, a, b = [], 0, 0
    for row in order:
        a, b = a + row[2], b + row[3]
        want.append((*row, a, b))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"))
    got = {r.k: r.n for r in O.numbered(df, ["k"], "n", parts=9).collect()}
    assert got == {k: k + 1 for k in range(3000)}
    assert O.numbered(df.limit(0), ["k"], "n").count() == 0


def test_rows_move_once(spark):
    """Reading back adds offsets by a broadcast: no exchange of rows besides the range partitioning that was written."""
    df = spark.range(1000).select(F.col("id").alias("k"))
    for out in (O.numbered(df, ["k"], "n", parts=4), O.running_totals(df, ["k"], {"n": F.lit(1)}, parts=4)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and exchanges(out) == 0


def test_equal_ledger_entries_spread_over_tasks(spark):
    """A million times the same entry: every partition gets its share, ids stay dense."""
    same = spark.range(200_000).select(F.lit("2024-06-01 00:00:00").cast("timestamp").alias("timestamp"), F.lit("scan").alias("type"), F.lit("s").alias("source"), F.lit("{}").alias("payload"), F.lit(None).cast("string").alias("metadata"))
    rows = L.with_ids(same, 5).select("id", F.spark_partition_id().alias("p"))
    counts = rows.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert tuple(counts) == (6, 200_005, 200_000)
    placed = O._placed(same, ["timestamp", "type", "source", "payload", "metadata"], 8).groupBy("_part").count().collect()
    assert len(placed) == 8 and max(r["count"] for r in placed) < 3 * 200_000 / 8


def arrivals(spark, folder, batches):
    for k, paths in enumerate(batches):
        spark.createDataFrame([(p, 1) for p in paths], "path string, size long").withColumn("modified", F.current_timestamp()).coalesce(1).write.parquet(f"{folder}/batch={k}")
    return T.stream_table(spark, folder, "path string, size long, modified timestamp, batch int", per_trigger=1)


def events(spark, path):
    return sorted(((r.seq, r.root_ord if r.root_ord is not None else -1, r.path or "", r.event, r.total_files, r.text_files) for r in T.read_counted_log(spark, path).collect()))


def test_counted_log_goes_on_where_it_stopped(spark, tmp_path):
    """A second run over more files starts from the counters of the first."""
    folder, state, out = f"{tmp_path}/in", f"{tmp_path}/state", f"{tmp_path}/log"
    stream = arrivals(spark, folder, [["/a/1.txt", "/b/1.txt", "/b/2.png"], ["/a/2.txt"]])
    T.counted_log(stream, ["/a", "/b", "/none"], out, state=state)
    first = [
        (0, 0, "", "start", 0, 0), (0, 1, "", "start", 0, 0), (0, 2, "", "start", 0, 0),
        (1, 0, "/a/1.txt", "file", 1, 1), (1, 0, "/a/2.txt", "file", 2, 2), (1, 1, "/b/1.txt", "file", 1, 1), (1, 1, "/b/2.png", "skip", 2, 1),
        (3, 0, "", "complete", 2, 2), (3, 1, "", "complete", 2, 1), (3, 2, "", "complete", 0, 0),
    ]
    assert events(spark, out) == sorted(first)
    spark.createDataFrame([("/a/0.txt", 1)], "path string, size long").withColumn("modified", F.current_timestamp()).coalesce(1).write.parquet(f"{folder}/batch=9")
    T.counted_log(stream, ["/a", "/b", "/none"], out, state=state)
    assert (1, 0, "/a/0.txt", "file", 3, 3) in events(spark, out) and (3, 0, "", "complete", 3, 3) in events(spark, out)


def test_budget_ends_inside_a_batch_once(spark, tmp_path):
    stream = arrivals(spark, f"{tmp_path}/in", [["/a/1.txt"], ["/b/1.txt", "/a/3.txt", "/a/2.txt"], ["/a/4.txt"]])
    log = T.counted_log(stream, ["/a", "/b"], f"{tmp_path}/log", max_files=3)
    found = events(spark, log)
    assert [e[2] for e in found if e[0] == 1] == ["/a/1.txt", "/a/2.txt", "/a/3.txt"]
    assert [e[3:5] for e in found if e[0] == 2] == [("limit_reached", 3)]
    # A budget that is just enough is not a limit.
    stream = arrivals(spark, f"{tmp_path}/in2", [["/a/1.txt"], ["/b/1.txt"]])
    assert not [e for e in events(spark, T.counted_log(stream, ["/a", "/b"], f"{tmp_path}/log2", max_files=2)) if e[0] == 2]


def test_stream_counters_equal_those_of_a_batch(spark, sf_dir, tmp_path):
    """One batch holds all: the last counters of each root are the batch's statistics."""
    from riskloom.operators import inventory as I

    inv = C.inventory(spark, sf_dir).drop("doc_id")
    inv.coalesce(1).write.parquet(f"{tmp_path}/in/batch=0")
    stream = T.stream_table(spark, f"{tmp_path}/in", "path string, size bigint, modified timestamp, batch int")
    log = T.read_counted_log(spark, T.counted_log(stream, C.ROOTS, f"{tmp_path}/log"))
    want = {r.root_ord: r for r in I.scan_stats(I.dispatch(I.visit(inv, C.ROOTS)), C.ROOTS).filter("root_ord IS NOT NULL").collect()}
    for r in log.filter("event = 'complete'").collect():
        assert all(r[c] == want[r.root_ord][c] for c in T.COUNTERS)
