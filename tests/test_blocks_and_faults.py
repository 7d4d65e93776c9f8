"""Blocks of bounded size, faults of chat exports, files without paths, and sealed contents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import audit_view as V
from riskloom.operators import inventory as I
from riskloom.operators import remediate as R
from riskloom.sources import chats, tables


def blocks_of(df, **bounds):
    got = tables.table_blocks(df, "t", ["k"], **bounds).orderBy("first_row").collect()
    head = "\n--- t ---\n["
    assert all(b.content.startswith(head) and b.content.endswith("]") for b in got)
    return got, [b.content[len(head) : -1] for b in got]


@pytest.mark.parametrize("parts", [1, 7])
def test_blocks_stay_below_their_bounds_and_hold_all_rows(spark, parts):
    """A third of the keys is one value, a third is null, the rest is sparse; texts are up to twice as long as a block."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 5, rng.randrange(1 << 60)]), rng.choice("aé🙂") * int(rng.paretovariate(1) % 400)) for _ in range(1500)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(5)
    got, bodies = blocks_of(df, rows=20, size=300, parts=parts)
    lines = [f"({'NULL' if k is None else k}, {v})" for k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, f"{r[1]})".encode()))]
    assert ", ".join(bodies) == ", ".join(lines)
    assert [b.first_row for b in got] == [1 + sum(x.row_count for x in got[:i]) for i in range(len(got))]
    for b, body in zip(got, bodies, strict=True):
        assert b.row_count <= 20 and b.size == len(body.encode()) + 2
        assert b.size <= 300 or b.row_count == 1
    # At most two blocks a cell, and one more for every 20 rows.
    assert len(got) <= 2 * sum(len(x.encode()) + 2 for x in lines) / 300 + len(rows) / 20 + 2


def test_an_empty_table_has_no_block(spark):
    assert tables.table_blocks(spark.createDataFrame([], "k int, v string"), "t", ["k"]).count() == 0


@pytest.mark.parametrize(
    ("content", "count", "fault"),
    [
        ('{"messages": [{"from": "a", "text": "x"}]}', 1, None),
        ('[{"from": "a", "text": "x"}, 7]', 1, None),
        ('{"other": 1}', 0, None),
        ('{"messages": "text"}', 0, None),
        ('"text"', 0, None),
        ('{"messages": null}', None, "no list of messages"),
        ('{"messages": {"a": 1}}', None, "no list of messages"),
        ("17", None, "no list of messages"),
        ("null", None, "no list of messages"),
        ('{"messages": [', None, "not JSON"),
        ("", None, "not JSON"),
        (None, None, "not JSON"),
    ],
)
def test_faults_of_json_exports(spark, content, count, fault):
    df = spark.createDataFrame([("/c/result.json", content)], "path string, content string")
    row = chats.parse_chat_files(df).first()
    assert (row.chat_platform, row.chat_message_count, row.chat_parse_error) == ("telegram", count, fault)


def test_text_exports_have_no_fault(spark):
    df = spark.createDataFrame([("/c/whatsapp.txt", "no message")], "path string, content string")
    row = chats.parse_chat_files(df).first()
    assert (row.chat_platform, row.chat_message_count, row.chat_parse_error) == ("whatsapp", 0, None)


def test_rows_without_paths_stay_apart(spark):
    df = spark.createDataFrame([(None, "same"), ("", "same"), (None, "same"), ("/a.txt", "same")], "path string, content string").repartition(3)
    rows = V.normalize_files(df).collect()
    assert len({r.path for r in rows}) == len({r.id for r in rows}) == 4
    assert sum(r.path.startswith("unknown-") for r in rows) == 3


def test_given_metadata_comes_first(spark):
    df = spark.createDataFrame(
        [("/a", 3, "s", {"size": "9", "x": None}), ("/b", None, "s", None), ("/c", 1, None, {})], "path string, size long, source string, metadata map<string,string>"
    )
    rows = {r.path: r.metadata for r in V.normalize_files(df, metadata=True).collect()}
    assert rows == {"/a": {"source": "s", "size": "9", "x": None}, "/b": {"source": "s"}, "/c": {"size": "1"}}
    bare = V.normalize_files(df.select("path"), metadata=True)
    assert {tuple(r.metadata) for r in bare.collect()} == {()}
    assert "metadata" not in V.normalize_files(df).columns


def test_fractions_of_a_second(spark):
    df = spark.createDataFrame([("/a", 1, "2024-01-01 00:00:00.250001"), ("/b", 1, "2024-01-01 00:00:01"), ("/c", 1, None)], "path string, size long, m string")
    rows = {r.path: (r.modified_unix, r.modified_iso) for r in I.with_metadata(df.withColumn("modified", F.col("m").cast("timestamp")), F.current_timestamp()).collect()}
    assert rows == {"/a": (1704067200.250001, "2024-01-01T00:00:00.250001+00:00"), "/b": (1704067201.0, "2024-01-01T00:00:01+00:00"), "/c": (None, None)}


def test_contents_are_opened_once(spark):
    key = F.lit("0123456789abcdef").cast("binary")
    plain = spark.createDataFrame([("/a.txt", "text"), ("/b.txt", ""), (None, "x")], "path string, content string")
    sealed = R.encrypt(plain, key).unionByName(plain.withColumn("original", F.lit(None))).withColumn("reason", F.lit("clash"))
    done = R.opened(sealed, key)
    got = sorted((r.path or "", r.content, r.reason or "") for r in done.collect() if r.content in ("text", "", "x"))
    assert got == [("", "x", "not an encrypted file"), ("/a.txt", "text", ""), ("/a.txt", "text", "not an encrypted file"), ("/b.txt", "", ""), ("/b.txt", "", "not an encrypted file")]
    assert done._jdf.queryExecution().executedPlan().toString().lower().count("aes") <= 2
