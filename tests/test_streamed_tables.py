"""Queries over streams on tables that are one file, a folder of files, or empty."""

from __future__ import annotations

import pytest

from riskloom.plans.queries import QUERIES

STREAMED = ("stream_detections", "stream_scan", "stream_path_dedupe", "stream_counters")


def documents(spark, n):
    rows = [(i, f"text {i} mail a{i}@b.co", "en", f"src{i % 5}", 20) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def found(spark, folder, name):
    return sorted(map(str, QUERIES[name](spark, str(folder)).collect()))


@pytest.mark.parametrize("name", STREAMED)
def test_a_folder_of_files_streams_like_one_file(spark, tmp_path, name):
    documents(spark, 40).repartition(4).write.parquet(f"{tmp_path}/folder/documents.parquet")
    documents(spark, 40).coalesce(1).write.parquet(f"{tmp_path}/written")
    (part,) = (tmp_path / "written").glob("part-*.parquet")
    (tmp_path / "file").mkdir()
    part.rename(tmp_path / "file" / "documents.parquet")
    got = found(spark, tmp_path / "folder", name)
    assert got and got == found(spark, tmp_path / "file", name)


def test_a_folder_of_events_streams_into_the_ledger(spark, tmp_path):
    events = spark.range(20).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' AS ts", "id % 3 AS user_id", "'click' AS event_type", "1D AS value", "'{}' AS props")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert len(found(spark, tmp_path, "stream_ledger")) == 20


def test_no_files_are_no_counts(spark, tmp_path):
    (tmp_path / "documents.parquet").mkdir()
    assert found(spark, tmp_path, "stream_counters") == []
