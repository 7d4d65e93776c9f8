"""Complete listings on disk, and entities that come back to the row of their text."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import detect as D
from riskloom.operators import entities as N
from riskloom.plans import audit as A
from riskloom.plans.tagger import word_length_model
from riskloom.sources import tree


@pytest.fixture
def folder(tmp_path):
    for name, text in {
        "a.txt": "mail x", ".env.local": "KEY=1", "_private.txt": "y", "empty.log": "", "b/.hidden": "z", "b/c/d/deep.txt": "w",
        ".secret/in.txt": "v", ".secret/root2/note.txt": "u", "b/pic.png": "p", "odd name é.csv": "1,2",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path, tmp_path / "b" / "loop")
    os.symlink(tmp_path / "gone", tmp_path / "b" / "lost.txt")
    os.symlink(tmp_path / "gone", tmp_path / "b" / "lost.png")
    os.symlink(tmp_path / "a.txt", tmp_path / "b" / "link.txt")
    return str(tmp_path)


def names(df, root):
    return sorted(r.path.removeprefix(root + "/") for r in df.collect())


def test_listing_meets_every_name_and_follows_no_link_to_a_directory(spark, folder):
    scan = A.scan(spark, [folder], F.current_timestamp(), complete=True)
    assert names(scan.visited, folder) == [".env.local", "_private.txt", "a.txt", "b/.hidden", "b/c/d/deep.txt", "b/link.txt", "b/lost.png", "b/lost.txt", "b/pic.png", "empty.log", "odd name é.csv"]
    assert [(r.path, r.error.split(":")[0]) for r in scan.errors.collect()] == [(f"{folder}/b/lost.txt", "FileNotFoundError")]
    assert names(scan.files, folder) == [".env.local", "_private.txt", "a.txt", "b/c/d/deep.txt", "b/link.txt", "odd name é.csv"]
    total = scan.stats.filter("root_ord IS NULL").first()
    assert (total.total_files, total.permission_errors) == (11, 1)


def test_depth_and_roots_inside_hidden_directories(spark, folder):
    scan = A.scan(spark, [folder, f"{folder}/.secret/root2/", f"{folder}/nowhere"], F.current_timestamp(), max_depth=1, complete=True)
    found = names(scan.visited, folder)
    assert ".secret/root2/note.txt" in found and ".secret/in.txt" not in found and "b/c/d/deep.txt" not in found


def test_a_missing_root_is_an_error(spark, folder):
    scan = A.scan(spark, [f"{folder}/nowhere"], F.current_timestamp(), complete=True)
    assert [r.path for r in scan.errors.collect()] == [f"{folder}/nowhere"] and scan.visited.count() == 0
    assert scan.stats.filter("root_ord = 0").first().permission_errors == 1


def test_files_that_vanish_after_the_listing_end_nothing(spark, folder):
    scan = A.scan(spark, [folder], F.current_timestamp(), complete=True)
    os.remove(f"{folder}/a.txt")
    assert "a.txt" not in names(scan.files, folder)


def test_budget_and_size_with_a_complete_listing(spark, folder):
    scan = A.scan(spark, [folder], F.current_timestamp(), max_files=3, complete=True)
    assert names(scan.visited, folder) == [".env.local", "_private.txt", "a.txt"]
    assert A.scan(spark, [folder], F.current_timestamp(), max_file_size_mb=3 / 1024 / 1024, complete=True).visited.filter("outcome = 'large'").count() == 3


def test_contents_leave_in_bounded_batches(spark, folder, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tree, "BATCH_ROWS", 2)
    batch = pa.RecordBatch.from_pydict({"path": [f"{folder}/a.txt", f"{folder}/none", f"{folder}/_private.txt"], "content": pa.array([None] * 3, pa.binary())})
    assert [b.column("content").to_pylist() for b in tree._loaded(iter([batch]))] == [[b"mail x", None], [b"y"]]


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("x" * rng.randrange(1, 12) + rng.choice(["", ".", "é", "\n", "  "]) for _ in range(n))


def test_entities_in_the_row_equal_those_of_chunks(spark):
    """One row a chunk, logits and all, against the same text tagged inside its row."""
    rows = [(1, words(1, 4000)), (2, ""), (3, None), (4, " \n "), (5, words(2, 30)), (6, "y" * 5000), (7, words(3, 900))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by_chunk = N.decode(N.label_tokens(N.predict(N.chunks(df, "doc_id"), word_length_model)), "doc_id")
    want = D.explode_detections(by_chunk, "doc_id")
    got = D.explode_detections(N.tag(df, "text", word_length_model), "doc_id", column="entities")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert N.tag(df.limit(0), "text", word_length_model).count() == 0


def test_rules_come_before_the_model_on_one_span(spark):
    def model():
        import numpy as np

        # One token over the whole text, sure of a name.
        return lambda texts: [(np.array([0]), np.array([len(t)]), np.array([[0, 50, 0, 0, 0, 0, 0, 0, 0]])) for t in texts]

    df = spark.createDataFrame([(1, "mail a@b.co")], "doc_id long, content string")
    (row,) = A.classified(df, model=model).collect()
    assert [(d.pii_type, d.method, d.start, d.stop) for d in row.detections] == [("Name", "ner", 0, 11), ("Email", "regex", 5, 11)]
    again = row.detections + row.detections
    twice = spark.createDataFrame([(1, again)], f"doc_id long, detections {D.DETECTIONS}")
    assert len(D.dedupe(twice).first().detections) == 2


def test_entities_leave_python_in_bounded_parts(monkeypatch):
    """However large Spark's batch, only few chunks are held at once; texts stay whole and lose nothing."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(N, "MODEL_CHUNKS", 2)
    monkeypatch.setattr(N, "OUTPUT_CHUNKS", 4)
    seen = []

    def model():
        def label(texts):
            seen.append(len(texts))
            return [(np.array([0]), np.array([len(t)]), np.eye(3)[[1]]) for t in texts]

        return label

    texts = [["ab"], [], None, ["c", " \u3000d\x1c"], ["e"] * 9, [], ["f", "gh"], ["", "\u2003 "]]
    run = N._entity_spans(model, ["", "Name", "Name"], [False, True, False], 10)
    parts = [p.to_pylist() for p in run(iter([pa.array(texts, pa.list_(pa.string())), pa.array([], pa.list_(pa.string()))]))]
    assert [len(p) for p in parts] == [4, 1, 3] and max(seen) == 2
    got = [[(e["start"], e["stop"], e["kind"], e["value"]) for e in row] for p in parts for row in p]
    assert got == [[(10 * i, 10 * i + len(t), 0, t.strip()) for i, t in enumerate(row or []) if t.strip()] for row in texts]


def test_entities_without_excerpts_differ_in_nothing_else(spark):
    df = spark.createDataFrame([(1, words(4, 300)), (2, None)], "doc_id long, text string")
    full, bare = (D.explode_detections(N.tag(df, "text", word_length_model, excerpts=e), "doc_id", column="entities") for e in (True, False))
    assert sorted(map(str, full.drop("excerpt").collect())) == sorted(map(str, bare.drop("excerpt").collect()))
    assert bare.filter("excerpt IS NOT NULL").count() == 0 and full.filter("excerpt IS NULL").count() == 0
