"""Versioned tables, chains of renames, CSV records, cut-offs by a guessed key, trees in reading order."""

from __future__ import annotations

import csv
import io
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ordering as O
from riskloom.operators import remediate as R
from riskloom.operators import rollup as G
from riskloom.sources import files, versions


def held(df):
    return sorted((r.path, r.content) for r in df.collect())


def test_any_version_is_read_as_it_was(spark, tmp_path):
    path = f"{tmp_path}/t"
    rng, state, past = random.Random(3), {f"/f{i}": f"text {i}" for i in range(50)}, []
    schema = "path string, content string"
    versions.create(spark.createDataFrame(list(state.items()), schema), path)
    past.append(dict(state))
    for step in range(4):
        changed = {f"/f{rng.randrange(60)}": f"step {step}" for _ in range(8)}
        gone = [p for p in rng.sample(sorted(state), 4) if p not in changed]
        assert versions.commit(spark.createDataFrame(list(changed.items()), schema), path, spark.createDataFrame([(g,) for g in gone], "path string")) == step + 1
        state = {k: v for k, v in (state | changed).items() if k not in gone}
        past.append(dict(state))
    assert versions.latest(spark, path) == 4
    for number, rows in enumerate(past):
        assert held(versions.read(spark, path, number)) == sorted(rows.items())
    assert held(versions.read(spark, path)) == sorted(state.items())
    with pytest.raises(ValueError, match="no version 9"):
        versions.read(spark, path, 9)


def test_a_commit_without_manifest_row_is_not_read(spark, tmp_path):
    """Folders of a commit that stopped before its last step."""
    path, schema = f"{tmp_path}/t", "path string, content string"
    versions.create(spark.createDataFrame([("/a", "1")], schema), path)
    spark.createDataFrame([("/a", "lost")], schema).write.parquet(f"{path}/data-lost")
    assert held(versions.read(spark, path)) == [("/a", "1")]
    # A key that goes and comes back.
    versions.commit(spark.createDataFrame([], schema), path, spark.createDataFrame([("/a",), ("/a",)], "path string"))
    assert held(versions.read(spark, path)) == []
    versions.commit(spark.createDataFrame([("/a", "2")], schema), path)
    assert [held(versions.read(spark, path, k)) for k in range(3)] == [[("/a", "1")], [], [("/a", "2")]]


def test_chains_of_renames_lead_to_their_end(spark):
    rng = random.Random(8)
    names, ord_, moves, start = {f"/f{i}": f"/f{i}" for i in range(12)}, 0, [], [f"/f{i}" for i in range(12)]
    for _ in range(60):
        first = rng.choice(sorted(names))
        now = names[first]
        new = now.removesuffix(".enc") if now.endswith(".enc") else rng.choice([now + ".enc", f"{now}.{rng.randrange(3)}"])
        if new in names.values():
            continue
        moves.append((now, new, ord_))
        names[first], ord_ = new, ord_ + 1
    renames = spark.createDataFrame(moves, "old_path string, new_path string, ord long")
    rows = spark.createDataFrame([(p, "n") for p in [*start, "/other"]], "path string, name string")
    # A name that another file took over later is still one chain of renames of the file that had it at the time.
    got = sorted(r.path for r in R.follow_renames(rows, renames).collect())
    assert got == sorted([*names.values(), "/other"])
    assert R.follow_renames(rows, renames.limit(0)).count() == len(start) + 1


def test_encrypted_and_opened_again_stays_cleaned(spark):
    renames = spark.createDataFrame([("/a", "/a.enc", 1), ("/a.enc", "/a", 2), ("/b", "/b.enc", 3)], "old_path string, new_path string, ord long")
    cleaned = R.follow_renames(spark.createDataFrame([("/a",), ("/b",)], "path string"), renames)
    files_ = R.follow_renames(spark.createDataFrame([("/a", 3), ("/b", 3), ("/c", 3)], "path string, severity int"), renames)
    got = {r.path: (r.severity, r.cleaned) for r in R.apply_cleaned(files_, cleaned).collect()}
    assert got == {"/a": (0, True), "/b.enc": (0, True), "/c": (3, False)}


def test_a_long_chain_takes_few_joins(spark):
    n = 300
    renames = spark.createDataFrame([(f"/{i}", f"/{i + 1}", i) for i in range(n)], "old_path string, new_path string, ord long")
    assert [tuple(r) for r in R.final_paths(renames).collect()] == [("/0", f"/{n}")]


def test_csv_records_equal_other_readers(spark, tmp_path):
    rng = random.Random(6)
    for k in range(25):
        rows = [["".join(rng.choice(['a', ',', '"', "\n", "é", " ", "\x01", "m"]) for _ in range(rng.randrange(1, 7))) for _ in range(3)] for _ in range(rng.randrange(1, 6))]
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
        df = spark.createDataFrame([(out.getvalue() + "\n\n",)], "t string").select(F.transform(files.csv_records(F.col("t")), files.csv_fields).alias("r"))
        assert df.first().r == rows
        if k < 5 and not any("\x01" in f for r in rows for f in r):
            (tmp_path / "x.csv").write_text(out.getvalue(), newline="")
            read = duckdb.sql(f"SELECT * FROM read_csv('{tmp_path}/x.csv', header=false, all_varchar=true, quote='\"', escape='\"', delim=',', auto_detect=false, columns={{'a':'VARCHAR','b':'VARCHAR','c':'VARCHAR'}})")
            assert [list(r) for r in read.fetchall()] == rows
    bounded = files.csv_text(F.lit('h\n"1\n2",x\n3\n4\n'), 2)
    assert spark.range(1).select(bounded.alias("t")).first().t == 'h\n"1\n2",x\n3'
    plain = spark.range(1).select(files.csv_records(F.lit("a\nb")).alias("r"), files.csv_records(F.lit('a "open\nb')).alias("q")).first()
    assert (plain.r, plain.q) == (["a", "b"], ['a "open\nb'])


@pytest.mark.parametrize("k", [1, 7, 500, 2999, 3000, 3001])
def test_cutoff_by_guess_equals_a_sort(spark, k):
    """A small sample, so that the guess is used, falls short or is left out."""
    df = spark.range(3000).select((F.col("id") * 7 % 100).alias("value"), F.format_string("%05d", F.col("id") * 13 % 3000).alias("path")).repartition(5)
    want = df.orderBy(F.desc("value"), "path").collect()
    for sampled in (50, 400, 2000):
        got = O.cutoff(df, [("value", True), ("path", False)], k, parts=6, sorted_rows=10, sampled_rows=sampled).collect()
        assert [tuple(r.cut) for r in got] == ([tuple(want[k - 1])] if k <= 3000 else [])


def test_only_rows_near_the_cut_are_shuffled(spark, monkeypatch):
    moved = []
    real = O.materialize
    monkeypatch.setattr(O, "materialize", lambda df: moved.append(out := real(df)) or out)
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("value"))
    (row,) = O.cutoff(df, [("value", False)], 200, sorted_rows=10, sampled_rows=5000).collect()
    assert row.cut.value == sorted(i * 7919 % 100_003 for i in range(100_000))[199]
    assert moved[0].count() < 3000


def test_tree_in_reading_order(spark):
    paths = ["/r/b/x.txt", "/r/a.txt", "/r/b/c/y.txt", "/r/b-1/z.txt", "/r/b/c.txt", "/r/z.txt", "/r/b/c/a.txt"]
    rows = spark.createDataFrame([(p, p.rsplit("/", 1)[1], 1, 0) for p in paths], "path string, name string, value long, severity int")
    got = {r.path: r for r in G.ordered_tree(rows).collect()}
    assert sorted(got, key=lambda p: got[p].enter) == ["", "b", "b/c", "b/c/a.txt", "b/c/y.txt", "b/c.txt", "b/x.txt", "b-1", "b-1/z.txt", "a.txt", "z.txt"]
    for p, r in got.items():
        inside = {q for q in got if r.enter < got[q].enter <= r.leave}
        assert inside == ({q for q in got if q != p and (p == "" or q.startswith(p + "/"))} if r.is_dir else set())
