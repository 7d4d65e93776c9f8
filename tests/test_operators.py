"""Scores, audit view, rollups, remediation, ledger, entities and streams on small fixtures."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from riskloom.operators import audit_view as V
from riskloom.operators import detect as D
from riskloom.operators import entities as N
from riskloom.operators import ledger as L
from riskloom.operators import remediate as R
from riskloom.operators import rollup as G
from riskloom.operators import score as S
from riskloom.operators.ordering import cutoff
from riskloom.streaming import scan as T



def as_of():
    return F.to_timestamp(F.lit("2024-06-01"))


def test_score_golden(spark):
    rows = [
        ("before", ["Aadhaar", "PAN", "CreditCard", "Email", "Phone", "Medical"], "/u/Downloads/demo.txt", "2024-05-01"),
        ("after", ["Email"], "/u/Downloads/demo.txt", "2023-05-01"),
        ("many", ["SSN"] * 9 + ["Passport"], "/u/x", "2024-05-31"),
    ]
    df = spark.createDataFrame(rows, "k string, types array<string>, path string, m string").withColumn("modified", F.to_timestamp("m"))
    listed = df.withColumn("b", S.bonuses(F.col("path"), F.col("modified"), F.lit(False), as_of()))
    got = {
        r.k: r
        for r in S.breakdown(S.score_types(listed, "types", "aggregate(b, 0, (a, x) -> a + x.weight)"), "types").collect()
    }
    assert (got["before"].score, got["before"].severity) == (78, "orange")
    assert (got["after"].score, got["after"].severity) == (12, "green")
    assert [b.reason for b in got["after"].b] == ["sensitive_location", "old_unencrypted_file"]
    assert (got["many"].raw_score, got["many"].score, got["many"].other) == (185, 100, 5)
    # Long rows give the same totals.
    long = df.select("k", F.explode("types").alias("pii_type"))
    totals = {r.k: r for r in S.score_rows(S.weigh(long), "k").collect()}
    assert totals["many"].raw_score == 185 and totals["before"].financial == 18


def test_view_severity_and_category(spark):
    cases = [
        (["password"], 3, "credentials"),
        (["email", "iban"], 3, "financial"),
        (["email", "name", "address"], 2, "identity"),
        (["phone"], 2, "contact"),
        (["email"], 1, "contact"),
        ([], 0, "uncategorized"),
        (["company"], 3, "identity"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t array<string>")
    got = df.select("i", V.view_severity("t").alias("s"), V.view_category("t", "'text'").alias("c")).orderBy("i").collect()
    assert [(r.s, r.c) for r in got] == [(s, c) for _, s, c in cases]
    over = spark.createDataFrame([(-2.0, 0), (0.5, 1), (2.5, 3), (9.0, 3)], "o double, e int").withColumn("t", F.array().cast("array<string>"))
    assert all(r.s == r.e for r in over.select(V.view_severity("t", "o").alias("s"), "e").collect())
    kinds = spark.createDataFrame([("pdf", "identity"), ("spreadsheet", "financial"), ("browser_db", "credentials")], "k string, e string")
    empty = kinds.withColumn("t", F.array().cast("array<string>"))
    assert all(r.c == r.e for r in empty.select(V.view_category("t", "k").alias("c"), "e").collect())


def audit_rows(spark, n=40, group="if(id % 3 = 0, 'other', 'hot')"):
    return spark.range(n).selectExpr(
        "concat('n', id) AS id", "concat('f', id, '.txt') AS name", "concat('/home/u/d', id % 4, '/s', id % 2, '/f', id, '.txt') AS path",
        "(id * 7) % 31 + 1 AS value", "int(id % 4) AS severity", "array('email', concat('t', id % 5)) AS pii", "array('email') AS top_pii",
        "'' AS excerpt", f"{group} AS category", "'text' AS file_type",
    )


def test_top_n_keeps_totals(spark):
    rows = audit_rows(spark)
    for n in (1, 5, 39, 40, 100):
        got = G.top_n_with_others(rows, n)
        assert got.agg(F.sum("value")).first()[0] == rows.agg(F.sum("value")).first()[0]
        assert got.count() == min(n + 1, 40)
    others = G.top_n_with_others(rows, 5).filter("category = 'others'").first()
    assert (others.name, others.path, others.pii) == ("Others (35)", "", [])


def test_group_children_keeps_totals_and_order(spark):
    rows = audit_rows(spark)
    got = G.group_children(rows, "category")
    assert {r.group_name: r.n for r in got.groupBy("group_name").agg(F.count("*").alias("n")).collect()} == {"hot": 12, "other": 12}
    assert got.agg(F.sum("value")).first()[0] == rows.agg(F.sum("value")).first()[0]
    local = sorted((r for r in rows.filter("category = 'hot'").collect()), key=lambda r: (-r.value, r.path))
    others = got.filter("group_name = 'hot' AND file_type = 'aggregate'").first()
    seen = list(dict.fromkeys(t for r in local[11:] for t in r.pii))
    assert others.pii == seen and others.top_pii == seen[:3]
    assert others.severity == max(r.severity for r in local[11:])
    assert others.excerpt == f"Contains {len(local) - 11} smaller files in the hot category."
    exact = G.group_children(audit_rows(spark, 12, "'one'"), "category")
    assert exact.count() == 12 and exact.filter("file_type = 'aggregate'").count() == 0


def test_directories_sum_up(spark):
    rows = audit_rows(spark)
    assert G.common_prefix(rows).first().prefix == "/home/u"
    nodes = {r.path: r for r in G.directory_nodes(rows).collect()}
    total = rows.agg(F.sum("value"), F.count("*")).first()
    assert (nodes[""].value, nodes[""].file_count) == (total[0], total[1])
    for node in nodes.values():
        below = [n for n in nodes.values() if n.parent == node.path]
        if below:
            assert node.file_count == node.local_count + sum(n.file_count for n in below)
    one = G.common_prefix(spark.createDataFrame([("/a/b/x.txt",)], "path string")).first().prefix
    assert one == "/a/b"
    none = G.common_prefix(spark.createDataFrame([("a/b",), ("c/d",)], "path string")).first().prefix
    assert none == ""


def test_search_follows_leaf_and_inner_rules(spark):
    rows = [("/r/a/findme.txt",), ("/r/b/c/findme.txt",), ("/r/b/findme2.txt",), ("/r/findme_dir/x.txt",), ("/r/z/q/x.txt",)]
    files = spark.createDataFrame(rows, "path string").selectExpr(
        "path", "substring_index(path, '/', -1) AS name", "1L AS value", "0 AS severity", "cast(array() AS array<string>) AS pii"
    )
    found = {r.path for r in G.search_directories(files, G.directory_nodes(files), "FINDME").collect()}
    # A folder without sub-folders is judged by its own name, so "a" and "b/c" are gone although a file matches.
    assert found == {"", "b", "findme_dir"}


def test_portfolio_of_nothing_and_everything(spark):
    empty = audit_rows(spark, 0)
    assert G.portfolio_score(empty).select("score", "tone").first() == (0, "calm")
    assert G.portfolio_score(audit_rows(spark).withColumn("severity", F.lit(3))).select("score", "tone").first() == (100, "critical")
    assert G.dashboard_metrics(audit_rows(spark)).first() == (40, 10, 6, 2)
    assert G.root_totals(G.group_totals(audit_rows(spark))).first().group_count == 2


def test_node_paths(spark):
    df = spark.sql("""SELECT array(named_struct('path', '/a'), named_struct('path', '')) AS files, '/n' AS path
        UNION ALL SELECT cast(array() AS array<struct<path:string>>), '/n' UNION ALL SELECT NULL, ''""")
    assert [r.p for r in df.select(G.node_paths().alias("p")).collect()] == [["/a"], ["/n"], []]


@pytest.mark.parametrize("k", [1, 25, 999, 1000, 3000])
def test_cutoff_is_the_kth_key(spark, k):
    df = spark.range(1000).selectExpr("id % 97 AS a", "concat('k', id) AS b")
    every = sorted(((r.a, r.b) for r in df.collect()), key=lambda t: (-t[0], t[1]))
    row = cutoff(df, [("a", True), ("b", False)], k).first()
    assert (tuple(row.cut) if row else None) == (every[k - 1] if k <= 1000 else None)


def test_redact(spark):
    rows = [
        ("email me at person@example.com", [("person@example.com", "EMAIL")]),
        ("xabyab", [("ab", "A"), ("", "B"), ("zz", None)]),
        ("account 123", [("account 123", "X"), ("123", "Y")]),
        ("none", None),
    ]
    df = spark.createDataFrame(rows, "content string, pii_list array<struct<value:string,pii_type:string>>").withColumn("path", F.lit("/p"))
    got = R.redact(df).collect()
    assert [(r.content, r.replacements, r.pii_types) for r in got] == [
        ("email me at [REDACTED]", 1, ["EMAIL"]),
        ("x[REDACTED]y[REDACTED]", 1, ["A", "B", "unknown"]),
        ("[REDACTED]", 1, ["X", "Y"]),
        ("none", 0, []),
    ]
    event = R.redact_events(R.redact(df)).first()
    assert (event.type, event.source) == ("remediation.redact", "remediation.redact_file")
    assert event.payload == '{"file":"/p","pii_types":["EMAIL"],"replacements":1}'
    assert "person@example.com" not in event.payload


def test_encrypt_and_decrypt(spark):
    key, other = F.lit("0123456789abcdef").cast("binary"), F.lit("0000000000000000").cast("binary")
    plain = spark.createDataFrame([("/a.txt", "secret text")], "path string, content string")
    sealed = R.encrypt(plain, key)
    assert sealed.first().path == "/a.txt.enc"
    good, bad = R.decrypt(sealed, key)
    assert good.select("path", "content").first() == ("/a.txt", "secret text") and bad.count() == 0
    good, bad = R.decrypt(sealed.unionByName(plain.withColumn("original", F.lit(None))), other)
    assert good.count() == 0 and bad.count() == 2
    kinds = [r.type for r in R.encrypt_events(sealed).collect()]
    assert sorted(kinds) == ["remediation.encrypt", "remediation.shred"]


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "ledger")
    entries = spark.createDataFrame(
        [("scan", "ui", '{"b": 1, "a": 2}', None), ("remediation.redact", "api", None, '{"k": [1]}')],
        "type string, source string, payload string, metadata string",
    )
    first = L.append(entries, path, as_of()).orderBy("id").collect()
    assert [(r.id, r.type, r.payload, r.metadata) for r in first] == [
        (1, "remediation.redact", "{}", '{"k":[1]}'),
        (2, "scan", '{"a":2,"b":1}', "{}"),
    ]
    L.append(entries, path, as_of())
    table = L.read(spark, path)
    assert [r.id for r in L.history(table).collect()] == [1, 2, 3, 4]
    assert [r.id for r in L.history(table, type="scan", limit=1, offset=1).collect()] == [4]
    assert [r.id for r in L.where(table, "source = ?", ["api"]).collect()] == [1, 3]
    assert L.query(table, "SELECT count(*) AS n FROM ledger_entries").first().n == 4
    assert os.path.isdir(f"{path}/type=scan")
    pruned = L.history(table, type="scan")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in pruned
    with pytest.raises(Exception, match="type and source are required"):
        L.append(entries.withColumn("source", F.lit("")), path, as_of())


def test_entity_decoding(spark):
    text = "Ann Lee of Acme in Rome"
    # (start, stop, label): begin, inside, nothing, inside without begin, zero width, other, begin, begin
    tokens = [(0, 3, 1), (4, 7, 2), (8, 10, 0), (11, 15, 4), (15, 15, 0), (16, 18, 8), (19, 21, 5), (21, 23, 6)]
    rows = [("d", 0, text, "", "", [(s, e, [4.0 if i == lab else 0.0 for i in range(9)]) for s, e, lab in tokens])]
    df = spark.createDataFrame(rows, f"doc_id string, chunk_start int, chunk string, before string, after string, tokens {N.TOKENS}")
    found = N.decode(N.label_tokens(df), "doc_id").first().detections
    assert [(d.pii_type, d.value, d.start, d.stop) for d in found] == [
        ("Name", "Ann Lee", 0, 7), ("Organization", "Acme", 11, 15), ("Location", "Rome", 19, 23),
    ]
    assert found[0].confidence == round(2.718281828459045**4 / (2.718281828459045**4 + 8), 4)
    assert found[0].category == "identity" and found[0].method == "ner"


def test_chunks_cover_text(spark):
    text = "é" * 1800 + "b" * 1800 + "tail"
    rows = N.chunks(spark.createDataFrame([(1, text), (2, "")], "doc_id int, text string"), "doc_id").orderBy("chunk_start").collect()
    assert "".join(r.chunk for r in rows) == text and [r.chunk_start for r in rows] == [0, 1800, 3600]
    assert rows[1].before == "é" * 50 and rows[1].after == "tail" and rows[0].before == ""


def stream_files(spark, folder, batches):
    folder.mkdir()
    for i, paths in enumerate(batches):
        df = spark.createDataFrame([(p, 10, "2024-01-01") for p in paths], "path string, size long, m string")
        df.withColumn("modified", F.to_timestamp("m")).drop("m").coalesce(1).write.parquet(str(folder / f"b{i}"))
    reader = spark.readStream.schema("path string, size long, modified timestamp").option("recursiveFileLookup", True)
    return reader.option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stream_dedupes_across_batches(spark, tmp_path):
    stream = stream_files(spark, tmp_path / "in", [["/r/a.txt", "/r/b.txt"], ["/r/b.txt", "/r/c.txt"]])
    T.to_json_lines(T.new_paths(stream, "1 day").select("path"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.path for r in spark.read.json(str(tmp_path / "out")).collect()) == ["/r/a.txt", "/r/b.txt", "/r/c.txt"]


def test_stream_budget(spark, tmp_path):
    stream = stream_files(spark, tmp_path / "in", [["/r/a.txt", "/r/b.png"], ["/r/c.txt", "/r/d.txt"], ["/r/e.txt"]])
    log = T.read_log(spark, T.scan_log(stream, ["/r"], str(tmp_path / "log"), max_files=3)).orderBy("seq", "path").collect()
    assert [r.event for r in log][0] == "start" and [r.event for r in log][-2:] == ["limit_reached", "complete"]
    assert len([r for r in log if r.seq == 1]) == 3
    whole = stream_files(spark, tmp_path / "in2", [["/r/a.txt"], ["/r/.h/x.txt", "/r/b.png"]])
    log = T.read_log(spark, T.scan_log(whole, ["/r"], str(tmp_path / "log2"), max_files=10)).orderBy("seq", "path").collect()
    assert [(r.event, r.path) for r in log] == [("start", None), ("file", "/r/a.txt"), ("skip", "/r/b.png"), ("complete", None)]


def test_stream_tree_reads_files(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.txt").write_text("patient")
    stream = T.stream_tree(spark, str(tmp_path / "tree"), per_trigger=1)
    T.to_parquet(stream.select("path", F.col("content").cast("string").alias("c")), str(tmp_path / "o"), state=str(tmp_path / "s"))
    row = spark.read.parquet(str(tmp_path / "o")).first()
    assert row.c == "patient" and row.path.endswith("/tree/a.txt") and row.path.startswith("/")


def test_long_rows_keep_the_surest_copy_of_a_finding(spark):
    rows = [
        (1, "Name", 0, 3, "Ann", "regex", 0.5, 0), (1, "Name", 0, 3, "ANN", "ner", 0.9, 1), (1, "Name", 0, 3, "ann", "ner", 0.9, 2),
        (1, "Name", 0, 4, "Ann", "ner", 0.1, 1), (2, "Name", 0, 3, "Ann", "ner", 0.1, 1), (None, "Name", 0, 3, None, "ner", None, 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, pii_type string, start int, stop int, value string, method string, confidence double, method_ord int")
    got = D.dedupe_rows(df)
    assert dict(got.dtypes) == dict(df.dtypes)
    assert sorted(map(str, got.select(df.columns).collect())) == sorted(str(df.collect()[i]) for i in (1, 3, 4, 5))
    # Columns of the kept row are held once, and keys begin with the position.
    (line,) = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
    assert "max_by" not in line and line.index("start#") < line.index("pii_type#")


def test_dedupe_copies_no_detections_between_steps(spark):
    df = spark.createDataFrame([(1, [])], f"doc_id long, detections {D.DETECTIONS}").select("doc_id", F.filter("detections", lambda d: d.value != "").alias("detections"))
    plan = D.dedupe(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1 and "array_sort" not in plan


def test_a_filter_behind_redaction_does_not_redact_again(spark, tmp_path):
    spark.createDataFrame([("a", "x one"), ("b", "y"), ("c", None)], "path string, content string").write.parquet(f"{tmp_path}/t")
    asked = spark.read.parquet(f"{tmp_path}/t").withColumn("pii_list", F.expr("array(named_struct('value', concat('o', 'ne'), 'pii_type', path))"))
    done = R.redact(asked).filter("replacements > 0")
    assert [(r.path, r.replacements, r.pii_types) for r in done.collect()] == [("a", 1, ["a"])]
    assert R.redact(asked).count() == 3
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "aggregate(" in line]
