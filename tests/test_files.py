"""Scans of real folders, extraction, chats and table dumps."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from riskloom.functions import paths as P
from riskloom.operators import inventory as I
from riskloom.plans import audit as A
from riskloom.session import scratch_dir
from riskloom.sources import chats, files, sinks, tables

FOLDER = {
    "notes.txt": "Aadhaar 7301 2468 9150\r\nmail person@example.com\n",
    "manifest.csv": "id,phone\n" + "\n".join(f"{i},9876543210" for i in range(150)) + "\n",
    "app.config.local": "API_KEY=abc123\n",
    "data.json": '{"b": 1, "a": {"d": "x", "c": [1, 2]}}',
    "broken.json": '{"b": 1',
    "empty.txt": "",
    "readme.md": "nothing",
    "photo.png": "binary",
    "big.log": "x" * 3000,
    "nested/finance/statement.log": "IBAN: GB82WEST12345698765432\n",
    "a/b/c/d/e/deep.txt": "five levels",
    "a/b/c/d/e/f/deeper.txt": "six levels",
    "WhatsApp Chat with X.txt": (
        "lead line dropped\n12/01/2025, 10:30 AM - Alice: My email is alice@example.com\n\n  and more \n"
        "[12/01/25, 10:31:05] Bob: Noted\n"
    ),
    "result.json": json.dumps(
        {
            "messages": [
                {"date": "d1", "from": "Ann", "text": "hello"},
                {"date": "d2", "from": "", "from_id": "user7", "text": ["part ", {"type": "bold", "text": "two"}]},
                {"date": "d3", "text": "   "},
                {"date": "d4", "text": 42},
                "not a message",
            ]
        }
    ),
    "telegram_other.json": json.dumps({"messages": [{"sender": "x", "body": "y"}]}),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FOLDER.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (root / "bytes.txt").write_bytes(b"ok \xff\xfe caf\xc3\xa9")
    return str(root)


@pytest.fixture(scope="module")
def scanned(spark, folder):
    return A.scan(spark, [folder], max_depth=5, max_file_size_mb=2500 / 1024 / 1024)


def test_scan_has_no_limits_of_its_own(spark, folder):
    scan = A.scan(spark, [folder])
    assert f"{folder}/a/b/c/d/e/f/deeper.txt" in {r.path for r in scan.files.collect()}
    assert scan.visited.filter("outcome = 'large'").count() == 0


def test_raw_bytes_of_parsed_formats_are_unsupported(spark):
    rows = [("/r/a.pdf", 9, "%PDF"), ("/r/b.xlsx", 9, "PK"), ("/r/c.txt", 9, "text")]
    table = spark.createDataFrame(rows, "path string, size long, content string").withColumn("modified", F.lit("2024-01-01").cast("timestamp"))
    parsed = A.scan(spark, ["/r"], inventory=table)
    raw = A.scan(spark, ["/r"], inventory=table.withColumn("content", F.col("content").cast("binary")))
    assert {r.path for r in parsed.files.collect()} == {"/r/a.pdf", "/r/b.xlsx", "/r/c.txt"}
    assert {r.path for r in raw.files.collect()} == {"/r/c.txt"}
    assert {r.outcome for r in raw.visited.collect()} == {"unsupported", "read"}


def test_scan_reads_supported_files(scanned, folder):
    got = {r.path[len(folder) + 1 :]: r for r in scanned.files.collect()}
    assert set(got) == {
        "notes.txt", "manifest.csv", "app.config.local", "data.json", "nested/finance/statement.log", "a/b/c/d/e/deep.txt",
        "WhatsApp Chat with X.txt", "result.json", "bytes.txt",
    }
    assert got["notes.txt"].content == "Aadhaar 7301 2468 9150\nmail person@example.com\n"
    assert got["bytes.txt"].content == "ok  café"
    assert got["data.json"].content == '{"a":{"c":[1,2],"d":"x"},"b":1}'
    assert got["manifest.csv"].content.count("\n") == 150
    chat = got["WhatsApp Chat with X.txt"]
    assert chat.content == "Alice: My email is alice@example.com and more\nBob: Noted"
    assert (chat.chat_platform, chat.chat_message_count, chat.chat_participants_sample) == ("whatsapp", 2, ["Alice", "Bob"])
    export = got["result.json"]
    assert export.content == "d1 Ann: hello\nd2 user7: part two\nd4 unknown: 42"
    assert (export.chat_message_count, export.chat_participant_count) == (3, 3)
    assert got["notes.txt"].chat_platform is None


def test_scan_stats(scanned):
    total = scanned.stats.filter("root_ord IS NULL").first()
    # Everything visited counts, whatever happens to it later; the deepest folder is not visited and
    # Spark does not list the empty file.
    assert total.total_files == 14
    assert (total.text_files, total.csvs, total.chats, total.skipped_large_files) == (5, 1, 3, 1)
    assert (total.pdfs, total.dbs, total.permission_errors, total.paths_scanned) == (0, 0, 0, 1)


def test_inventory_table_counts_empty_files(spark):
    rows = [("/r/empty.txt", 0, b""), ("/r/a.txt", 2, b"ok"), ("/r/.x.txt", 2, b"ok")]
    table = spark.createDataFrame(rows, "path string, size long, content binary").withColumn("modified", F.current_timestamp())
    scan = A.scan(spark, ["/r"], inventory=table)
    assert scan.stats.filter("root_ord IS NULL").select("total_files", "text_files").first() == (3, 3)
    assert sorted(r.filename for r in scan.files.collect()) == [".x.txt", "a.txt"]


def test_bounds_limit_extracts(spark, folder):
    scan = A.scan(spark, [folder], bounds=files.Bounds(chars=20, csv_rows=2, messages=1))
    got = {r.filename: r.content for r in scan.files.collect()}
    assert got["manifest.csv"] == "id,phone\n0,987654321"
    assert got["result.json"] == "d1 Ann: hello"
    assert max(len(c) for c in got.values()) <= 20


def test_budget_and_nested_roots(spark, folder):
    roots = [f"{folder}/a", folder]
    assert files.top_roots(roots) == [folder]
    scan = A.scan(spark, roots, max_files=3)
    got = {r.path[len(folder) + 1 :]: r.root_ord for r in scan.visited.collect()}
    # The first root reaches one level deeper than the second.
    assert got["a/b/c/d/e/deep.txt"] == 0 and got["a/b/c/d/e/f/deeper.txt"] == 0
    assert len(got) == 3 and sum(1 for r in got.values() if r == 1) == 1


def test_whole_audit(spark, scanned):
    rows = {r.path.rsplit("/", 1)[1]: r for r in A.scored_files(scanned.files, F.current_timestamp()).collect()}
    assert rows["notes.txt"].raw_score == 28 and rows["notes.txt"].severity == "green"
    assert rows["app.config.local"].credentials == 16
    view = {r.name: r for r in A.audit(scanned.files).collect()}
    assert view["notes.txt"].pii == ["aadhaar", "email"] and view["notes.txt"].severity == 3
    assert view["statement.log"].pii == ["iban"] and view["statement.log"].category == "financial"


def test_listing_does_not_read_contents(scanned):
    plan = scanned.stats._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize(
    ("name", "ext", "view"),
    [("a.b", ".b", "b"), (".env", "", "env"), ("x.env", ".env", "env"), ("..x.y", ".y", "y"), ("a.", ".", ""), ("noext", "", "unknown")],
)
def test_extensions(spark, name, ext, view):
    path = F.lit(f"/d.d/{name}")
    row = spark.range(1).select(P.extension(path).alias("e"), P.view_extension(path).alias("v")).first()
    assert (row.e, row.v) == (ext, view)


def test_kinds_and_types(spark):
    expected = {
        "/a/whatsapp chat.txt": ("chat", "chat_log"),
        "/a/my result.json": ("chat", "chat_log"),
        "/whatsapp/notes.txt": ("text", "text"),
        "/a/x.PDF": ("pdf", "pdf"),
        "/a/x.xlsx": ("csv", "spreadsheet"),
        "/chrome/x": (None, "browser_db"),
        "/a/x.db": ("db", "text"),
        "/a/sqlite_dump.bin2": ("db", "text"),
        "/a/.env": (None, "text"),
        "/a/passwords.old": ("text", "text"),
        "/secrets/x.old": (None, "text"),
    }
    df = spark.createDataFrame([(p,) for p in expected], "path string")
    rows = df.select("path", P.extract_kind(F.col("path")).alias("k"), P.file_type(F.col("path")).alias("t")).collect()
    assert {r.path: (r.k, r.t) for r in rows} == expected


def test_stable_id_and_sizes(spark):
    ids = spark.range(1).select(P.stable_id("'sample/a'").alias("a"), P.stable_id("''").alias("b"), P.stable_id("'unknown'").alias("c")).first()
    assert ids.a == "node-wo77ek" and ids.b == ids.c
    sizes = [0, -1, 1, 1023, 1024, 1536, 10 * 1024, 1024**2 * 3 // 2, 5 * 1024**3, 5000 * 1024**3]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s long")
    got = [r.l for r in df.select("i", P.format_bytes(F.col("s")).alias("l")).orderBy("i").collect()]
    assert got == ["0 B", "0 B", "1 B", "1023 B", "1.0 KB", "1.5 KB", "10 KB", "1.5 MB", "5.0 GB", "5000 GB"]


def test_chat_without_headers_is_raw_text(spark):
    df = spark.createDataFrame([("/c/whatsapp.txt", "just\ntext")], "path string, content string")
    row = chats.parse_chat_files(df).first()
    assert (row.content, row.chat_message_count) == ("just\ntext", 0)


def test_hot_chat_stays_in_bounded_groups(spark):
    messages = spark.range(5000).selectExpr(
        "if(id % 3 > 0, 1, id) AS conv_id", "id AS turn", "'d' AS date", "concat('s', id % 20) AS `from`", "'' AS from_id", "'hi' AS text"
    )
    lines = chats.message_lines(messages)
    parts = chats.chat_documents(lines)
    assert parts.agg(F.max("messages")).first()[0] <= 500
    assert parts.agg(F.sum("messages")).first()[0] == 5000
    hot = chats.chat_metadata(lines).filter("conv_id = 1").first()
    assert (hot.message_count, hot.participant_count, len(hot.participants_sample)) == (3333, 20, 10)


def test_table_dump_keeps_all_rows(spark):
    df = spark.range(120).selectExpr("id", "if(id = 3, NULL, concat('v', id)) AS v")
    dump = {r.block: r for r in tables.tables_as_text({"t": (df, "id"), "missing": (None, "id")}).collect()}
    assert {b: r.row_count for b, r in dump.items()} == {0: 50, 1: 50, 2: 20}
    assert dump[0].content.startswith("\n--- t ---\n[(0, v0), (1, v1), (2, v2), (3, NULL)")
    short = tables.table_as_text(df, "t", "id", chars=10).filter("block = 0").first().content
    assert short == "\n--- t ---\n[(0, v0), "


def test_scratch_lives_under_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(named + "/x-")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_normalized_paths(spark):
    cases = {"/a/./b//c": "/a/b/c", "/a/x/../b": "/a/b", "/../a": "/a", "/": "/", "/a/b/": "/a/b"}
    df = spark.createDataFrame(list(cases.items()), "p string, e string")
    assert all(r.n == r.e for r in df.select(P.normalized("p").alias("n"), "e").collect())


def test_running_stats_match_sorted_count(spark):
    files_df = spark.range(500).selectExpr("concat('/r/', id % 7, '/f', id, if(id % 3 = 0, '.txt', '.png')) AS path", "id AS size")
    seen = I.dispatch(I.visit(files_df, ["/r"]))
    got = I.running_stats(seen).orderBy("path").collect()
    expected = 0
    for i, row in enumerate(got):
        expected += row.path.endswith(".txt")
        assert (row.total_files, row.text_files) == (i + 1, expected)


def test_sinks(spark, tmp_path):
    events = spark.createDataFrame([("file", "/a")], "event string, path string")
    sinks.write_events(events, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).first().path == "/a"
    version = sinks.write_version(events)
    assert spark.read.parquet(version).count() == 1
    with pytest.raises(Exception, match="already exists"):
        sinks.write_version(events, version)
