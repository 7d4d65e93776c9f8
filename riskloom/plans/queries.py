"""Every operator as a query over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.catalog import BONUS_WEIGHT, MAX_DEPTH, MAX_FILE_SIZE_MB, RULES, SCORE_CATEGORIES, TOP_N_FILES, Rule
from riskloom.functions import paths as P
from riskloom.operators import audit_view as V
from riskloom.operators import detect as D
from riskloom.operators import entities as N
from riskloom.operators import inventory as I
from riskloom.operators import ledger as L
from riskloom.operators import remediate as R
from riskloom.operators import rollup as G
from riskloom.operators import score as S
from riskloom.plans import audit as A
from riskloom.plans import corpus as C
from riskloom.plans.tagger import word_length_model
from riskloom.session import scratch_dir, spread
from riskloom.sources import chats, files, sinks, tables, versions
from riskloom.streaming import scan as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(array: str) -> F.Column:
    return F.expr(f"array_join({array}, ',')")


# ---- detection ---------------------------------------------------------------------------------


@query
def pii_raw_counts(spark, sf_dir):
    return D.raw_counts(C.planted(spark, sf_dir))


@query
def pii_positions(spark, sf_dir):
    found = D.detect(C.planted(spark, sf_dir), heuristics=False)
    return D.explode_detections(found, "doc_id").select("doc_id", "pii_type", "start", "stop", "value")


@query
def pii_kept(spark, sf_dir):
    found = D.detect(C.planted(spark, sf_dir))
    return D.explode_detections(found, "doc_id").select("doc_id", "pii_type", "category", "start", "stop", "value")


@query
def pii_excerpts(spark, sf_dir):
    found = D.detect(C.planted(spark, sf_dir), heuristics=False)
    return D.explode_detections(found, "doc_id").select("doc_id", "pii_type", "start", "excerpt")


@query
def pii_doc_summary(spark, sf_dir):
    found = D.dedupe(D.detect(C.planted(spark, sf_dir)))
    return D.summarize(found, "doc_id").select(
        "doc_id",
        joined("pii_types").alias("pii_types"),
        joined("categories").alias("categories"),
        F.expr("size(confidence)").alias("n"),
        "backend",
    )


@query
def pii_presence_view(spark, sf_dir):
    return C.planted(spark, sf_dir).select("doc_id", F.array_join(D.presence("text"), ",").alias("types"))


@query
def pii_natural_sources(spark, sf_dir):
    """Unplanted texts of three tables: matches and kept matches per source and type."""
    docs = spread(C.table(spark, sf_dir, "documents")).select(F.lit("documents").alias("origin"), "text")
    pages = spread(C.table(spark, sf_dir, "pages")).select(F.lit("pages").alias("origin"), F.col("html").alias("text"))
    turns = spread(C.table(spark, sf_dir, "conversations")).select(F.lit("conversations").alias("origin"), "text")
    texts = docs.unionByName(pages).unionByName(turns)
    both = D.detect(D.detect(texts, heuristics=False, output="raw"), output="kept").select("origin", "raw", "kept")
    merged = both.select("origin", F.expr("""concat(
        transform(raw, d -> named_struct('pii_type', d.pii_type, 'kept', 0L)),
        transform(kept, d -> named_struct('pii_type', d.pii_type, 'kept', 1L)))""").alias("all"))
    return D.rows_of(merged, "origin", column="all").groupBy("origin", "_d.pii_type").agg(
        F.count_if(F.col("_d.kept") == 0).alias("hits"), F.sum("_d.kept").alias("kept")
    )


@query
def pii_dedupe(spark, sf_dir):
    """The regex detections together with a second method's copies of them, as long rows."""
    found = D.explode_detections(D.detect(C.planted(spark, sf_dir), heuristics=False), "doc_id")
    copies = """array(named_struct('value', value, 'method', method, 'confidence', confidence, 'method_ord', 0),
        named_struct('value', upper(value), 'method', 'ner', 'confidence', array(0.9D, 0.95D, 0.99D)[start % 3], 'method_ord', 1))"""
    rows = found.select("doc_id", "pii_type", "start", "stop", F.expr(f"inline({copies})"))
    return D.dedupe_rows(rows).select("doc_id", "pii_type", "start", "stop", "method", "value")


@query
def line_noise(spark, sf_dir):
    """How many lines of each text the noise and CSV rules mark."""
    lines = C.planted(spark, sf_dir).select("doc_id", F.expr("split(text, '\n', -1)").alias("l"))
    return lines.select(
        "doc_id",
        F.size("l").alias("lines"),
        F.expr(f"size(filter(l, x -> {D.noise_line('x')}))").alias("noise"),
        F.expr(f"size(filter(l, x -> {D.csv_line('x')}))").alias("csv"),
    )


# ---- score -------------------------------------------------------------------------------------


def detected(spark, sf_dir) -> DataFrame:
    return D.detect(C.planted(spark, sf_dir)).withColumn("types", F.expr("detections.pii_type"))


@query
def doc_score(spark, sf_dir):
    return S.score_types(detected(spark, sf_dir), "types").select("doc_id", "raw_score", "score", "severity")


@query
def score_breakdown(spark, sf_dir):
    """Long form: weighed detections, one aggregate per file, joined to file metadata for bonuses."""
    found = D.detect(C.corpus(spark, sf_dir), text="content")
    weighed = S.weigh(D.explode_detections(found, "path"))
    meta = C.inventory(spark, sf_dir).select("path", "modified")
    scored = S.with_file_metadata(S.score_rows(weighed, "path"), meta, C.as_of())
    return scored.select("path", *SCORE_CATEGORIES, "bonuses", "raw_score", "score", "severity")


@query
def score_in_row(spark, sf_dir):
    """The same breakdown inside each row, without a shuffle."""
    return S.breakdown(detected(spark, sf_dir), "types").select("doc_id", *SCORE_CATEGORIES)


@query
def score_bonuses(spark, sf_dir):
    inv = C.inventory(spark, sf_dir)
    listed = inv.select(
        "path", S.bonuses(F.col("path"), F.col("modified"), F.expr("doc_id % 3 = 0"), C.as_of()).alias("b")
    )
    return listed.select("path", joined("b.reason").alias("reasons"), (F.size("b") * BONUS_WEIGHT).alias("weight"))


@query
def score_weights(spark, sf_dir):
    found = D.explode_detections(D.detect(C.planted(spark, sf_dir)), "doc_id")
    return S.weigh(found).groupBy("pii_type", "category").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query
def score_shapes(spark, sf_dir):
    """Results that carry plain type names, some unknown, score like full detections."""
    mixed = detected(spark, sf_dir).withColumn(
        "pii_types", F.expr("if(doc_id % 3 = 0, array('Passport', 'Email'), types)")
    ).withColumn("detections", F.expr("if(doc_id % 2 = 0, detections, NULL)"))
    shaped = mixed.withColumn("any_types", F.expr(S.types_of_any("detections", "pii_types")))
    return S.score_types(shaped, "any_types").select("doc_id", "raw_score", "severity")


CUSTOM = (*RULES, Rule("Badge", "identity", 30, r"EMP\d"), Rule("Routing", "financial", 7, r"KVBL0"))


@query
def score_custom_rules(spark, sf_dir):
    """Rules of the caller's own weigh what they say, in the row and in the long form alike."""
    found = D.detect(C.planted(spark, sf_dir), rules=CUSTOM[-2:], heuristics=False)
    types = "detections.pii_type"
    in_row = S.breakdown(S.score_types(found, types, rules=CUSTOM), types, CUSTOM).filter("raw_score > 0")
    long = S.score_rows(S.weigh(D.explode_detections(found, "doc_id"), CUSTOM), "doc_id")
    columns = ["doc_id", "raw_score", "identity", "financial", "other"]
    return in_row.select(F.lit("row").alias("form"), *columns).unionByName(long.select(F.lit("long").alias("form"), *columns))


# ---- inventory ---------------------------------------------------------------------------------


@query
def scan_inventory(spark, sf_dir):
    seen = I.dispatch(I.visit(C.inventory(spark, sf_dir), [C.ROOT], MAX_DEPTH), 20_000 / 1024 / 1024)
    return seen.select("path", "outcome", "kind", P.file_type(F.col("path")).alias("file_type"))


@query
def scan_stats(spark, sf_dir):
    seen = I.dispatch(I.visit(C.inventory(spark, sf_dir), C.ROOTS, MAX_DEPTH), 20_000 / 1024 / 1024)
    return I.scan_stats(seen, C.ROOTS)


@query
def scan_unbounded(spark, sf_dir):
    """No limits, paths of two file systems, roots written with and without their store."""
    stores = "if(doc_id % 2 = 0, 'hdfs://nn:8020', 's3a://bucket')"
    inv = C.inventory(spark, sf_dir).withColumn("path", F.expr(f"concat({stores}, path)"))
    seen = I.dispatch(I.visit(inv, ["s3a://bucket/home/u/Downloads", "hdfs:///home/u/Documents", "/home/u"]))
    return seen.select("root_ord", "path", "outcome", "kind")


def _failing(spark, sf_dir) -> DataFrame:
    failed = F.expr("if(doc_id % 9 = 4, concat('denied: ', path), NULL)")
    return C.corpus(spark, sf_dir).withColumn("error", failed).withColumn("content", F.expr("if(error IS NULL, content, NULL)"))


@query
def scan_errors(spark, sf_dir):
    """Unreadable files are listed with their reason and end no scan."""
    return A.scan(spark, [C.ROOT], C.as_of(), inventory=_failing(spark, sf_dir)).errors


@query
def scan_error_stats(spark, sf_dir):
    """Counters with unreadable files and a root without files."""
    scan = A.scan(spark, [C.ROOT, "/nowhere"], C.as_of(), inventory=_failing(spark, sf_dir))
    return scan.stats.select("root_ord", "total_files", "permission_errors", "paths_scanned")


@query
def scan_budget(spark, sf_dir):
    seen = I.visit(C.inventory(spark, sf_dir), C.ROOTS, MAX_DEPTH)
    return I.within_budget(seen, 300).select("root_ord", "path")


@query
def multi_root_merge(spark, sf_dir):
    return I.visit(C.inventory(spark, sf_dir), C.ROOTS, MAX_DEPTH).select("root_ord", "path", "size")


@query
def unique_paths(spark, sf_dir):
    """An inventory that lists some files twice under different spellings."""
    first = C.inventory(spark, sf_dir).withColumn("root_ord", F.lit(0))
    again = first.filter("size > 1000").select(
        "doc_id", F.expr("replace(path, '/home/', '/home/.//x/../')").alias("path"), F.expr("size + 1").alias("size"),
        "modified", F.lit(1).alias("root_ord"),
    )
    return I.unique_paths(first.unionByName(again)).select("path", "size", "root_ord")


@query
def running_stats(spark, sf_dir):
    seen = I.dispatch(I.visit(C.inventory(spark, sf_dir), C.ROOTS, MAX_DEPTH), 20_000 / 1024 / 1024)
    return I.running_stats(seen).select("root_ord", "path", *I.stat_flags())


@query
def file_metadata(spark, sf_dir):
    """Some files were modified at a fraction of a second."""
    split = F.expr("timestamp_micros(unix_micros(modified) + doc_id % 7 * 250001)")
    meta = I.with_metadata(C.inventory(spark, sf_dir).withColumn("modified", split), C.as_of())
    return meta.select(
        "path", "filename", "extension", "directory", "modified_unix", "modified_iso", "age_days", "location_risk"
    )


@query
def planted_names(spark, sf_dir):
    """Names with the markers of chats, configurations, databases and sealed files."""
    seen = I.dispatch(C.named_files(spark, sf_dir)).withColumn("file_type", P.file_type(F.col("path")))
    named = R.eligibility(seen).withColumns({"chat_name": P.is_chat_name(F.col("path")), "config_name": P.is_config_name(F.col("path"))})
    return named.select("path", "outcome", "kind", "file_type", "chat_name", "config_name", "can_decrypt")


# ---- extraction --------------------------------------------------------------------------------


@query
def extract_text(spark, sf_dir):
    seen = I.dispatch(I.visit(C.corpus(spark, sf_dir), [C.ROOT], MAX_DEPTH), MAX_FILE_SIZE_MB)
    out = files.extract(seen)
    return out.select("path", "kind", F.char_length("content").alias("chars"), F.md5("content").alias("digest"))


@query
def extract_bounded(spark, sf_dir):
    """The same as an interactive scan shows it: the first records of tables and the first characters of texts."""
    seen = I.dispatch(I.visit(C.corpus(spark, sf_dir), [C.ROOT], MAX_DEPTH), MAX_FILE_SIZE_MB)
    out = files.extract(seen, files.Bounds(chars=300, csv_rows=1))
    return out.select("path", "kind", F.md5("content").alias("digest"))


@query
def scan_tree(spark, sf_dir):
    """Documents written as text files, one folder per source and language, then scanned from there."""
    root = scratch_dir(spark, "tree")
    docs = C.planted(spark, sf_dir).select("source", "lang", "text")
    docs.write.partitionBy("source", "lang").option("maxRecordsPerFile", 500).text(root)
    found = D.detect(A.scan(spark, [root]).files, text="content", heuristics=False)
    rows = D.explode_detections(found, "directory")
    place = [F.regexp_extract("directory", f"/{k}=([^/]*)", 1).alias(k) for k in ("source", "lang")]
    return rows.groupBy(*place, "pii_type").agg(F.count("*").alias("hits"))


def _scanned_tree(spark, sf_dir) -> tuple[str, A.Scan]:
    """A tree with hidden names, empty files, links to nothing and a root that is not there."""
    root = C.planted_tree(spark, sf_dir, scratch_dir(spark, "tree"))
    return root, A.scan(spark, [f"file:{root}", f"{root}-missing"], C.as_of(), complete=True)


def _below(root: str) -> F.Column:
    return F.expr(f"substring(path, {len(root) + 1})").alias("path")


@query
def scan_tree_complete(spark, sf_dir):
    """Every file that a walk meets, and the text of those that were read."""
    root, scan = _scanned_tree(spark, sf_dir)
    texts = scan.files.select("path", F.md5("content").alias("digest"))
    seen = scan.visited.select("path", "size", "outcome", "kind").join(texts, "path", "left")
    return seen.select(_below(root), "size", "outcome", "kind", "digest")


@query
def scan_tree_errors(spark, sf_dir):
    """What could not be read, files and directories."""
    root, scan = _scanned_tree(spark, sf_dir)
    return scan.errors.select(_below(root), F.substring_index("error", ":", 1).alias("error"))


@query
def scan_tree_stats(spark, sf_dir):
    root, scan = _scanned_tree(spark, sf_dir)
    return scan.stats.select("root_ord", "total_files", "text_files", "permission_errors", "paths_scanned")


@query
def json_extract(spark, sf_dir):
    """JSON built from events, one in ten cut short: canonical text, broken rows dropped."""
    events = C.table(spark, sf_dir, "events")
    body = "concat('{ \"user\": ', user_id, ', \"type\" : \"', event_type, '\", \"attrs\": ', props)"
    text = events.select("event_id", F.expr(f"concat({body}, if(event_id % 10 = 0, '', '}}'))").alias("j"))
    return text.select("event_id", files.json_text(F.col("j")).alias("content")).filter("content IS NOT NULL")


@query
def csv_extract(spark, sf_dir):
    """Texts read as CSV files: header and all lines, trailing blank lines dropped."""
    docs = C.planted(spark, sf_dir).withColumn("text", F.expr("concat(text, repeat('\n', int(doc_id % 3)))"))
    rows = files.csv_text(F.col("text"), None)
    return docs.select("doc_id", F.md5(rows).alias("digest"), F.size(F.split(rows, "\n", -1)).alias("lines"))


@query
def csv_records_fields(spark, sf_dir):
    """Texts as quoted fields with line breaks, commas and doubled quotes in them, between records without."""
    body = """concat('id,body,n\n', doc_id, ',"', replace(text, '"', '""'), '",1\n', doc_id, ',"a ""b"", c",2\n', '\n')"""
    built = C.planted(spark, sf_dir).select("doc_id", F.expr(body).alias("t"))
    cut = built.select("doc_id", files.csv_records(F.col("t")).alias("r"), files.csv_text(F.col("t"), 1).alias("first"))
    fields = cut.select("doc_id", F.size("r").alias("records"), F.md5("first").alias("first"), files.csv_fields(F.get("r", F.lit(1))).alias("f"), files.csv_fields(F.get("r", F.lit(2))).alias("g"))
    return fields.select("doc_id", "records", "first", F.size("f").alias("fields"), F.md5(F.get("f", F.lit(1))).alias("body"), F.get("g", F.lit(1)).alias("last"))


@query
def chat_lines(spark, sf_dir):
    return chats.message_lines(C.messages(spark, sf_dir))


@query
def chat_metadata(spark, sf_dir):
    meta = chats.chat_metadata(chats.message_lines(C.messages(spark, sf_dir)))
    return meta.select("conv_id", "message_count", "participant_count", joined("participants_sample").alias("participants"))


@query
def chat_documents(spark, sf_dir):
    return chats.chat_documents(chats.message_lines(C.messages(spark, sf_dir)), 3)


def _chat_files(lines: DataFrame, text: str, suffix: str) -> DataFrame:
    """Chat export files with at most 500 turns each."""
    grouped = lines.groupBy("conv_id", F.expr("turn div 500").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", F.expr(text).alias("t")))).alias("m")
    )
    return grouped.select(
        "conv_id", F.expr(f"concat('/chats/whatsapp chat ', conv_id, '-', part, '{suffix}')").alias("path"), "m"
    )


def _chat_result(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "path",
        "chat_platform",
        "chat_message_count",
        "chat_participant_count",
        joined("chat_participants_sample").alias("participants"),
        F.md5("content").alias("digest"),
    )


@query
def whatsapp_messages(spark, sf_dir):
    """Plain-text exports built from conversations; line breaks inside a turn become continuations."""
    turns = C.table(spark, sf_dir, "conversations")
    text = """if(conv_id % 7 = 6, text, concat(
        if(turn % 2 = 0, '12/01/2025, 10:30 AM - ', '[12/01/25, 10:31:05] '), initcap(role), ': ', text))"""
    exports = _chat_files(turns, text, ".txt").withColumn("content", F.expr("array_join(m.t, '\n')"))
    return _chat_result(chats.parse_chat_files(exports.drop("m")))


def _json_exports(spark, sf_dir) -> DataFrame:
    """JSON exports built from messages; every other turn's text is a list of parts."""
    text = """concat('{"id": ', turn, ', "date": "', date, '", "from": "', `from`, '", "from_id": "', from_id, '", "text": ',
        if(turn % 2 = 0, concat(substr(to_json(array(text)), 1, length(to_json(array(text))) - 1),
            ', {"type": "bold", "text": "!"}]'), substr(to_json(array(text)), 2, length(to_json(array(text))) - 2)), '}')"""
    exports = _chat_files(C.messages(spark, sf_dir), text, ".json")
    content = "concat(if(conv_id % 3 = 0, '', '{\"messages\": '), '[', array_join(m.t, ', '), ']', if(conv_id % 3 = 0, '', '}'))"
    return exports.withColumn("content", F.expr(content))


@query
def telegram_messages(spark, sf_dir):
    return _chat_result(chats.parse_chat_files(_json_exports(spark, sf_dir).drop("m")))


@query
def chat_parse_errors(spark, sf_dir):
    """Exports of which a quarter was cut off, a quarter has a number for its messages and a quarter is a text."""
    broken = """CASE conv_id % 4 WHEN 0 THEN left(content, length(content) - 1) WHEN 1 THEN concat('{"messages": ', size(m), '}')
        WHEN 2 THEN concat('"', size(m), '"') ELSE content END"""
    given = _json_exports(spark, sf_dir).withColumn("content", F.expr(broken))
    return chats.parse_chat_files(given.drop("m")).select("path", *chats.CHAT_COLUMNS[:3], "chat_parse_error")


@query
def table_text_dump(spark, sf_dir):
    keyed = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
    dumps = tables.tables_as_text(
        {name: (C.table(spark, sf_dir, name), key) for name, key in keyed.items()} | {"cookies": (None, "id")}
    )
    return dumps.select("table_name", "block", "row_count", F.md5("content").alias("digest"))


@query
def table_blocks(spark, sf_dir):
    """Orders by customer, a tenth of them without one, in blocks of at most 50 rows and 2,048 bytes."""
    orders = C.table(spark, sf_dir, "orders").selectExpr(
        "if(o_orderkey % 10 = 0, NULL, o_custkey) AS customer", "o_orderkey", "o_orderstatus", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "o_orderpriority"
    )
    blocks = tables.table_blocks(orders, "orders", ["customer"], rows=50, size=2048)
    return blocks.select("table_name", "first_row", "row_count", "size", F.md5("content").alias("digest"))


# ---- audit view and rollups --------------------------------------------------------------------


def audit_rows(spark, sf_dir) -> DataFrame:
    typed = C.corpus(spark, sf_dir).withColumn("file_type", P.file_type(F.col("path")))
    return V.normalize_files(typed.select("path", "size", "content", "file_type"))


def audit_table(spark, sf_dir) -> DataFrame:
    """Audit rows written once for rollups that read them several times."""
    return sinks.materialize(audit_rows(spark, sf_dir))


def flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pii", joined("pii")).withColumn("top_pii", joined("top_pii"))


@query
def audit_files(spark, sf_dir):
    return flat(audit_rows(spark, sf_dir))


@query
def audit_files_declared(spark, sf_dir):
    """Files that report types of their own, some with a severity, a category or other value sources."""
    found = D.detect(C.corpus(spark, sf_dir), text="content")
    given = found.select(
        "path",
        "content",
        "size",
        F.expr("if(doc_id % 4 = 0, 0, doc_id)").alias("token_count"),
        F.expr("if(doc_id % 13 = 0, double(doc_id % 9) / 2 - 0.5, NULL)").alias("severity"),
        F.expr("if(doc_id % 17 = 0, 'legal', NULL)").alias("category"),
        F.expr("detections.pii_type").alias("declared"),
    )
    return flat(V.normalize_files(given, "declared")).drop("excerpt")


@query
def audit_given(spark, sf_dir):
    """Files of which some have no path but an id, some no content but an excerpt, and some metadata of their own."""
    given = C.corpus(spark, sf_dir).selectExpr(
        "if(doc_id % 5 = 0, '', path) AS path", "if(doc_id % 5 = 0, concat('row-', doc_id), NULL) AS id", "size", "source",
        "if(doc_id % 3 = 0, NULL, content) AS content", "if(doc_id % 3 = 0, right(content, 40), NULL) AS excerpt",
        "date_sub(date '2024-06-01', int(doc_id % 800)) AS modified", "if(doc_id % 4 = 0, map('lang', lang, 'source', upper(source)), NULL) AS metadata",
    )
    shown = "array_join(array_sort(transform(map_entries(metadata), e -> concat(e.key, '=', e.value))), ';')"
    rows = V.normalize_files(given, metadata=True)
    return rows.select("id", "name", "path", "severity", joined("pii").alias("pii"), "excerpt", F.expr(shown).alias("metadata"))


@query
def node_paths(spark, sf_dir):
    """Nodes with files, with files of blank paths, and without any."""
    listed = "CASE doc_id % 3 WHEN 0 THEN array() WHEN 1 THEN array(struct(path)) ELSE array(struct('' AS path), struct(path), struct(concat(path, '.enc'))) END"
    nodes = C.inventory(spark, sf_dir).select("doc_id", F.expr("if(doc_id % 6 = 0, '', path)").alias("path"), F.expr(listed).alias("files"))
    return nodes.select("doc_id", F.array_join(G.node_paths(), ",").alias("paths"))


@query
def view_types(spark, sf_dir):
    """Type names given as structs under four possible fields, normalised."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    items = """array(named_struct('pii_type', '', 'type', lang, 'label', '', 'name', ''),
        named_struct('pii_type', upper(source), 'type', 'x', 'label', '', 'name', ''),
        named_struct('pii_type', '', 'type', '', 'label', '', 'name', upper(lang)),
        named_struct('pii_type', '', 'type', '', 'label', '', 'name', ''))"""
    return docs.select("doc_id", joined(V.normalize_type_structs(items)).alias("types"))


@query
def rollup_category(spark, sf_dir):
    return G.group_totals(audit_rows(spark, sf_dir), "category")


@query
def rollup_type(spark, sf_dir):
    return G.group_totals(audit_rows(spark, sf_dir), "type")


@query
def rollup_file(spark, sf_dir):
    return G.group_totals(audit_rows(spark, sf_dir), "file")


@query
def rollup_grouping_sets(spark, sf_dir):
    return G.all_group_totals(audit_rows(spark, sf_dir))


@query
def rollup_root(spark, sf_dir):
    return G.root_totals(G.group_totals(audit_rows(spark, sf_dir), "category"))


@query
def top_n_others(spark, sf_dir):
    return flat(G.top_n_with_others(audit_table(spark, sf_dir), 200)).drop("excerpt")


@query
def top_n_default(spark, sf_dir):
    """The same at the default of the treemap."""
    return flat(G.top_n_with_others(audit_table(spark, sf_dir), TOP_N_FILES)).drop("excerpt")


@query
def top_n_lineitem(spark, sf_dir):
    """The default cut over order lines as files, many more than it keeps."""
    lines = C.table(spark, sf_dir, "lineitem").select(
        F.expr("concat('/', l_orderkey, '/', l_linenumber)").alias("path"), F.expr("bigint(l_extendedprice)").alias("value"), F.expr("int(l_linenumber % 4)").alias("severity")
    )
    none = F.expr("cast(array() as array<string>)")
    rows = lines.withColumns({"id": F.col("path"), "name": F.col("path"), "pii": none, "top_pii": none, "excerpt": F.lit(""), "category": F.lit("c"), "file_type": F.lit("t")})
    return G.top_n_with_others(rows, TOP_N_FILES).select("name", "path", "value", "severity")


@query
def ordered_tree(spark, sf_dir):
    return G.ordered_tree(audit_table(spark, sf_dir))


@query
def ordered_groups(spark, sf_dir):
    return G.ordered_groups(G.group_totals(audit_rows(spark, sf_dir), "type")).select("group_name", "value", "place")


@query
def node_paths(spark, sf_dir):
    """Paths behind the groups of a tree: those of their files, or their own."""
    rows = C.inventory(spark, sf_dir).select("doc_id", "path")
    held = rows.select("path", F.expr("if(doc_id % 3 = 0, array(named_struct('path', concat(path, '/a')), named_struct('path', '')), cast(array() as array<struct<path:string>>))").alias("files"))
    return held.select("path", F.array_join(G.node_paths(), ",").alias("paths"))


@query
def group_top_k_category(spark, sf_dir):
    return flat(G.group_children(audit_table(spark, sf_dir), "category"))


@query
def group_top_k_type(spark, sf_dir):
    return flat(G.group_children(audit_table(spark, sf_dir), "type")).drop("excerpt")


@query
def group_top_k_file(spark, sf_dir):
    return flat(G.group_children(audit_table(spark, sf_dir), "file")).drop("excerpt")


@query
def treemap_groups(spark, sf_dir):
    """Group totals after the global top-N cut, the rest forming its own group."""
    return G.treemap(audit_table(spark, sf_dir), "category", 200)[0]


@query
def dir_rollup(spark, sf_dir):
    return G.directory_nodes(audit_table(spark, sf_dir))


@query
def common_prefix(spark, sf_dir):
    return G.common_prefix(C.inventory(spark, sf_dir))


@query
def portfolio_score(spark, sf_dir):
    return G.portfolio_score(audit_rows(spark, sf_dir))


@query
def dashboard_metrics(spark, sf_dir):
    return G.dashboard_metrics(audit_table(spark, sf_dir))


@query
def search_files(spark, sf_dir):
    return flat(audit_rows(spark, sf_dir).filter(G.matches_term("Src7"))).select("path", "pii", "severity")


@query
def search_groups(spark, sf_dir):
    rows = audit_table(spark, sf_dir)
    return G.search_groups(G.group_children(rows, "category"), G.group_totals(rows, "category"), "card")


@query
def search_directories(spark, sf_dir):
    rows = audit_table(spark, sf_dir)
    nodes = sinks.materialize(G.directory_nodes(rows))
    return G.search_directories(rows, nodes, "doc_1").select("path", "value", "severity", "file_count")


@query
def stable_ids(spark, sf_dir):
    paths = C.inventory(spark, sf_dir).select("path")
    urls = C.table(spark, sf_dir, "pages").select(F.expr("concat(url, '/é€\U0001f600')").alias("path"))
    return paths.unionByName(urls).select("path", P.stable_id("path").alias("id"))


@query
def size_labels(spark, sf_dir):
    inv = C.inventory(spark, sf_dir).select("path", F.expr("size * (1 + (doc_id % 5) * 9973 * doc_id)").alias("bytes"))
    return inv.select("path", P.format_bytes(F.col("bytes")).alias("label"), P.view_extension(F.col("path")).alias("ext"))


@query
def severity_labels(spark, sf_dir):
    rows = audit_rows(spark, sf_dir)
    return rows.groupBy("severity", P.severity_label(F.col("severity")).alias("label")).agg(F.count("*").alias("files"))


# ---- remediation -------------------------------------------------------------------------------


def redacted(spark, sf_dir) -> DataFrame:
    found = D.detect(C.corpus(spark, sf_dir), text="content", heuristics=False)
    wanted = "transform(detections, d -> named_struct('value', d.value, 'pii_type', d.pii_type))"
    extra = "array(named_struct('value', '', 'pii_type', cast(NULL AS string)))"
    asked = found.withColumn("pii_list", F.expr(f"if(doc_id % 5 = 0, concat({extra}, {wanted}), {wanted})"))
    return R.redact(asked)


@query
def redact_documents(spark, sf_dir):
    return redacted(spark, sf_dir).select(
        "path", "replacements", joined("pii_types").alias("pii_types"), F.md5("content").alias("digest")
    )


@query
def encrypt_roundtrip(spark, sf_dir):
    """A quarter of the files was sealed with another key and is rejected."""
    one, two = F.lit("0123456789abcdef").cast("binary"), F.lit("fedcba9876543210").cast("binary")
    plain = C.corpus(spark, sf_dir).select("doc_id", "path", "content")
    sealed = R.encrypt(plain, F.when(F.expr("doc_id % 4 = 0"), two).otherwise(one))
    mixed = sealed.withColumn("path", F.expr("if(doc_id % 10 = 1, original, path)"))
    done = R.opened(mixed, one)
    return done.select("path", F.coalesce("reason", F.lit("opened")).alias("status"), F.expr("if(reason IS NULL, md5(content), NULL)").alias("digest"))


def _labelled(spark, sf_dir, condition: str) -> DataFrame:
    marked = C.table(spark, sf_dir, "labels").filter(condition).select("doc_id").distinct()
    return C.inventory(spark, sf_dir).join(marked, "doc_id", "left_semi").select("path")


@query
def purge_files(spark, sf_dir):
    return R.purge(C.inventory(spark, sf_dir), _labelled(spark, sf_dir, "toxic = 1")).select("path", "size")


@query
def requested_files(spark, sf_dir):
    """Requests joined to the files they name."""
    asked = _labelled(spark, sf_dir, "quality = 0").withColumn("action", F.lit("redact"))
    return R.requested(C.inventory(spark, sf_dir), asked).select("path", "size", "action")


@query
def apply_overrides(spark, sf_dir):
    rows = audit_rows(spark, sf_dir)
    return R.apply_cleaned(rows, _labelled(spark, sf_dir, "quality = 0")).select("path", "severity", "cleaned")


@query
def cleaned_nodes(spark, sf_dir):
    rows = audit_rows(spark, sf_dir).withColumn("original_severity", F.col("severity"))
    marked = R.apply_cleaned(rows, _labelled(spark, sf_dir, "quality = 0 OR doc_id % 2 = 0"))
    return R.cleaned_nodes(marked, P.dirname(F.col("path")))


@query
def rename_paths(spark, sf_dir):
    base = C.inventory(spark, sf_dir).select("path", P.view_name(F.col("path")).alias("name"))
    moves = _labelled(spark, sf_dir, "quality = 1").select(
        F.col("path").alias("old_path"), F.concat("path", F.lit(".enc")).alias("new_path")
    )
    return R.rename_paths(base, moves)


@query
def rename_chains(spark, sf_dir):
    """Files encrypted, some decrypted again, some encrypted once more: cleaned ones stay cleaned under their last name."""
    inv = C.inventory(spark, sf_dir)
    cleaned = _labelled(spark, sf_dir, "quality = 1")
    sealed = F.concat("path", F.lit(".enc"))
    one, two = inv.filter("doc_id % 5 < 4"), inv.filter("doc_id % 5 < 3")
    moves = (
        one.select(F.col("path").alias("old_path"), sealed.alias("new_path"), F.expr("doc_id * 10 + 1").alias("ord"))
        .unionByName(two.select(sealed.alias("old_path"), F.col("path").alias("new_path"), F.expr("doc_id * 10 + 2").alias("ord")))
        .unionByName(inv.filter("doc_id % 5 < 2").select(F.col("path").alias("old_path"), F.concat("path", F.lit(".old")).alias("new_path"), F.expr("doc_id * 10 + 3").alias("ord")))
    )
    files = R.follow_renames(inv.select("path", P.view_name(F.col("path")).alias("name"), F.lit(2).alias("severity")), moves)
    return R.apply_cleaned(files, R.follow_renames(cleaned, moves))


@query
def redacted_versions(spark, sf_dir):
    """A table redacted, then purged: three versions, each as it was."""
    path = f"{scratch_dir(spark, 'versions')}"
    done = redacted(spark, sf_dir).select("path", "content", "replacements")
    versions.create(C.corpus(spark, sf_dir).select("path", "content"), path)
    versions.commit(done.filter("replacements > 0"), path)
    toxic = _labelled(spark, sf_dir, "toxic = 1")
    versions.commit(C.corpus(spark, sf_dir).select("path", "content").limit(0), path, toxic)
    held = [versions.read(spark, path, k).select(F.lit(k).alias("version"), "path", F.md5("content").alias("digest")) for k in range(versions.latest(spark, path) + 1)]
    return held[0].unionByName(held[1]).unionByName(held[2])


@query
def selected_files(spark, sf_dir):
    """Files of two overlapping selections: everything of one source, then all of one suffix."""
    inv = C.inventory(spark, sf_dir).select("path", "size")
    first = inv.filter("contains(path, '/src3/')").withColumn("selection_ord", F.lit(1))
    second = inv.filter("endswith(path, '.txt')").withColumn("selection_ord", F.lit(2))
    chosen = R.selected_files(first.unionByName(second), _labelled(spark, sf_dir, "toxic = 1"))
    return chosen.select("path", "size", "selection_ord")


@query
def remediation_eligibility(spark, sf_dir):
    inv = C.inventory(spark, sf_dir).withColumn("file_type", P.file_type(F.col("path")))
    named = inv.withColumn("path", F.expr("if(doc_id % 3 = 0, concat(path, '.enc'), path)"))
    return R.eligibility(named).select("path", "can_redact", "can_decrypt")


@query
def decrypt_rejection(spark, sf_dir):
    inv = C.inventory(spark, sf_dir)
    return R.decrypt_rejection(inv.select(F.expr("if(doc_id % 3 = 0, concat(path, '.enc'), path)").alias("path")))


def all_events(spark, sf_dir) -> DataFrame:
    inv = C.inventory(spark, sf_dir)
    sealed = inv.select(F.concat("path", F.lit(".enc")).alias("path"), F.col("path").alias("original"))
    opened = inv.select("path", F.concat("path", F.lit(".enc")).alias("encrypted_file"))
    return (
        R.redact_events(redacted(spark, sf_dir))
        .unionByName(R.encrypt_events(sealed))
        .unionByName(R.decrypt_events(opened))
        .unionByName(R.shred_events(inv))
    )


@query
def remediation_events(spark, sf_dir):
    return all_events(spark, sf_dir)


# ---- ledger ------------------------------------------------------------------------------------


@query
def ledger_history(spark, sf_dir):
    return L.history(C.ledger(spark, sf_dir), type="click", source="user-8", limit=100, offset=2)


@query
def ledger_where(spark, sf_dir):
    return L.where(C.ledger(spark, sf_dir), "type = ? AND id > ?", ["error", 50], limit=40, offset=5)


@query
def ledger_stats(spark, sf_dir):
    return L.query(
        C.ledger(spark, sf_dir),
        """SELECT type, count(*) AS n, count(DISTINCT source) AS sources, min(timestamp) AS first_at,
            max(int(get_json_object(payload, '$.k'))) AS top FROM ledger_entries GROUP BY type HAVING count(*) > ?""",
        [1],
    )


@query
def ledger_query_all(spark, sf_dir):
    """An aggregate with a group per user and hour comes back whole."""
    sql = "SELECT source, hour(timestamp) AS hour, count(*) AS n FROM ledger_entries GROUP BY source, hour(timestamp)"
    return L.query(C.ledger(spark, sf_dir), sql)


@query
def ledger_append(spark, sf_dir):
    """Two batches appended to a fresh ledger, ids continuing, keys of the payload sorted."""
    at = F.to_timestamp(F.lit("2024-06-01 12:00:00"))
    entries = C.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("type"),
        F.expr("concat('user-', user_id)").alias("source"),
        F.expr("""concat('{"z": ', event_id, ', "a": ', props, '}')""").alias("payload"),
    )
    path = scratch_dir(spark, "ledger")
    L.append(entries.filter("type <> 'error'"), path, at)
    L.append(entries.filter("type = 'error'"), path, at + F.expr("INTERVAL 1 HOUR"))
    return L.read(spark, path)


# ---- named entities ----------------------------------------------------------------------------


@query
def ner_chunks(spark, sf_dir):
    rows = N.chunks(C.planted(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "chunk_start", F.md5("chunk").alias("digest"), "before", "after")


@query
def ner_entities(spark, sf_dir):
    found = N.detect_entities(C.planted(spark, sf_dir), "doc_id", factory=word_length_model)
    return found.select("doc_id", "pii_type", "category", "start", "stop", "value", "confidence", F.md5("excerpt").alias("excerpt"))


@query
def ner_and_regex_summary(spark, sf_dir):
    """Both methods together, deduplicated, counted per type and method."""
    docs = C.planted(spark, sf_dir)
    columns = ["doc_id", "pii_type", "start", "stop", "value", "method", "confidence"]
    regex = D.explode_detections(D.detect(docs), "doc_id").select(*columns, F.lit(0).alias("method_ord"))
    model = N.detect_entities(docs, "doc_id", factory=word_length_model, excerpts=False).select(*columns, F.lit(1).alias("method_ord"))
    return D.dedupe_rows(regex.unionByName(model)).groupBy("pii_type", "method").agg(F.count("*").alias("n"))


def _classified(spark, sf_dir) -> DataFrame:
    return A.classified(C.planted(spark, sf_dir), "text", model=word_length_model)


@query
def classify_summary_both(spark, sf_dir):
    """Rules and model together, as one result a document."""
    found = D.summarize(_classified(spark, sf_dir), "doc_id", backend="model")
    return found.select(
        "doc_id",
        F.md5(joined("pii_types")).alias("pii_types"),
        joined("categories").alias("categories"),
        F.expr("size(confidence)").alias("n"),
        "backend",
    )


@query
def doc_score_both(spark, sf_dir):
    """Names, organizations and places weigh like other findings."""
    return S.score_types(_classified(spark, sf_dir), "detections.pii_type").select("doc_id", "raw_score", "score", "severity")


@query
def score_breakdown_both(spark, sf_dir):
    scored = A.scored_files(C.corpus(spark, sf_dir), C.as_of(), model=word_length_model)
    return scored.select("path", *SCORE_CATEGORIES, F.expr("aggregate(bonuses, 0, (a, b) -> a + b.weight)").alias("bonuses"), "raw_score", "severity")


@query
def audit_files_both(spark, sf_dir):
    """Audit rows whose declared types come from rules and model."""
    rows = A.audit(C.corpus(spark, sf_dir).select("path", "size", "content"), model=word_length_model)
    return flat(rows).drop("excerpt")


@query
def audit_custom_rules(spark, sf_dir):
    """Audit rows from the caller's own rules alone."""
    rows = A.audit(C.corpus(spark, sf_dir).select("path", "size", "content"), rules=CUSTOM[-2:])
    return rows.select("path", F.expr("array_join(filter(pii, t -> t IN ('badge', 'routing')), ',')").alias("own"))


# ---- streaming ---------------------------------------------------------------------------------

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query
def stream_detections(spark, sf_dir):
    """Documents arrive as a stream; detections leave through an exactly-once file sink."""
    arriving = T.stream_parquet(spark, f"{sf_dir}/documents.parquet", DOCUMENTS)
    path = scratch_dir(spark, "detections")
    T.to_parquet(D.explode_detections(D.detect(arriving, heuristics=False), "doc_id"), path)
    schema = "doc_id bigint, pii_type string, start int, stop int, value string"
    return spark.read.schema(schema).parquet(path)


@query
def stream_scan(spark, sf_dir):
    """The scan as a stream of events, start and complete included."""
    arriving = C.corpus_paths(T.stream_parquet(spark, f"{sf_dir}/documents.parquet", DOCUMENTS)).select("path", "size", "modified")
    log = T.scan_log(arriving, [C.ROOT], scratch_dir(spark, "scan"))
    return T.read_log(spark, log).select("seq", "event", "path", "kind", "outcome")


def _arrivals(spark, sf_dir, batches: int = 3) -> DataFrame:
    """The inventory in several batches, some files unreadable."""
    folder = scratch_dir(spark, "arrivals")
    inv = C.inventory(spark, sf_dir).withColumn("error", F.expr("if(doc_id % 9 = 4, 'denied', NULL)"))
    for k in range(batches):
        inv.filter(F.col("doc_id") % batches == k).drop("doc_id").coalesce(1).write.parquet(f"{folder}/batch={k}")
    return T.stream_table(spark, folder, "path string, size bigint, modified timestamp, error string, batch int", per_trigger=1)


@query
def stream_running_stats(spark, sf_dir):
    """Every event of a scan in three batches with its root's counters so far."""
    log = T.counted_log(_arrivals(spark, sf_dir), C.ROOTS, scratch_dir(spark, "counted"), max_depth=MAX_DEPTH, max_file_size_mb=20_000 / 1024 / 1024)
    return T.read_counted_log(spark, log)


@query
def stream_budget(spark, sf_dir):
    """A budget that three roots share over three batches, and its one event."""
    log = T.counted_log(_arrivals(spark, sf_dir), C.ROOTS, scratch_dir(spark, "counted"), max_files=100, max_depth=MAX_DEPTH)
    return T.read_counted_log(spark, log).select("seq", "event", "path", "root_ord", "total_files")


@query
def stream_path_dedupe(spark, sf_dir):
    """Every file arrives twice, from two tables of the stream; each path leaves once."""
    arriving = C.corpus_paths(T.stream_parquet(spark, f"{sf_dir}/documents.parquet", DOCUMENTS)).select("path", "modified")
    twice = arriving.withColumn("path", F.explode(F.array("path", "path")))
    path = scratch_dir(spark, "paths")
    T.to_parquet(T.new_paths(twice, "900 days").select("path"), path)
    return spark.read.schema("path string").parquet(path)


@query
def stream_old_files(spark, sf_dir):
    """A file far older than those before it still leaves when it arrives in a later batch."""
    folder = scratch_dir(spark, "arrivals")
    inv = C.inventory(spark, sf_dir).select("doc_id", "path", "modified")
    inv.filter("doc_id % 2 = 0").select("path", "modified").coalesce(1).write.parquet(f"{folder}/batch=1")
    old = inv.filter("doc_id % 2 = 1 OR doc_id % 10 = 0").select("path", F.expr("modified - INTERVAL 5000 DAYS").alias("modified"))
    old.coalesce(1).write.parquet(f"{folder}/batch=2")
    arriving = T.stream_table(spark, folder, "path string, modified timestamp, batch int", per_trigger=1)
    path = scratch_dir(spark, "paths")
    T.to_parquet(T.new_paths(arriving, "1 day").select("path"), path)
    return spark.read.schema("path string").parquet(path)


@query
def stream_counters(spark, sf_dir):
    """Running counts per outcome, kept in the state store; the last update is the answer."""
    arriving = C.corpus_paths(T.stream_parquet(spark, f"{sf_dir}/documents.parquet", DOCUMENTS)).select("path", "size", "modified")
    path = scratch_dir(spark, "counts")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    counted = T.counters(T.scan_events(arriving, [C.ROOT]), "event", "outcome")
    # A stream without files has no batch: no rows then.
    write(spark.createDataFrame([], counted.schema), -1)
    T.run_available(counted, write, "complete")
    return spark.read.schema(counted.schema).parquet(path)


@query
def stream_ledger(spark, sf_dir):
    """Ledger entries appended live, partitioned by type."""
    arriving = T.stream_parquet(spark, f"{sf_dir}/events.parquet", EVENTS)
    entries = arriving.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("type"),
        F.expr("concat('user-', user_id)").alias("source"),
        L.canonical_json(F.col("props")).alias("payload"),
        F.lit("{}").alias("metadata"),
    )
    path = scratch_dir(spark, "stream-ledger")
    T.to_parquet(entries, path, ["type"])
    return L.read(spark, path)
