"""The SQL each query is checked against: the same answers from window functions and list functions.

The checking engine's patterns know only ASCII classes, so texts are matched on a copy in which every
other character is replaced by ``_`` (a word character, same length); values are then cut from the
original text by position.
"""

from __future__ import annotations

from riskloom.catalog import (
    BONUS_LOCATIONS,
    CHAT_NAME_MARKERS,
    CONFIG_NAME_MARKERS,
    HIGH_RISK_LOCATIONS,
    MEDIUM_RISK_LOCATIONS,
    RULES,
    SCORE_CATEGORIES,
    SKIPPED_EXTENSIONS,
    VIEW_CATEGORIES,
    VIEW_PATTERNS,
    TOP_N_FILES,
    WEIGHT_BY_TYPE,
    CATEGORY_BY_TYPE,
)
from riskloom.plans.corpus import MARKED, NAMES, PLANTED, ROOT, ROOTS, SUFFIXES, TOPS

ORACLE: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _map(values: dict) -> str:
    keys = _list(values)
    return f"MAP({keys}, [{', '.join(_text(v) if isinstance(v, str) else str(v) for v in values.values())}])"


def _cases(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_text(w)})" for w in words) + ")"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


NL = "chr(10)"
PLANT = f"planted AS (SELECT doc_id, text || {NL} || {_list(PLANTED)}[doc_id % 16 + 1] AS text, lang, source, n_chars FROM documents)"


def _sub(text: str, pattern: str, skip: int = 0, group: str | None = None) -> tuple[str, str, int, str | None]:
    return text, pattern, skip, group


def _patterns() -> list[tuple[str, str, int, str]]:
    """Type, pattern, characters before the value and the length expression of the value."""
    found = []
    for rule in RULES:
        if rule.pii_type == "BankAccount":
            # The half with look-around becomes a plain pattern whose value is its first group.
            found.append((rule.pii_type, rule.pattern.split("|(?<=")[0], 0, "len(v)"))
            found.append((rule.pii_type, r",\d{8,18},[A-Z]{4}0[A-Z0-9]{6}\b", 1, r"len(regexp_extract(v, '^,(\d+),', 1))"))
        else:
            found.append((rule.pii_type, rule.pattern, 0, "len(v)"))
    return found


def _hits(texts: str, key: str, text: str) -> list[str]:
    """CTEs ``masked`` and ``hits(key, text, pii_type, start, stop, value)`` over a table of texts."""
    masked = rf"masked AS (SELECT {key}, {text} AS text, regexp_replace({text}, '[^\x00-\x7F]', '_', 'g') AS m FROM {texts})"
    arms = " UNION ALL ".join(
        f"""SELECT {key}, pii_type, pos + {skip} AS start, pos + {skip} + {size} AS stop FROM (
            SELECT {key}, {_text(name)} AS pii_type, unnest(v) AS v, unnest(list_transform(range(1, len(v) + 1),
                lambda i: list_sum(list_transform(g[1:i], lambda x: len(x)))
                    + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: len(x))), 0))) AS pos
            FROM (SELECT {key}, regexp_extract_all(m, {_text('(?i)' + pattern)}) AS v,
                string_split_regex(m, {_text('(?i)' + pattern)}) AS g FROM masked) WHERE len(v) > 0)"""
        for name, pattern, skip, size in _patterns()
    )
    spans = f"spans AS ({arms})"
    hits = f"""hits AS MATERIALIZED (SELECT s.{key}, m.text, s.pii_type, s.start::INT AS start, s.stop::INT AS stop,
        substr(m.text, s.start::BIGINT + 1, (s.stop - s.start)::BIGINT) AS value
        FROM spans s JOIN masked m ON s.{key} = m.{key})"""
    return [masked, spans, hits]


def _noise(line: str) -> str:
    return rf"""(regexp_matches({line}, '^\s*!') OR contains({line}, '##') OR contains({line}, '#$')
        OR regexp_matches({line}, '(?i)http|www\.') OR len({line}) - len(replace({line}, '.', '')) >= 2
        OR len(regexp_replace({line}, '[\p{{L}}\p{{N}}\s]', '', 'g')) >= 6
        OR (len(regexp_extract_all({line}, '\d')) * 2 > len({line}) AND NOT regexp_matches({line}, '\p{{L}}')))"""


def _csv(line: str) -> str:
    return rf"""(len({line}) - len(replace({line}, ',', '')) >= 3 AND regexp_matches({line}, '(?i)\b[A-Z]{{4}}0[A-Z0-9]{{6}}\b'))"""


def _kept(key: str) -> list[str]:
    lined = f"""lined AS (SELECT *, string_split(substr(text, 1, start), {NL})[-1] || value
        || string_split(substr(text, stop + 1), {NL})[1] AS line,
        CASE WHEN start = 0 THEN '' ELSE substr(text, start, 1) END AS before FROM hits)"""
    kept = f"""kept AS MATERIALIZED (SELECT * FROM lined WHERE NOT CASE WHEN pii_type = 'Aadhaar' THEN {_csv('line')}
        WHEN pii_type = 'Phone' THEN {_csv('line')} AND before <> '+' ELSE {_noise('line')} END)"""
    return [lined, kept]


def _category(column: str) -> str:
    return f"coalesce({_map(CATEGORY_BY_TYPE)}[{column}], 'other')"


def _weight(column: str) -> str:
    return f"coalesce({_map(WEIGHT_BY_TYPE)}[{column}], 5)"


RAW = [PLANT, *_hits("planted", "doc_id", "text")]
KEPT = [*RAW, *_kept("doc_id")]
EXCERPT = "substr(text, greatest(start - 50, 0) + 1, least(stop + 50, len(text)) - greatest(start - 50, 0))"

ORACLE["pii_raw_counts"] = _with(*RAW) + "SELECT pii_type, count(*) AS hits FROM hits GROUP BY pii_type"
ORACLE["pii_positions"] = _with(*RAW) + "SELECT doc_id, pii_type, start, stop, value FROM hits"
ORACLE["pii_kept"] = _with(*KEPT) + f"SELECT doc_id, pii_type, {_category('pii_type')} AS category, start, stop, value FROM kept"
ORACLE["pii_excerpts"] = _with(*RAW) + f"SELECT doc_id, pii_type, start, {EXCERPT} AS excerpt FROM hits"
ORACLE["pii_doc_summary"] = _with(*KEPT) + f"""SELECT p.doc_id, coalesce(s.pii_types, '') AS pii_types,
    coalesce(s.categories, '') AS categories, coalesce(s.n, 0)::INT AS n, 'regex' AS backend
    FROM planted p LEFT JOIN (SELECT doc_id, string_agg(pii_type, ',' ORDER BY start, pii_type) AS pii_types,
        array_to_string(list_sort(list_distinct(list({_category('pii_type')}))), ',') AS categories, count(*) AS n
        FROM kept GROUP BY doc_id) s ON p.doc_id = s.doc_id"""


def _presence(text: str) -> str:
    flags = ", ".join(f"CASE WHEN regexp_matches({text}, {_text(p)}) THEN {_text(n)} END" for n, p in VIEW_PATTERNS)
    return f"list_filter([{flags}], lambda t: t IS NOT NULL)"


ORACLE["pii_presence_view"] = _with(PLANT) + f"SELECT doc_id, array_to_string({_presence('text')}, ',') AS types FROM planted"

_ORIGINS = """texts AS (SELECT row_number() OVER () AS k, * FROM (SELECT 'documents' AS origin, text AS body FROM documents
    UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'conversations', text FROM conversations))"""
ORACLE["pii_natural_sources"] = _with(
    _ORIGINS.replace("texts AS (", "texts AS MATERIALIZED ("), *_hits("texts", "k", "body"), *_kept("k")
) + """SELECT t.origin, h.pii_type, count(*) AS hits, sum(CASE WHEN EXISTS (SELECT 1 FROM kept q
        WHERE q.k = h.k AND q.pii_type = h.pii_type AND q.start = h.start) THEN 1 ELSE 0 END)::BIGINT AS kept
    FROM hits h JOIN texts t ON h.k = t.k GROUP BY t.origin, h.pii_type"""

ORACLE["pii_dedupe"] = _with(*RAW) + """SELECT doc_id, pii_type, start, stop, method, value FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, pii_type, lower(value), start, stop ORDER BY confidence DESC, ord) AS rn
    FROM (SELECT doc_id, pii_type, start, stop, value, 'regex' AS method, 0.95 AS confidence, 0 AS ord FROM hits
        UNION ALL SELECT doc_id, pii_type, start, stop, upper(value), 'ner', [0.9, 0.95, 0.99][start % 3 + 1], 1 FROM hits))
    WHERE rn = 1"""
ORACLE["line_noise"] = _with(PLANT) + f"""SELECT doc_id, count(*)::INT AS lines, count(*) FILTER ({_noise('l')})::INT AS noise,
    count(*) FILTER ({_csv('l')})::INT AS csv
    FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS l FROM planted) GROUP BY doc_id"""

# ---- score

SEVERITY = "CASE WHEN {0} >= 70 THEN 'orange' WHEN {0} >= 30 THEN 'yellow' ELSE 'green' END"
SCORED = f"""scored AS (SELECT p.doc_id, coalesce(sum({_weight('k.pii_type')}) FILTER (k.pii_type IS NOT NULL), 0)::INT AS raw_score
    FROM planted p LEFT JOIN kept k ON p.doc_id = k.doc_id GROUP BY p.doc_id)"""
ORACLE["doc_score"] = _with(*KEPT, SCORED) + f"""SELECT doc_id, raw_score, least(raw_score, 100) AS score,
    {SEVERITY.format('least(raw_score, 100)')} AS severity FROM scored"""
ORACLE["score_in_row"] = _with(*KEPT) + "SELECT p.doc_id, " + ", ".join(
    f"coalesce(sum({_weight('k.pii_type')}) FILTER ({_category('k.pii_type')} = '{c}' AND k.pii_type IS NOT NULL), 0)::INT AS {c}"
    for c in SCORE_CATEGORIES
) + " FROM planted p LEFT JOIN kept k ON p.doc_id = k.doc_id GROUP BY p.doc_id"
ORACLE["score_weights"] = _with(*KEPT) + f"""SELECT pii_type, {_category('pii_type')} AS category, count(*) AS n,
    sum({_weight('pii_type')})::BIGINT AS weight FROM kept GROUP BY pii_type"""

CORPUS = f"""corpus AS (SELECT doc_id, '{ROOT}/' || {_list(TOPS)}[substr(source, 4)::INT % 5 + 1] || '/' || source || '/' || lang || '/'
    || repeat('sub/', ((doc_id // 7) % 6)::INT) || 'doc_' || doc_id || {_list(SUFFIXES)}[(doc_id // 16) % 8 + 1] AS path,
    n_chars AS size, TIMESTAMP '2024-06-01' - to_days((doc_id % 800)::INT) AS modified, text AS content FROM planted)"""
BASE = [PLANT, CORPUS]
PLACE = _any("lower(path)", BONUS_LOCATIONS)
OLD = "epoch(TIMESTAMP '2024-06-01') - epoch(modified) > 31536000"
PARTS = ", ".join(
    f"coalesce(sum({_weight('k.pii_type')}) FILTER ({_category('k.pii_type')} = '{c}' AND k.pii_type IS NOT NULL), 0)::BIGINT AS {c}"
    for c in SCORE_CATEGORIES
)
ORACLE["score_breakdown"] = _with(*KEPT, CORPUS, f"""parts AS (SELECT p.doc_id, {PARTS}
    FROM planted p LEFT JOIN kept k ON p.doc_id = k.doc_id GROUP BY p.doc_id)""", f"""summed AS (SELECT path, {', '.join(SCORE_CATEGORIES)},
    ((CASE WHEN {PLACE} THEN 2 ELSE 0 END) + (CASE WHEN {OLD} THEN 2 ELSE 0 END))::BIGINT AS bonuses
    FROM parts JOIN corpus USING (doc_id))""", f"""totals AS (SELECT *, {' + '.join(SCORE_CATEGORIES)} + bonuses AS raw_score FROM summed)""") + f"""
    SELECT *, least(raw_score, 100) AS score, {SEVERITY.format('least(raw_score, 100)')} AS severity FROM totals"""
ORACLE["score_bonuses"] = _with(*BASE) + f"""SELECT path, array_to_string(list_filter([
        CASE WHEN {PLACE} THEN 'sensitive_location' END,
        CASE WHEN {OLD} AND doc_id % 3 <> 0 THEN 'old_unencrypted_file' END], lambda x: x IS NOT NULL), ',') AS reasons,
    (CASE WHEN {PLACE} THEN 2 ELSE 0 END + CASE WHEN {OLD} AND doc_id % 3 <> 0 THEN 2 ELSE 0 END)::INT AS weight FROM corpus"""
ORACLE["score_shapes"] = _with(*KEPT, SCORED) + f"""SELECT doc_id, raw, {SEVERITY.format('least(raw, 100)')} AS severity FROM (
    SELECT doc_id, (CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 13 ELSE raw_score END)::INT AS raw FROM scored)"""
ORACLE["score_shapes"] = ORACLE["score_shapes"].replace("SELECT doc_id, raw, CASE", "SELECT doc_id, raw AS raw_score, CASE")

# ---- inventory

NAME = "regexp_extract(path, '[^/]*$')"
EXT = rf"lower(regexp_extract({NAME}, '^\.*[^.].*(\.[^.]*)$', 1))"
CHAT = f"({EXT} IN ('.txt', '.json') AND {_any(f'lower({NAME})', CHAT_NAME_MARKERS)})"
KIND = _cases(
    [
        (CHAT, "'chat'"),
        (f"{EXT} = '.pdf'", "'pdf'"),
        (f"{EXT} IN ('.csv', '.xlsx')", "'csv'"),
        (f"{EXT} = '.json'", "'json'"),
        (f"{EXT} = '.db' OR contains(lower(path), 'sqlite')", "'db'"),
        (f"{EXT} IN ('.txt', '.log', '.csv', '.local', '.env') OR {_any(f'lower({NAME})', CONFIG_NAME_MARKERS)}", "'text'"),
    ],
    "NULL",
)
FILE_TYPE = _cases(
    [
        (CHAT, "'chat_log'"),
        (f"{EXT} = '.pdf'", "'pdf'"),
        (f"{EXT} IN ('.csv', '.xlsx')", "'spreadsheet'"),
        (f"{EXT} = '.json'", "'json'"),
        ("contains(lower(path), 'chrome') OR contains(lower(path), 'firefox')", "'browser_db'"),
    ],
    "'text'",
)


def _visited(roots, limit: str = "26214400", depth: int = 5) -> list[str]:
    pairs = []
    for i, root in enumerate(roots):
        dirs = f"regexp_extract(substr(path, {len(root) + 2}), '^(.*/)?[^/]*$', 1)"
        pairs.append(
            (
                rf"starts_with(path, '{root}/') AND NOT regexp_matches({dirs}, '(^|/)\.') AND len({dirs}) - len(replace({dirs}, '/', '')) <= {depth}",
                str(i),
            )
        )
    skipped = f"{EXT} IN ({', '.join(_text(e) for e in SKIPPED_EXTENSIONS)})"
    outcome = _cases([(skipped, "'skipped'"), (f"size > {limit}", "'large'"), (f"({KIND}) IS NULL", "'unsupported'")], "'read'")
    return [
        f"reached AS (SELECT *, {_cases(pairs, 'NULL')} AS root_ord FROM corpus)",
        f"""visited AS MATERIALIZED (SELECT *, CASE WHEN outcome = 'read' THEN {KIND} END AS kind FROM (
            SELECT *, {outcome} AS outcome FROM reached WHERE root_ord IS NOT NULL))""",
    ]


SMALL = "20000"
ORACLE["scan_inventory"] = _with(*BASE, *_visited([ROOT], SMALL)) + f"SELECT path, outcome, kind, {FILE_TYPE} AS file_type FROM visited"
FLAGS = {
    "total_files": "true",
    "text_files": "kind = 'text'",
    "pdfs": "kind = 'pdf'",
    "csvs": "kind = 'csv'",
    "dbs": "kind = 'db'",
    "chats": "kind = 'chat'",
    "skipped_large_files": "outcome = 'large'",
}
COUNTS = ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in FLAGS.items())
ORACLE["scan_stats"] = _with(*BASE, *_visited(ROOTS, SMALL)) + f"""SELECT root_ord, {COUNTS}, 0::BIGINT AS permission_errors,
    (CASE WHEN root_ord IS NULL THEN {len(ROOTS)} ELSE 1 END)::BIGINT AS paths_scanned FROM visited GROUP BY ROLLUP (root_ord)"""
ORACLE["scan_unbounded"] = _with(*BASE) + f"""SELECT CASE WHEN contains(full_path, 's3a://bucket/home/u/Downloads/') THEN 0
    WHEN contains(path, '/home/u/Documents/') THEN 1 ELSE 2 END AS root_ord, full_path AS path, outcome,
    CASE WHEN outcome IN ('read', 'unsupported') THEN {KIND} END AS kind FROM (
        SELECT *, (CASE WHEN doc_id % 2 = 0 THEN 'hdfs://nn:8020' ELSE 's3a://bucket' END) || path AS full_path,
            CASE WHEN {EXT} IN ({', '.join(_text(e) for e in SKIPPED_EXTENSIONS)}) THEN 'skipped'
                WHEN ({KIND}) IS NULL THEN 'unsupported' ELSE 'read' END AS outcome
        FROM corpus WHERE NOT contains(path, '/.'))"""
ORACLE["scan_errors"] = _with(*BASE) + "SELECT path, 'denied: ' || path AS error FROM corpus WHERE doc_id % 9 = 4 AND NOT contains(path, '/.')"
ORACLE["scan_error_stats"] = _with(*BASE) + """, seen AS (SELECT count(*) AS total_files, count(*) FILTER (doc_id % 9 = 4) AS permission_errors
        FROM corpus WHERE NOT contains(path, '/.'))
    SELECT 0 AS root_ord, total_files, permission_errors, 1::BIGINT AS paths_scanned FROM seen
    UNION ALL SELECT 1, 0, 0, 1 UNION ALL SELECT NULL, total_files, permission_errors, 2 FROM seen"""
ORACLE["score_custom_rules"] = _with(PLANT, """parts AS (SELECT doc_id, 30 * len(regexp_extract_all(text, '(?i)EMP[0-9]')) AS identity,
        7 * len(regexp_extract_all(text, '(?i)KVBL0')) AS financial FROM planted)""") + """SELECT form, doc_id, identity + financial AS raw_score,
    identity, financial, 0 AS other FROM parts, (VALUES ('row'), ('long')) AS forms(form) WHERE identity + financial > 0"""
ORACLE["scan_budget"] = _with(*BASE, *_visited(ROOTS)) + "SELECT root_ord, path FROM visited ORDER BY root_ord, path LIMIT 300"
ORACLE["multi_root_merge"] = _with(*BASE, *_visited(ROOTS)) + "SELECT root_ord, path, size FROM visited"
ORACLE["unique_paths"] = _with(*BASE) + "SELECT path, size, 0 AS root_ord FROM corpus"
RUNNING = ", ".join(
    f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) OVER (ORDER BY root_ord, path ROWS UNBOUNDED PRECEDING)::BIGINT AS {n}" for n, c in FLAGS.items()
)
ORACLE["running_stats"] = _with(*BASE, *_visited(ROOTS, SMALL)) + f"SELECT root_ord, path, {RUNNING} FROM visited"
SPLIT = "SELECT * REPLACE (modified + to_microseconds(doc_id % 7 * 250001) AS modified) FROM corpus"
ORACLE["file_metadata"] = _with(*BASE) + f"""SELECT path, {NAME} AS filename, {EXT} AS extension,
    regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, epoch_us(modified) / 1000000 AS modified_unix,
    strftime(modified, '%Y-%m-%dT%H:%M:%S') || CASE WHEN doc_id % 7 = 0 THEN '' ELSE strftime(modified, '.%f') END || '+00:00' AS modified_iso,
    greatest(0, floor((epoch(TIMESTAMP '2024-06-01') - epoch(modified)) / 86400))::INT AS age_days,
    CASE WHEN {_any('lower(path)', HIGH_RISK_LOCATIONS)} THEN 'high' WHEN {_any('lower(path)', MEDIUM_RISK_LOCATIONS)} THEN 'medium'
        ELSE 'low' END AS location_risk FROM ({SPLIT})"""
ORACLE["planted_names"] = f"""WITH corpus AS (SELECT doc_id, '{ROOT}/' || source || '/d' || doc_id || '/' || {_list(MARKED)}[doc_id % {len(MARKED)} + 1] AS path FROM documents),
    told AS (SELECT path, CASE WHEN {EXT} IN ({', '.join(_text(e) for e in SKIPPED_EXTENSIONS)}) THEN 'skipped' WHEN ({KIND}) IS NULL THEN 'unsupported' ELSE 'read' END AS outcome FROM corpus)
    SELECT path, outcome, CASE WHEN outcome = 'read' THEN {KIND} END AS kind, {FILE_TYPE} AS file_type, {CHAT} AS chat_name,
        {_any(f'lower({NAME})', CONFIG_NAME_MARKERS)} AS config_name, ends_with(path, '.enc') AS can_decrypt FROM told"""

# ---- extraction

ORACLE["extract_text"] = _with(*BASE, *_visited([ROOT])) + rf"""SELECT path, kind, len(c)::INT AS chars, md5(c) AS digest FROM (
    SELECT path, kind, CASE WHEN kind = 'json' THEN CASE WHEN json_valid(content) THEN json(content)::VARCHAR END
        WHEN kind = 'csv' THEN regexp_replace(content, '\n+$', '') ELSE content END AS c
    FROM visited WHERE kind IS NOT NULL AND kind <> 'db') WHERE len(c) > 0"""
ORACLE["extract_bounded"] = _with(*BASE, *_visited([ROOT])) + rf"""SELECT path, kind, md5(left(c, 300)) AS digest FROM (
    SELECT path, kind, CASE WHEN kind = 'json' THEN CASE WHEN json_valid(content) THEN json(content)::VARCHAR END
        WHEN kind = 'csv' THEN array_to_string(string_split(regexp_replace(content, '\n+$', ''), {NL})[1:2], {NL}) ELSE content END AS c
    FROM visited WHERE kind IS NOT NULL AND kind <> 'db') WHERE len(c) > 0"""
ORACLE["scan_tree"] = _with(*RAW) + """SELECT source, lang, pii_type, count(*) AS hits
    FROM hits JOIN documents USING (doc_id) GROUP BY source, lang, pii_type"""
TREE = f"""tree AS (SELECT doc_id, text, doc_id % 6 AS k, '/' || source || '/' || lang || '/d' || doc_id || '/' || {_list(NAMES)}[doc_id % 6 + 1] AS path
    FROM planted WHERE doc_id % 6 <> 5)"""
ORACLE["scan_tree_complete"] = _with(PLANT, TREE) + """SELECT path, CASE WHEN k IN (3, 4) THEN 0 ELSE strlen(text) END AS size,
    CASE WHEN k = 4 THEN 'error' ELSE 'read' END AS outcome, CASE WHEN k <> 4 THEN 'text' END AS kind, CASE WHEN k < 3 THEN md5(text) END AS digest FROM tree"""
ORACLE["scan_tree_errors"] = _with(PLANT, TREE) + """SELECT path, 'FileNotFoundError' AS error FROM tree WHERE k = 4
    UNION ALL SELECT '-missing', 'FileNotFoundError'"""
ORACLE["scan_tree_stats"] = _with(PLANT, TREE, """counted AS (SELECT count(*) AS total_files, count(*) FILTER (k <> 4) AS text_files, count(*) FILTER (k = 4) AS bad FROM tree)""") + """
    SELECT 0 AS root_ord, total_files, text_files, bad AS permission_errors, 1::BIGINT AS paths_scanned FROM counted
    UNION ALL SELECT 1, 0, 0, 1, 1 UNION ALL SELECT NULL, total_files, text_files, bad + 1, 2 FROM counted"""
ORACLE["json_extract"] = """SELECT event_id, '{"attrs":' || json(props)::VARCHAR || ',"type":"' || event_type || '","user":' || user_id || '}' AS content
    FROM events WHERE event_id % 10 <> 0"""
ORACLE["csv_records_fields"] = _with(PLANT) + f"""SELECT doc_id, 3::INT AS records, 3::INT AS fields, md5(text) AS body, 'a "b", c' AS last,
    md5('id,body,n' || {NL} || doc_id || ',"' || replace(text, '"', '""') || '",1') AS first FROM planted"""
ORACLE["csv_extract"] = _with(PLANT) + rf"""SELECT doc_id, md5(t) AS digest, len(string_split(t, {NL}))::INT AS lines
    FROM (SELECT doc_id, regexp_replace(text, '\n+$', '') AS t FROM planted)"""
MESSAGES = """messages AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE role END AS f,
    CASE WHEN turn % 5 = 4 AND conv_id % 2 = 0 THEN 'user' || conv_id ELSE '' END AS fid,
    '2024-01-' || lpad((1 + turn % 28)::VARCHAR, 2, '0') AS date,
    CASE WHEN (conv_id + turn) % 11 = 10 THEN '  ' ELSE text END AS text FROM conversations)"""
LINES = """lines AS (SELECT conv_id, turn, s AS sender, date || ' ' || s || ': ' || text AS line, text, date FROM (
    SELECT *, CASE WHEN f <> '' THEN f WHEN fid <> '' THEN fid ELSE 'unknown' END AS s FROM messages) WHERE trim(text) <> '')"""
SENDERS = "array_to_string(list_sort(list_distinct(list({0})))[1:10], ',')"
ORACLE["chat_lines"] = _with(MESSAGES, LINES) + "SELECT conv_id, turn, sender, line FROM lines"
ORACLE["chat_metadata"] = _with(MESSAGES, LINES) + f"""SELECT conv_id, count(*) AS message_count,
    count(DISTINCT sender) AS participant_count, {SENDERS.format('sender')} AS participants FROM lines GROUP BY conv_id"""
ORACLE["chat_documents"] = _with(MESSAGES, LINES) + f"""SELECT conv_id, turn // 3 AS part, count(*) AS messages,
    string_agg(line, {NL} ORDER BY turn) AS content FROM lines GROUP BY conv_id, turn // 3"""
HEADER = r"^(?:\[\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?\]\s*|\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)?\s+-\s*)([^:]+):\s*(.*)$"
ORACLE["whatsapp_messages"] = f"""WITH raw AS (SELECT conv_id, turn // 500 AS part, string_agg(CASE WHEN conv_id % 7 = 6 THEN text ELSE
        CASE WHEN turn % 2 = 0 THEN '12/01/2025, 10:30 AM - ' ELSE '[12/01/25, 10:31:05] ' END
        || upper(role[1]) || role[2:] || ': ' || text END, {NL} ORDER BY turn) AS t FROM conversations GROUP BY conv_id, turn // 500),
    split AS (SELECT conv_id, part, unnest(string_split(t, {NL})) AS l, generate_subscripts(string_split(t, {NL}), 1) AS i FROM raw),
    flagged AS (SELECT *, trim(l) AS s, regexp_matches(trim(l), {_text(HEADER)}) AS h FROM split),
    numbered AS (SELECT *, sum(h::INT) OVER (PARTITION BY conv_id, part ORDER BY i ROWS UNBOUNDED PRECEDING) AS m FROM flagged),
    glued AS (SELECT conv_id, part, m, max(CASE WHEN h THEN trim(regexp_extract(s, {_text(HEADER)}, 1)) END) AS sender,
        max(CASE WHEN h THEN trim(regexp_extract(s, {_text(HEADER)}, 1)) || ': ' || trim(regexp_extract(s, {_text(HEADER)}, 2)) END)
        || coalesce(string_agg(CASE WHEN NOT h AND s <> '' THEN ' ' || s END, '' ORDER BY i), '') AS line
        FROM numbered WHERE m > 0 GROUP BY conv_id, part, m),
    whole AS (SELECT conv_id, part, count(*) AS n, count(DISTINCT sender) AS p, {SENDERS.format('sender')} AS who,
        string_agg(line, {NL} ORDER BY m) AS c FROM glued GROUP BY conv_id, part)
    SELECT '/chats/whatsapp chat ' || r.conv_id || '-' || r.part || '.txt' AS path, 'whatsapp' AS chat_platform,
        coalesce(n, 0)::INT AS chat_message_count, coalesce(p, 0)::INT AS chat_participant_count,
        coalesce(who, '') AS participants, md5(coalesce(c, t)) AS digest
    FROM raw r LEFT JOIN whole w ON r.conv_id = w.conv_id AND r.part = w.part"""
ORACLE["telegram_messages"] = _with(MESSAGES.replace("ELSE text END AS text", "ELSE text END AS body"), """marked AS (SELECT *,
        CASE WHEN turn % 2 = 0 THEN body || '!' ELSE body END AS text FROM messages)""", LINES.replace("FROM messages)", "FROM marked)")) + f"""
    SELECT '/chats/whatsapp chat ' || c.conv_id || '-' || c.part || '.json' AS path, 'telegram' AS chat_platform,
        coalesce(n, 0)::INT AS chat_message_count, coalesce(p, 0)::INT AS chat_participant_count,
        coalesce(who, '') AS participants, md5(coalesce(t, '')) AS digest
    FROM (SELECT DISTINCT conv_id, turn // 500 AS part FROM conversations) c LEFT JOIN (
        SELECT conv_id, turn // 500 AS part, count(*) AS n, count(DISTINCT sender) AS p, {SENDERS.format('sender')} AS who,
            string_agg(line, {NL} ORDER BY turn) AS t FROM lines GROUP BY conv_id, turn // 500) w
        ON c.conv_id = w.conv_id AND c.part = w.part"""
ORACLE["chat_parse_errors"] = f"""SELECT path, chat_platform, CASE WHEN k < 2 THEN NULL WHEN k = 2 THEN 0 ELSE chat_message_count END AS chat_message_count,
    CASE WHEN k < 2 THEN NULL WHEN k = 2 THEN 0 ELSE chat_participant_count END AS chat_participant_count,
    CASE k WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no list of messages' END AS chat_parse_error
    FROM (SELECT *, regexp_extract(path, 'chat ([0-9]+)-', 1)::BIGINT % 4 AS k FROM ({ORACLE['telegram_messages']}))"""
ORACLE["table_blocks"] = """WITH given AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS customer, * FROM orders),
    lined AS (SELECT customer, '(' || concat_ws(', ', coalesce(customer::VARCHAR, 'NULL'), o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority) || ')' AS line FROM given),
    sized AS (SELECT *, strlen(line) + 2 AS w FROM lined),
    placed AS (SELECT *, row_number() OVER o AS n, sum(w) OVER (o ROWS UNBOUNDED PRECEDING) AS stop FROM sized WINDOW o AS (ORDER BY customer NULLS FIRST, line))
    SELECT 'orders' AS table_name, min(n) AS first_row, count(*) AS row_count, sum(w)::BIGINT AS size,
        md5(chr(10) || '--- orders ---' || chr(10) || '[' || string_agg(line, ', ' ORDER BY n) || ']') AS digest
    FROM placed GROUP BY (stop - w) // 2048, (stop - 1) // 2048, (n - 1) // 50"""
_DUMP = """SELECT '{0}' AS table_name, {1} // 50 AS block, count(*) AS row_count, md5(chr(10) || '--- {0} ---' || chr(10) || '['
    || string_agg('(' || concat_ws(', ', {2}) || ')', ', ' ORDER BY {1}) || ']') AS digest FROM {0} GROUP BY {1} // 50"""
ORACLE["table_text_dump"] = " UNION ALL ".join(
    [
        _DUMP.format("customer", "c_custkey", "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"),
        _DUMP.format("supplier", "s_suppkey", "s_suppkey, s_name, s_nationkey, s_acctbal"),
        _DUMP.format("part", "p_partkey", "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"),
    ]
)

# ---- audit view


def _stable(value: str) -> str:
    units = f"""flatten(list_transform(string_split(coalesce(nullif({value}, ''), 'unknown'), ''), lambda c:
        CASE WHEN ord(c) < 65536 THEN [ord(c)::BIGINT]
        ELSE [(55296 + (ord(c) - 65536) // 1024)::BIGINT, (56320 + (ord(c) - 65536) % 1024)::BIGINT] END))"""
    h = f"list_reduce({units}, lambda h, c: (h * 31 + c) & 4294967295::BIGINT, 0::BIGINT)"
    return f"(SELECT 'node-' || lower(to_base(abs(CASE WHEN z >= 2147483648 THEN z - 4294967296 ELSE z END), 36)) FROM (SELECT {h} AS z))"


SEVERE = "password|secret|token|key|credit_card|card|ssn|aadhaar|pan|iban|account"
VIEW_SEVERITY = (
    "CASE WHEN len(list_filter({0}, lambda t: regexp_matches(t, '" + SEVERE + "'))) > 0 THEN 3 "
    "WHEN len({0}) >= 3 OR len(list_filter({0}, lambda t: regexp_matches(t, 'medical|patient|passport|phone'))) > 0 THEN 2 "
    "WHEN len({0}) >= 1 THEN 1 ELSE 0 END"
)


def _view_category(types: str, kind: str) -> str:
    pairs = [
        (f"len(list_filter({types}, lambda t: regexp_matches(t, '{'|'.join(words)}'))) > 0", _text(name)) for name, words in VIEW_CATEGORIES
    ]
    pairs += [(f"{kind} = 'browser_db'", "'credentials'"), (f"{kind} = 'spreadsheet'", "'financial'"), (f"{kind} = 'pdf'", "'identity'")]
    return _cases(pairs, "'uncategorized'")


AUDIT = [
    *BASE,
    f"typed AS (SELECT *, {FILE_TYPE} AS file_type, ({_presence('content')}) AS present FROM corpus)",
    f"""audit AS MATERIALIZED (SELECT {_stable('path')} AS id, {NAME} AS name, path, greatest(1, size) AS value,
        ({VIEW_SEVERITY.format('present')})::INT AS severity, array_to_string(present, ',') AS pii,
        array_to_string(present[1:3], ',') AS top_pii, left(content, 220) AS excerpt,
        {_view_category('present', 'file_type')} AS category, file_type FROM typed)""",
]
ORACLE["audit_files"] = _with(*AUDIT) + "SELECT * FROM audit"
ORACLE["audit_files_declared"] = _with(
    *KEPT,
    CORPUS,
    """declared AS (SELECT c.doc_id, c.path, c.content, c.size, coalesce(d.ds, []) AS ds FROM corpus c LEFT JOIN (
        SELECT doc_id, list(t ORDER BY start, p) AS ds FROM (SELECT doc_id, lower(pii_type) AS t, min(start) AS start,
            arg_min(pii_type, (start, pii_type)) AS p FROM kept GROUP BY doc_id, lower(pii_type)) GROUP BY doc_id) d ON c.doc_id = d.doc_id)""",
    f"present AS (SELECT *, {_presence('content')} AS ps FROM declared)",
    "merged AS (SELECT *, ds || list_filter(ps, lambda x: NOT list_contains(ds, x)) AS allt FROM present)",
    r"""shaped AS (SELECT *, allt[1:6] AS pii, CASE WHEN len(ds) > 0 THEN allt ELSE ps END AS st,
        CASE WHEN contains(regexp_extract(path, '[^/]*$'), '.') THEN lower(regexp_extract(path, '([^.]*)$', 1)) ELSE 'unknown' END AS ft FROM merged)""",
) + f"""SELECT {_stable('path')} AS id, {NAME} AS name, path, greatest(1, CASE WHEN doc_id % 4 = 0 OR doc_id = 0 THEN CASE WHEN size = 0 THEN 1 ELSE size END ELSE doc_id END)::BIGINT AS value,
    (CASE WHEN doc_id % 13 = 0 THEN greatest(0, least(3, floor((doc_id % 9) / 2.0 - 0.5 + 0.5))) ELSE {VIEW_SEVERITY.format('st')} END)::INT AS severity,
    array_to_string(pii, ',') AS pii, array_to_string(pii[1:3], ',') AS top_pii,
    CASE WHEN doc_id % 17 = 0 THEN 'legal' ELSE {_view_category('pii', 'ft')} END AS category, ft AS file_type FROM shaped"""
ORACLE["audit_given"] = _with(
    PLANT,
    CORPUS.replace("text AS content", "text AS content, source, lang"),
    f"""given AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown-row-' || doc_id ELSE path END AS path, size, source, lang,
        CASE WHEN doc_id % 3 = 0 THEN right(content, 40) ELSE content END AS judged, doc_id % 3 = 0 AS cut FROM corpus)""",
    f"present AS (SELECT *, {_presence('judged')} AS ps FROM given)",
) + f"""SELECT CASE WHEN doc_id % 5 = 0 THEN 'row-' || doc_id ELSE {_stable('path')} END AS id, {NAME} AS name, path, ({VIEW_SEVERITY.format('ps')})::INT AS severity,
    array_to_string(ps, ',') AS pii, CASE WHEN cut THEN judged ELSE left(judged, 220) END AS excerpt,
    CASE WHEN doc_id % 4 = 0 THEN 'lang=' || lang || ';' ELSE '' END || 'modified=' || strftime(DATE '2024-06-01' - (doc_id % 800)::INT, '%Y-%m-%d') || ';size=' || size
        || ';source=' || CASE WHEN doc_id % 4 = 0 THEN upper(source) ELSE source END AS metadata FROM present"""
ORACLE["node_paths"] = _with(*BASE) + """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 6 = 0 THEN '' ELSE path END
    WHEN 1 THEN path ELSE path || ',' || path || '.enc' END AS paths FROM corpus"""
ORACLE["view_types"] = "SELECT doc_id, lower(lang) || ',' || lower(source) AS types FROM documents"


def _group(by: str, key: str, source: str = "audit") -> str:
    return f"""SELECT {_stable(f"'{by}:' || group_name")} AS id, '{by}:' || group_name AS name, * FROM (
        SELECT {key} AS group_name, sum(value)::BIGINT AS value, max(severity) AS severity, count(*) AS file_count FROM {source} GROUP BY {key})"""


ORACLE["rollup_category"] = _with(*AUDIT) + _group("category", "category")
ORACLE["rollup_type"] = _with(*AUDIT) + _group("type", "file_type")
ORACLE["rollup_file"] = _with(*AUDIT) + f"""SELECT {_stable("'file:files'")} AS id, 'file:files' AS name, 'files' AS group_name,
    sum(value)::BIGINT AS value, max(severity) AS severity, count(*) AS file_count FROM audit"""
_SUMS = "sum(value)::BIGINT AS value, max(severity) AS severity, count(*) AS file_count FROM audit"
ORACLE["rollup_grouping_sets"] = _with(*AUDIT) + f"""SELECT 'category' AS view, category AS group_name, {_SUMS} GROUP BY category
    UNION ALL SELECT 'type', file_type, {_SUMS} GROUP BY file_type UNION ALL SELECT 'root', 'root', {_SUMS}"""
ORACLE["rollup_root"] = _with(*AUDIT) + "SELECT sum(value)::BIGINT AS value, max(severity) AS severity, count(DISTINCT category) AS group_count FROM audit"
TOPN = """ranked AS (SELECT *, row_number() OVER (ORDER BY value DESC, path) AS rn FROM audit)"""
_REST = "count(*) AS k, sum(value)::BIGINT AS v, max(severity) AS s"
TOPN_ROWS = f"""SELECT id, name, path, value, severity, pii, top_pii, category, file_type FROM ranked WHERE rn <= 200 UNION ALL
    SELECT {_stable("'others-' || k || '-' || v")}, 'Others (' || k || ')', '', v, s, '', '', 'others', 'aggregate' FROM (
        SELECT {_REST} FROM ranked WHERE rn > 200) WHERE k > 0"""
ORACLE["top_n_others"] = _with(*AUDIT, TOPN) + TOPN_ROWS
ORACLE["top_n_default"] = _with(*AUDIT, TOPN) + TOPN_ROWS.replace("200", str(TOP_N_FILES))
ORACLE["top_n_lineitem"] = f"""WITH lines AS (SELECT '/' || l_orderkey || '/' || l_linenumber AS path, trunc(l_extendedprice)::BIGINT AS value, (l_linenumber % 4)::INT AS severity FROM lineitem),
    ranked AS (SELECT *, row_number() OVER (ORDER BY value DESC, path) AS rn FROM lines)
    SELECT path AS name, path, value, severity FROM ranked WHERE rn <= {TOP_N_FILES}
    UNION ALL SELECT 'Others (' || count(*) || ')', '', sum(value)::BIGINT, max(severity) FROM ranked WHERE rn > {TOP_N_FILES} HAVING count(*) > 0"""
ORACLE["ordered_groups"] = _with(*AUDIT) + """SELECT file_type AS group_name, sum(value)::BIGINT AS value,
    row_number() OVER (ORDER BY sum(value) DESC, file_type) AS place FROM audit GROUP BY file_type"""
ORACLE["node_paths"] = _with(*BASE) + "SELECT path, CASE WHEN doc_id % 3 = 0 THEN path || '/a' ELSE path END AS paths FROM corpus"
ORACLE["treemap_groups"] = _with(*AUDIT, TOPN, f"shown AS ({TOPN_ROWS})") + _group("category", "category", "shown")


def _children(key: str) -> list[str]:
    return [
        f"grouped AS (SELECT *, {key} AS group_name FROM audit)",
        """placed AS (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY value DESC, path) AS rn,
            count(*) OVER (PARTITION BY group_name) AS cnt FROM grouped)""",
        "shown AS (SELECT *, cnt <= 12 OR rn <= 11 AS vis FROM placed)",
        f"tails AS (SELECT group_name, {_REST} FROM shown WHERE NOT vis GROUP BY group_name)",
        """types AS (SELECT group_name, list(t ORDER BY rn, pos) AS ts FROM (SELECT group_name, t, min(rn) AS rn,
            arg_min(pos, (rn, pos)) AS pos FROM (SELECT group_name, rn, unnest(string_split(pii, ',')) AS t,
            generate_subscripts(string_split(pii, ','), 1) AS pos FROM shown WHERE NOT vis AND pii <> '') GROUP BY group_name, t)
            GROUP BY group_name)""",
        f"""children AS (SELECT group_name, id, name, path, value, severity, pii, top_pii, excerpt, category, file_type FROM shown WHERE vis
            UNION ALL SELECT group_name, {_stable("'others-' || group_name || '-' || k || '-' || v")}, '+' || k || ' other files',
                k || ' other files', v, s, coalesce(array_to_string(ts, ','), ''), coalesce(array_to_string(ts[1:3], ','), ''),
                'Contains ' || k || ' smaller files in the ' || group_name || ' category.', group_name, 'aggregate'
            FROM tails LEFT JOIN types USING (group_name))""",
    ]


ORACLE["group_top_k_category"] = _with(*AUDIT, *_children("category")) + "SELECT * FROM children"
ORACLE["group_top_k_type"] = _with(*AUDIT, *_children("file_type")) + "SELECT * EXCLUDE (excerpt) FROM children"
ORACLE["group_top_k_file"] = _with(*AUDIT, *_children("'files'")) + "SELECT * EXCLUDE (excerpt) FROM children"
# The corpus has the fixed common prefix of its root, taken from the data below.
PREFIX = """prefix AS (SELECT array_to_string(list_transform(list_filter(range(1, least(len(lo), len(hi)) + 1),
        lambda i: lo[1:i] = hi[1:i]), lambda i: lo[i]), '/') AS prefix
    FROM (SELECT min(string_split(path, '/')) AS lo, max(string_split(path, '/')) AS hi FROM corpus))"""
ORACLE["common_prefix"] = _with(*BASE, PREFIX) + "SELECT prefix FROM prefix"
DIRS = [
    PREFIX,
    """placed_dirs AS (SELECT *, string_split(substr(path, len(prefix) + 2), '/') AS parts FROM audit, prefix)""",
    """nodes AS MATERIALIZED (SELECT array_to_string(parts[1:level], '/') AS path, level, sum(value)::BIGINT AS value,
        max(severity) AS severity, count(*) AS file_count, count(*) FILTER (level = len(parts) - 1) AS local_count
        FROM (SELECT value, severity, parts, unnest(range(0, len(parts))) AS level FROM placed_dirs) GROUP BY 1, 2)""",
]
ORACLE["dir_rollup"] = _with(*AUDIT, *DIRS) + f"""SELECT CASE WHEN level = 0 THEN 'root' ELSE {_stable("'dir:' || path")} END AS id,
    CASE WHEN level = 0 THEN (SELECT prefix FROM prefix) ELSE regexp_extract(path, '[^/]*$') END AS name, path,
    CASE WHEN level > 1 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) WHEN level = 1 THEN '' END AS parent,
    level::INT AS level, value, severity, file_count, local_count FROM nodes"""
ORACLE["portfolio_score"] = _with(*AUDIT) + """SELECT risk, files, score, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 35 THEN 'elevated' ELSE 'calm' END AS tone
    FROM (SELECT risk, files, floor(100.0 * risk / (3 * files) + 0.5)::INT AS score FROM (
        SELECT sum(severity)::BIGINT AS risk, count(*) AS files FROM audit))"""
ORACLE["dashboard_metrics"] = _with(*AUDIT) + """SELECT count(*) AS files, count(*) FILTER (severity >= 3) AS high_risk,
    (SELECT count(DISTINCT t) FROM (SELECT unnest(string_split(pii, ',')) AS t FROM audit WHERE pii <> '')) AS pii_types,
    count(DISTINCT category) AS categories FROM audit"""
_KEY = "list_transform(CASE WHEN path = '' THEN [] ELSE string_split(path, '/') END, lambda x: {'k': 0, 'n': x})"
ORACLE["ordered_tree"] = _with(*AUDIT, *DIRS, f"""rows AS (
    SELECT {_KEY} AS key, path, level::INT AS level, true AS is_dir, value::BIGINT AS value, severity FROM nodes
    UNION ALL SELECT list_append(list_transform(string_split(relative, '/')[:-2], lambda x: {{'k': 0, 'n': x}}), {{'k': 1, 'n': name}}), relative,
        len(string_split(relative, '/'))::INT, false, value, severity FROM (SELECT *, ltrim(substr(path, length(p) + 1), '/') AS relative FROM audit, (SELECT prefix AS p FROM prefix))),
    numbered AS (SELECT *, row_number() OVER (ORDER BY key) AS enter FROM rows)""") + """
    SELECT n.path, CASE WHEN n.path = '' THEN '' ELSE string_split(n.path, '/')[-1] END AS name, n.level, n.is_dir, n.value, n.severity, n.enter,
    n.enter + CASE WHEN n.is_dir THEN (SELECT count(*) FROM numbered m WHERE n.path = '' OR starts_with(m.path, n.path || '/')) - (n.path = '')::INT ELSE 0 END AS leave FROM numbered n"""
MATCH = "(contains(lower(name), '{0}') OR contains(lower(path), '{0}') OR contains(lower(pii), '{0}'))"
ORACLE["search_files"] = _with(*AUDIT) + f"SELECT path, pii, severity FROM audit WHERE {MATCH.format('src7')}"
ORACLE["search_groups"] = _with(*AUDIT, *_children("category"), f"totals AS ({_group('category', 'category')})") + f"""
    SELECT * FROM totals WHERE group_name IN (SELECT group_name FROM children WHERE {MATCH.format('card')})"""
ORACLE["search_directories"] = _with(
    *AUDIT,
    *DIRS,
    """inner_dirs AS (SELECT DISTINCT CASE WHEN level > 1 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS path
        FROM nodes WHERE level > 0)""",
    f"""seeds AS (SELECT path FROM nodes WHERE path NOT IN (FROM inner_dirs) AND contains(lower(path), 'doc_1')
        UNION SELECT d FROM (SELECT array_to_string(parts[1:len(parts) - 1], '/') AS d FROM placed_dirs WHERE {MATCH.format('doc_1')})
        WHERE d IN (FROM inner_dirs))""",
) + """SELECT n.path, n.value, n.severity, n.file_count FROM nodes n
    WHERE EXISTS (SELECT 1 FROM seeds s WHERE n.path = '' OR s.path = n.path OR starts_with(s.path, n.path || '/'))"""
ORACLE["stable_ids"] = _with(*BASE) + f"""SELECT path, {_stable('path')} AS id FROM (SELECT path FROM corpus
    UNION ALL SELECT url || '/é€\U0001f600' FROM pages)"""
ORACLE["size_labels"] = _with(*BASE) + f"""SELECT path, CASE WHEN b <= 0 THEN '0 B' WHEN u = 0 OR v >= 10 THEN floor(v + 0.5)::BIGINT || ' ' || un
    ELSE (floor(v * 10 + 0.5)::BIGINT // 10) || '.' || (floor(v * 10 + 0.5)::BIGINT % 10) || ' ' || un END AS label,
    CASE WHEN contains(n, '.') THEN lower(regexp_extract(n, '([^.]*)$', 1)) ELSE 'unknown' END AS ext
    FROM (SELECT path, n, b, u, b / power(1024.0, u) AS v, ['B', 'KB', 'MB', 'GB'][u + 1] AS un FROM (
        SELECT path, {NAME} AS n, b, CASE WHEN b < 1024 THEN 0 WHEN b < 1048576 THEN 1 WHEN b < 1073741824 THEN 2 ELSE 3 END AS u
        FROM (SELECT path, size * (1 + (doc_id % 5) * 9973 * doc_id) AS b FROM corpus)))"""
ORACLE["severity_labels"] = _with(*AUDIT) + "SELECT severity, ['Info', 'Low', 'Medium', 'High'][severity + 1] AS label, count(*) AS files FROM audit GROUP BY severity"

# ---- remediation

REDACT = [
    *RAW,
    CORPUS,
    """asked AS (SELECT c.doc_id, c.path, c.content, coalesce(h.vs, []) AS vs, coalesce(h.ts, []) AS ts FROM corpus c LEFT JOIN (
        SELECT doc_id, list({'c': value, 'n': 0} ORDER BY start, pii_type) AS vs, list(DISTINCT pii_type) AS ts
        FROM hits GROUP BY doc_id) h ON c.doc_id = h.doc_id)""",
    """folded AS (SELECT *, list_reduce(vs, lambda a, p: CASE WHEN contains(a.c, p.c)
        THEN {'c': replace(a.c, p.c, '[REDACTED]'), 'n': a.n + 1} ELSE a END, {'c': content, 'n': 0}) AS r FROM asked)""",
    """redacted AS (SELECT path, r.n AS replacements, r.c AS content,
        list_sort(CASE WHEN doc_id % 5 = 0 THEN list_append(ts, 'unknown') ELSE ts END) AS pii_types FROM folded)""",
]
ORACLE["redact_documents"] = _with(*REDACT) + "SELECT path, replacements, array_to_string(pii_types, ',') AS pii_types, md5(content) AS digest FROM redacted"
ORACLE["encrypt_roundtrip"] = _with(*BASE) + """SELECT CASE WHEN doc_id % 10 <> 1 AND doc_id % 4 = 0 THEN path || '.enc' ELSE path END AS path,
    CASE WHEN doc_id % 10 = 1 THEN 'not an encrypted file' WHEN doc_id % 4 = 0 THEN 'invalid key or corrupted content' ELSE 'opened' END AS status,
    CASE WHEN doc_id % 10 <> 1 AND doc_id % 4 <> 0 THEN md5(content) END AS digest FROM corpus"""
ORACLE["purge_files"] = _with(*BASE) + "SELECT path, size FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
ORACLE["requested_files"] = _with(*BASE) + """SELECT path, size, 'redact' AS action FROM corpus
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)"""
_CLEAN = "path IN (SELECT path FROM corpus WHERE doc_id IN (SELECT doc_id FROM labels WHERE {0}))"
ORACLE["apply_overrides"] = _with(*AUDIT) + f"""SELECT path, CASE WHEN c THEN 0 ELSE severity END AS severity, c AS cleaned
    FROM (SELECT *, {_CLEAN.format('quality = 0')} AS c FROM audit)"""
ORACLE["cleaned_nodes"] = _with(*AUDIT) + f"""SELECT node, cleaned, CASE WHEN cleaned THEN 0 ELSE s END AS severity, n FROM (
    SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS node, bool_and(c) AS cleaned, max(severity) AS s, count(*) AS n
    FROM (SELECT *, {_CLEAN.format('quality = 0 OR doc_id % 2 = 0')} AS c FROM audit) GROUP BY 1)"""
ORACLE["rename_paths"] = _with(*BASE) + f"""SELECT path, {NAME} AS name FROM (SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
    THEN path || '.enc' ELSE path END AS path FROM corpus)"""
ORACLE["rename_chains"] = _with(*BASE) + f"""SELECT path, {NAME} AS name, CASE WHEN cleaned THEN 0 ELSE 2 END AS severity, cleaned FROM (
    SELECT path || CASE WHEN doc_id % 5 < 2 THEN '.old' WHEN doc_id % 5 = 3 THEN '.enc' ELSE '' END AS path,
        doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS cleaned FROM corpus)"""
ORACLE["redacted_versions"] = _with(*REDACT) + f"""SELECT 0 AS version, path, md5(content) AS digest FROM corpus
    UNION ALL SELECT 1, path, md5(content) FROM redacted
    UNION ALL SELECT 2, path, md5(content) FROM redacted WHERE NOT {_CLEAN.format('toxic = 1')}"""
ORACLE["selected_files"] = _with(*BASE) + """SELECT path, size, CASE WHEN ends_with(path, '.txt') THEN 2 ELSE 1 END AS selection_ord FROM corpus
    WHERE (contains(path, '/src3/') OR ends_with(path, '.txt')) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
ORACLE["remediation_eligibility"] = _with(*BASE) + f"""SELECT CASE WHEN doc_id % 3 = 0 THEN path || '.enc' ELSE path END AS path,
    ({FILE_TYPE}) NOT IN ('pdf', 'zip', 'archive', 'binary', 'image') AS can_redact, doc_id % 3 = 0 AS can_decrypt FROM corpus"""
ORACLE["decrypt_rejection"] = _with(*BASE) + f"""SELECT n, (SELECT string_agg({NAME}, ', ' ORDER BY path) FROM (
        SELECT path FROM corpus WHERE doc_id % 3 <> 0 ORDER BY path LIMIT 3))
        || CASE WHEN n > 3 THEN ' (+' || (n - 3) || ' more)' ELSE '' END AS message
    FROM (SELECT count(*) AS n FROM corpus WHERE doc_id % 3 <> 0) WHERE n > 0"""
_FILE = "'{\"file\":\"' || {0} || '\"'"
ORACLE["remediation_events"] = _with(*REDACT) + """SELECT 'remediation.redact' AS type, 'remediation.redact_file' AS source,
        '{"file":"' || path || '","pii_types":[' || array_to_string(list_transform(pii_types, lambda t: '"' || t || '"'), ',')
        || '],"replacements":' || replacements || '}' AS payload FROM redacted
    UNION ALL SELECT 'remediation.shred', 'remediation.secure_delete', '{"file":"' || path || '"}' FROM corpus
    UNION ALL SELECT 'remediation.shred', 'remediation.secure_delete', '{"file":"' || path || '"}' FROM corpus
    UNION ALL SELECT 'remediation.encrypt', 'remediation.encrypt_file', '{"file":"' || path || '.enc","original":"' || path || '"}' FROM corpus
    UNION ALL SELECT 'remediation.decrypt', 'remediation.decrypt_file', '{"encrypted_file":"' || path || '.enc","file":"' || path || '"}' FROM corpus"""

# ---- ledger

ENTRIES = """entries AS (SELECT event_id AS id, ts AS timestamp, event_type AS type, 'user-' || user_id AS source,
    props AS payload, '{}' AS metadata FROM events)"""
ORACLE["ledger_history"] = _with(ENTRIES) + "SELECT * FROM entries WHERE type = 'click' AND source = 'user-8' ORDER BY id LIMIT 100 OFFSET 2"
ORACLE["ledger_where"] = _with(ENTRIES) + "SELECT * FROM entries WHERE type = 'error' AND id > 50 ORDER BY id LIMIT 40 OFFSET 5"
ORACLE["ledger_stats"] = _with(ENTRIES) + """SELECT type, count(*) AS n, count(DISTINCT source) AS sources, min(timestamp) AS first_at,
    max(json_extract_string(payload, '$.k')::INT) AS top FROM entries GROUP BY type HAVING count(*) > 1"""
ORACLE["ledger_query_all"] = _with(ENTRIES) + "SELECT source, hour(timestamp)::INT AS hour, count(*) AS n FROM entries GROUP BY 1, 2"
ORACLE["ledger_append"] = """WITH made AS (SELECT event_type AS type, 'user-' || user_id AS source,
        '{"a":' || json(props)::VARCHAR || ',"z":' || event_id || '}' AS payload,
        '{"z": ' || event_id || ', "a": ' || props || '}' AS given FROM events),
    first AS (SELECT row_number() OVER (ORDER BY type, source, given) AS id, TIMESTAMP '2024-06-01 12:00:00' AS timestamp, *
        FROM made WHERE type <> 'error'),
    second AS (SELECT (SELECT count(*) FROM first) + row_number() OVER (ORDER BY type, source, given) AS id,
        TIMESTAMP '2024-06-01 13:00:00' AS timestamp, * FROM made WHERE type = 'error')
    SELECT * EXCLUDE (given), '{}' AS metadata FROM (SELECT * FROM first UNION ALL SELECT * FROM second)"""

# ---- named entities

CHUNKS = """chunked AS (SELECT doc_id, text, (i * 1800)::INT AS chunk_start, substr(text, i * 1800 + 1, 1800) AS chunk FROM (
    SELECT doc_id, text, unnest(range(0, (len(text) + 1799) // 1800)) AS i FROM planted))"""
ORACLE["ner_chunks"] = _with(PLANT, CHUNKS) + """SELECT doc_id, chunk_start, md5(chunk) AS digest,
    substr(text, greatest(chunk_start - 50, 0) + 1, least(chunk_start, 50)) AS before,
    substr(text, chunk_start + 1801, 50) AS after FROM chunked"""
NER = [
    CHUNKS,
    r"""words AS (SELECT doc_id, chunk_start, regexp_extract_all(chunk, '[^ \t\r\n\f\v]+') AS w,
        string_split_regex(chunk, '[^ \t\r\n\f\v]+') AS g FROM chunked)""",
    """tokens AS (SELECT doc_id, chunk_start, unnest(range(1, len(w) + 1)) AS idx, unnest(w) AS word,
        unnest(g[1:len(w)]) AS gap FROM words WHERE len(w) > 0)""",
    """tagged AS (SELECT *, sum(len(gap) + len(word)) OVER seq - len(word) AS s, len(word) % 9 AS label, 1 + len(word) % 5 AS logit
        FROM tokens WINDOW seq AS (PARTITION BY doc_id, chunk_start ORDER BY idx ROWS UNBOUNDED PRECEDING))""",
    """named AS (SELECT doc_id, chunk_start, idx, s::INT AS s, (s + len(word))::INT AS e, exp(logit) / (exp(logit) + 8) AS p,
        label IN (1, 3, 5) AS opens,
        CASE WHEN label IN (1, 2) THEN 'Name' WHEN label IN (3, 4) THEN 'Organization' WHEN label IN (5, 6) THEN 'Location' END AS t FROM tagged)""",
    """opened AS (SELECT *, sum(CASE WHEN t IS NOT NULL AND (opens OR lag IS NULL OR lag <> t) THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id, chunk_start ORDER BY idx ROWS UNBOUNDED PRECEDING) AS ent
        FROM (SELECT *, lag(t) OVER (PARTITION BY doc_id, chunk_start ORDER BY idx) AS lag FROM named))""",
    """entities AS MATERIALIZED (SELECT doc_id, t AS pii_type, (chunk_start + min(s))::INT AS start, (chunk_start + max(e))::INT AS stop,
        round(avg(p), 4) AS confidence FROM opened WHERE t IS NOT NULL GROUP BY doc_id, chunk_start, ent, t)""",
]
_FULL = f"""SELECT e.doc_id, e.pii_type, {_category('e.pii_type')} AS category, e.start, e.stop,
    substr(p.text, e.start + 1, e.stop - e.start) AS value, e.confidence,
    md5(substr(p.text, greatest(e.start - 50, 0) + 1, e.stop + 50 - greatest(e.start - 50, 0))) AS excerpt
    FROM entities e JOIN planted p ON e.doc_id = p.doc_id"""
ORACLE["ner_entities"] = _with(PLANT, *NER) + _FULL
ORACLE["ner_and_regex_summary"] = _with(*KEPT, *NER) + """SELECT pii_type, method, count(*) AS n FROM (
    SELECT pii_type, 'regex' AS method FROM kept UNION ALL SELECT pii_type, 'ner' FROM entities) GROUP BY pii_type, method"""

BOTH = [*KEPT, *NER, """found AS (SELECT doc_id, pii_type, start, stop, value FROM kept
    UNION ALL SELECT e.doc_id, e.pii_type, e.start, e.stop, substr(p.text, e.start + 1, e.stop - e.start) FROM entities e JOIN planted p ON e.doc_id = p.doc_id)"""]
ORACLE["classify_summary_both"] = _with(*BOTH) + f"""SELECT p.doc_id, md5(coalesce(s.pii_types, '')) AS pii_types,
    coalesce(s.categories, '') AS categories, coalesce(s.n, 0)::INT AS n, 'model' AS backend
    FROM planted p LEFT JOIN (SELECT doc_id, string_agg(pii_type, ',' ORDER BY start, pii_type) AS pii_types,
        array_to_string(list_sort(list_distinct(list({_category('pii_type')}))), ',') AS categories, count(*) AS n
        FROM found GROUP BY doc_id) s ON p.doc_id = s.doc_id"""
_WEIGHED = f"weighed AS (SELECT doc_id, sum({_weight('pii_type')})::INT AS w FROM found GROUP BY doc_id)"
ORACLE["doc_score_both"] = _with(*BOTH, _WEIGHED) + f"""SELECT p.doc_id, coalesce(w, 0) AS raw_score, least(coalesce(w, 0), 100) AS score,
    {SEVERITY.format('least(coalesce(w, 0), 100)')} AS severity FROM planted p LEFT JOIN weighed s ON p.doc_id = s.doc_id"""
_BY_CATEGORY = ", ".join(f"coalesce(sum({_weight('pii_type')}) FILTER ({_category('pii_type')} = '{c}'), 0)::INT AS {c}" for c in SCORE_CATEGORIES)
_EXTRA = f"(CASE WHEN {PLACE} THEN 2 ELSE 0 END + CASE WHEN {OLD} THEN 2 ELSE 0 END)::INT"
ORACLE["score_breakdown_both"] = _with(*BOTH, CORPUS, f"parts AS (SELECT doc_id, {_BY_CATEGORY} FROM found GROUP BY doc_id)") + f"""
    SELECT path, {', '.join(f'coalesce({c}, 0) AS {c}' for c in SCORE_CATEGORIES)}, {_EXTRA} AS bonuses,
    {' + '.join(f'coalesce({c}, 0)' for c in SCORE_CATEGORIES)} + {_EXTRA} AS raw_score,
    {SEVERITY.format(f"({' + '.join(f'coalesce({c}, 0)' for c in SCORE_CATEGORIES)} + {_EXTRA})")} AS severity
    FROM corpus c LEFT JOIN parts p ON c.doc_id = p.doc_id"""
ORACLE["audit_files_both"] = _with(
    *BOTH,
    CORPUS,
    """declared AS (SELECT c.doc_id, c.path, c.content, c.size, coalesce(d.ds, []) AS ds FROM corpus c LEFT JOIN (
        SELECT doc_id, list(t ORDER BY start, p) AS ds FROM (SELECT doc_id, lower(pii_type) AS t, min(start) AS start,
            arg_min(pii_type, (start, pii_type)) AS p FROM found GROUP BY doc_id, lower(pii_type)) GROUP BY doc_id) d ON c.doc_id = d.doc_id)""",
    f"present AS (SELECT *, {_presence('content')} AS ps FROM declared)",
    "merged AS (SELECT *, ds || list_filter(ps, lambda x: NOT list_contains(ds, x)) AS allt FROM present)",
    r"""shaped AS (SELECT *, CASE WHEN len(ds) > 0 THEN allt ELSE ps END AS st,
        CASE WHEN contains(regexp_extract(path, '[^/]*$'), '.') THEN lower(regexp_extract(path, '([^.]*)$', 1)) ELSE 'unknown' END AS ft FROM merged)""",
) + f"""SELECT {_stable('path')} AS id, {NAME} AS name, path, greatest(1, size)::BIGINT AS value, ({VIEW_SEVERITY.format('st')})::INT AS severity,
    array_to_string(allt, ',') AS pii, array_to_string(allt[1:3], ',') AS top_pii, {_view_category('allt', 'ft')} AS category, ft AS file_type FROM shaped"""
_OWN = [(name, f"len(list_filter(string_split(content, {NL}), lambda l: regexp_matches(l, '(?i){p}') AND NOT {_noise('l')})) > 0") for name, p in (("badge", "EMP[0-9]"), ("routing", "KVBL0"))]
ORACLE["audit_custom_rules"] = _with(*BASE) + f"""SELECT path, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _OWN)}) AS own FROM corpus"""

# ---- streaming

ORACLE["stream_detections"] = _with(*_hits("documents", "doc_id", "text")) + "SELECT doc_id, pii_type, start, stop, value FROM hits"
ORACLE["stream_scan"] = _with(*BASE, *_visited([ROOT], depth=99)) + """SELECT 0 AS seq, 'start' AS event, NULL AS path, NULL AS kind, NULL AS outcome
    UNION ALL SELECT 1, CASE WHEN outcome = 'read' THEN 'file' ELSE 'skip' END, path, kind, outcome FROM visited
    UNION ALL SELECT 3, 'complete', NULL, NULL, NULL"""
def _logged(limit: str, budget: int | None = None) -> list[str]:
    """Events of three batches: ``seen`` in order, cut at the budget, with running counters by root."""
    flags = FLAGS | {"permission_errors": "outcome = 'error'"}
    running = ", ".join(f"count(*) FILTER ({c}) OVER (PARTITION BY root_ord ORDER BY doc_id % 3, path ROWS UNBOUNDED PRECEDING) AS {n}" for n, c in flags.items())
    failed = "CASE WHEN doc_id % 9 = 4 THEN 'error' ELSE outcome END"
    return [
        *BASE,
        *_visited(ROOTS, limit),
        f"judged AS (SELECT doc_id, path, root_ord, {failed} AS outcome, CASE WHEN doc_id % 9 <> 4 THEN kind END AS kind, row_number() OVER (ORDER BY doc_id % 3, root_ord, path) AS rn FROM visited)",
        f"seen AS (SELECT * FROM judged {f'WHERE rn <= {budget}' if budget else ''})",
        f"counted AS (SELECT *, {running} FROM seen)",
        f"roots AS (SELECT unnest(range({len(ROOTS)}))::INT AS root_ord)",
        f"final AS (SELECT r.root_ord, {', '.join(f'count(*) FILTER (s.path IS NOT NULL AND {c}) AS {n}' for n, c in flags.items())} FROM roots r LEFT JOIN seen s USING (root_ord) GROUP BY r.root_ord)",
    ]


_COUNTED = ", ".join((*FLAGS, "permission_errors"))
_EVENT = "CASE outcome WHEN 'read' THEN 'file' WHEN 'error' THEN 'error' ELSE 'skip' END"
ORACLE["stream_running_stats"] = _with(*_logged(SMALL)) + f"""SELECT 0 AS seq, 'start' AS event, NULL AS path, NULL AS kind, NULL AS outcome, root_ord, {', '.join(f'0::BIGINT AS {c}' for c in (*FLAGS, 'permission_errors'))} FROM roots
    UNION ALL SELECT 1, {_EVENT}, path, kind, outcome, root_ord, {_COUNTED} FROM counted
    UNION ALL SELECT 3, 'complete', NULL, NULL, NULL, root_ord, {_COUNTED} FROM final"""
ORACLE["stream_budget"] = _with(*_logged("26214400000", 100)) + f"""SELECT 0 AS seq, 'start' AS event, NULL AS path, root_ord, 0::BIGINT AS total_files FROM roots
    UNION ALL SELECT 1, {_EVENT}, path, root_ord, total_files FROM counted
    UNION ALL SELECT 2, 'limit_reached', NULL, NULL, 100 WHERE (SELECT count(*) FROM judged) > 100
    UNION ALL SELECT 3, 'complete', NULL, root_ord, total_files FROM final"""
ORACLE["stream_path_dedupe"] = _with(*BASE) + "SELECT path FROM corpus"
ORACLE["stream_old_files"] = ORACLE["stream_path_dedupe"]
ORACLE["stream_counters"] = _with(*BASE, *_visited([ROOT], depth=99)) + """SELECT CASE WHEN outcome = 'read' THEN 'file' ELSE 'skip' END AS event,
    outcome, count(*) AS count FROM visited GROUP BY 1, 2"""
ORACLE["stream_ledger"] = _with(ENTRIES) + "SELECT id, timestamp, type, source, json(payload)::VARCHAR AS payload, metadata FROM entries"
