"""SQL, for DuckDB, of the operators on URLs and conversations: long statements are put together from small parts."""

from __future__ import annotations

from riskloom.llm import url_filter
from riskloom.llm.common import LOWER, UPPER

#: The table of CRC-32 by byte, and an expression for the checksum of ASCII text.
CRC_TABLE = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i))"


def crc32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(unicode(x) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"


def url_filters() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(str(r)))

    def case(value) -> str:
        whens = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {value(r)}" for r in rules]
        return f"CASE {' '.join(whens)} END"

    def purity(blocked: str, labelled: str, above: str) -> str:
        return f"(({blocked}) + {url_filter.WEIGHT}::DOUBLE * {above}) / (({labelled}) + {url_filter.WEIGHT}::DOUBLE)"

    shapes = " ".join(f"WHEN regexp_matches(after, '{pattern}') THEN '{name}'" for name, pattern in url_filter.SHAPES)
    kinds = url_filter.KINDS
    out = [
        f"""parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages))""",
        f"ruled AS (SELECT *, {case(lambda r: repr(str(r)))} AS rule, {case(lambda r: repr(r.verdict))} AS said FROM parsed)",
        """paths AS (SELECT host, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg,
    count(*) AS n, count(*) FILTER (said = 'block') AS blocked, count(said) AS labelled FROM ruled GROUP BY host, path)""",
        "prior AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(blocked)::DOUBLE / sum(labelled)::DOUBLE ELSE 0.0 END AS p FROM paths)",
        f"hosts AS (SELECT host, {purity('sum(blocked)', 'sum(labelled)', 'max(p)')} AS purity FROM paths, prior GROUP BY host)",
        "s0 AS (SELECT paths.*, '' AS template, purity FROM paths JOIN hosts USING (host))",
    ]
    levels = url_filter.LEVELS

    def segment(k: int) -> str:
        held = f"array_to_string(seg[{k + 1}:], '/')" if k == levels - 1 else f"seg[{k + 1}]"
        return f"CASE WHEN len(seg) > {k} THEN {held} END" if k < levels else "CAST(NULL AS VARCHAR)"

    for k in range(levels):
        shares = " + ".join(f"abs({x}_n::DOUBLE / n::DOUBLE - pool_{x}::DOUBLE / pool_n::DOUBLE)" for x in kinds)
        most = f"greatest({', '.join(f'{x}_n' for x in kinds)})"
        main = " ".join(f"WHEN {x}_n = {most} THEN '{x}'" for x in kinds)
        rate = "(pool_blocked::DOUBLE / pool_labelled::DOUBLE)"
        out += [
            f"c{k} AS (SELECT *, CASE WHEN after IS NULL THEN 'end' {shapes} END AS kind FROM (SELECT *, {segment(k)} AS child, {segment(k + 1)} AS after FROM s{k}))",
            f"""k{k} AS (SELECT host, template, child, max(purity) AS above, sum(n) AS n, sum(blocked) AS blocked, sum(labelled) AS labelled,
    {', '.join(f"coalesce(sum(n) FILTER (kind = '{x}'), 0) AS {x}_n" for x in kinds)} FROM c{k} WHERE child IS NOT NULL GROUP BY host, template, child)""",
            f"""n{k} AS (SELECT host, template, max(above) AS above, sum(n) AS all_n, sum(blocked) AS all_blocked, sum(labelled) AS all_labelled
    FROM k{k} GROUP BY host, template)""",
            f"""l{k} AS (SELECT k.*, CASE {main} END AS main FROM k{k} k JOIN n{k} USING (host, template)
    WHERE n >= {url_filter.LEAST} AND n >= {url_filter.SUPPORT}::DOUBLE * all_n::DOUBLE)""",
            f"""p{k} AS (SELECT host, template, main, sum(n) AS pool_n, sum(blocked) AS pool_blocked, sum(labelled) AS pool_labelled,
    {', '.join(f'sum({x}_n) AS pool_{x}' for x in kinds)} FROM l{k} GROUP BY host, template, main)""",
            f"""a{k} AS (SELECT host, template, main, child, above, blocked, labelled, ({shares}) / 2 <= 0.1::DOUBLE + 1::DOUBLE / sqrt(n::DOUBLE) AND
    (labelled = 0 OR pool_labelled = 0 OR abs(blocked::DOUBLE / labelled::DOUBLE - {rate}) <= 2::DOUBLE * sqrt(1::DOUBLE / labelled::DOUBLE) * sqrt({rate} * (1 - {rate}))) AS alike
    FROM l{k} JOIN p{k} USING (host, template, main))""",
            f"""m{k} AS (SELECT host, template, main, true AS alike, '{{' || string_agg(child, '|' ORDER BY child) || '}}' AS names, sum(blocked) AS m_blocked, sum(labelled) AS m_labelled
    FROM a{k} WHERE alike GROUP BY host, template, main HAVING count(*) > 1)""",
            f"""b{k} AS (SELECT host, template, child, blocked, labelled, coalesce(names, child) AS branch,
    {purity('coalesce(m_blocked, blocked)', 'coalesce(m_labelled, labelled)', 'above')} AS branch_purity FROM a{k} LEFT JOIN m{k} USING (host, template, main, alike))""",
            f"""w{k} AS (SELECT host, template, {purity('max(all_blocked) - coalesce(sum(blocked), 0)', 'max(all_labelled) - coalesce(sum(labelled), 0)', 'max(above)')} AS wild_purity
    FROM n{k} LEFT JOIN b{k} USING (host, template) GROUP BY host, template)""",
            f"""s{k + 1} AS (SELECT c.host, c.path, c.seg, c.n, c.blocked, c.labelled,
    CASE WHEN c.child IS NULL THEN c.template ELSE c.template || '/' || coalesce(branch, '*') END AS template,
    CASE WHEN c.child IS NULL THEN c.purity ELSE coalesce(branch_purity, wild_purity) END AS purity
    FROM c{k} c LEFT JOIN w{k} USING (host, template) LEFT JOIN b{k} b ON c.host = b.host AND c.template = b.template AND c.child = b.child)""",
        ]
    return f"""WITH {", ".join(out)}
SELECT page_id, r.host, r.path, rule, template, coalesce(said, CASE WHEN purity >= {url_filter.BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r JOIN s{levels} USING (host, path)"""


def chat_repair() -> str:
    """A table of the lightest way to each state, row by row: costs and audits compare as pairs."""
    never = "{'c': CAST(1000000000 AS BIGINT), 'a': ''}"

    def after(state: str, cost: str, letter: str, when: str = "true") -> str:
        return f"CASE WHEN {when} THEN {{'c': CAST({state}.c + {cost} AS BIGINT), 'a': {state}.a || '{letter}'}} ELSE {never} END"

    stays, extra = "fault NOT IN (1, 2)", "CASE WHEN fault = 3 THEN 1 ELSE 0 END"

    def step(to: int, sources: tuple[int, ...], initial: str) -> str:
        ways = [after(f"s{to}", "3", "D")]
        ways += [after(f"s{s}", f"({extra})", "K", f"{stays} AND ini = '{initial}'") for s in sources]
        if initial != "s":
            ways += [after(f"s{s}", f"(2 + {extra})", "R", stays) for s in sources]
        return f"least({', '.join(ways)}) AS n{to}"

    users = f"least(n2, {after('n0', '2', 'I')}, {after('n1', '2', 'I')}, {after('n3', '2', 'I')})"
    bare = r"regexp_replace(text, '[\x09-\x0D\x20]+$', '')"
    return f"""WITH RECURSIVE {CRC_TABLE},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT src.*, {crc32('k')} % 20 AS kind FROM src, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, {bare} AS bare FROM numbered),
rows AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
    CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM seen),
convs AS (SELECT DISTINCT conv_id FROM conversations),
ways AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS s0, {never} AS s1, {{'c': CAST(2 AS BIGINT), 'a': 'I'}} AS s2, {{'c': CAST(4 AS BIGINT), 'a': 'II'}} AS s3 FROM convs
    UNION ALL
    SELECT conv_id, i, n0, n1, m2, least(n3, {after('m2', '2', 'I')}) FROM (SELECT *, {users} AS m2 FROM (
        SELECT w.conv_id, r.i, {step(0, (), 's')}, {step(1, (0,), 's')}, {step(2, (0, 1, 3), 'u')}, {step(3, (2,), 'a')}
        FROM ways w JOIN rows r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1))
),
best AS (SELECT conv_id, arg_max(least(s0, s3), i) AS way FROM ways GROUP BY conv_id),
letters AS (SELECT conv_id, p, substr(way.a, CAST(p AS INTEGER), 1) AS letter FROM (SELECT conv_id, way, unnest(range(1, length(way.a) + 1)) AS p FROM best)),
matched AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS at_row FROM letters),
made AS (SELECT m.conv_id, p, letter, CASE WHEN letter = 'I' THEN '' ELSE r.text END AS text, r.role, row_number() OVER (PARTITION BY m.conv_id ORDER BY p) AS place
    FROM matched m LEFT JOIN rows r ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.at_row = r.i WHERE letter <> 'D'),
opened AS (SELECT conv_id, CASE WHEN letter = 'K' AND substr(role, 1, 1) = 's' THEN 1 ELSE 0 END AS shift FROM made WHERE place = 1),
texts AS (SELECT made.conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole
    FROM made JOIN opened ON made.conv_id IS NOT DISTINCT FROM opened.conv_id GROUP BY made.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    way.c AS cost, way.a AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON b.conv_id IS NOT DISTINCT FROM t.conv_id"""


def chat_trie() -> str:
    """A prefix is the list of its turns' digests; what stands below a node is summed over its members' booked nodes."""
    return f"""WITH {CRC_TABLE},
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, max(n) AS own FROM turns GROUP BY c),
given AS (SELECT own.*, {crc32('CAST(c AS VARCHAR)')} % 6 AS h, c - c % 100 AS base FROM own, crc),
chats AS (SELECT g.c, g.own, h, base, least(h, coalesce(o.own, 0)) AS b FROM given g LEFT JOIN own o ON g.base = o.c),
whole AS (
    SELECT t.c, n - h + b AS d, role, text FROM turns t JOIN chats USING (c) WHERE n > h
    UNION ALL SELECT chats.c, n, role, text FROM chats JOIN turns t ON t.c = base WHERE n <= b
),
members AS (
    SELECT c, d, length(text) AS size, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS prefix FROM whole
    UNION ALL SELECT c, 0, 0, '' FROM chats
),
nodes AS (SELECT prefix, min(c) AS conv_id, max(d) AS depth, count(*) AS n_convs, max(size) AS size FROM members GROUP BY prefix),
above AS (SELECT prefix AS child, left(prefix, length(prefix) - 32) AS prefix FROM nodes WHERE prefix <> ''),
kids AS (SELECT prefix, count(*) AS n_children FROM above GROUP BY prefix),
valued AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * size AS saved FROM nodes LEFT JOIN kids USING (prefix)),
below AS (SELECT m.prefix, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM members m JOIN valued v ON v.conv_id = m.c AND v.depth >= m.d GROUP BY m.prefix),
lengths AS (SELECT c, max(d) AS total FROM members GROUP BY c),
ends AS (SELECT prefix, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM members JOIN lengths USING (c) WHERE d = total GROUP BY prefix)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM valued v JOIN below USING (prefix) LEFT JOIN above a ON v.prefix = a.child LEFT JOIN nodes p ON a.prefix = p.prefix LEFT JOIN ends ON v.prefix = ends.prefix"""
