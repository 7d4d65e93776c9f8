"""URL filters, conversation repair and the prefix trie against plain Python, on awkward rows and with every size switch set low."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from riskloom.llm import chat_repair, chat_trie, url_filter
from riskloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def chats(sf_dir):
    t = pq.read_table(f"{sf_dir}/conversations.parquet").to_pydict()
    return list(zip(t["conv_id"], t["turn"], t["role"], t["text"], strict=True))


# ---- 11 URL filters


def rule_and_place(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fitting = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fitting, key=lambda r: len(str(r)), default=None)


URLS = [
    None, "", "no scheme", "://", "HTTP://A.Example.ORG/es/1", "http://example.org", "http://example.org?x", "http://example.org/en/1?u://v", "http://notexample.org/es/2",
    "x://org/en/1", "http://com/fr/", "http://é.com/de/ü#x", "http://a.com/de", "http://b.net/" + "deep/" * 300, "http://b.net/" + "y" * 100_000, "http://h/a\nb/c", "http://u@c.com:80/fr/1",
]


def test_url_parts_and_rules(spark, sf_dir):
    rows = spark.createDataFrame([(i, u, "mine", 7, 8) for i, u in enumerate(URLS * 2)], "page_id long, url string, kept string, n long, own0 long")
    out = url_filter.judge(rows)
    assert out.columns[:5] == rows.columns
    got = out.collect()
    assert len(got) == len(URLS) * 2
    for r in got:
        host, path, rule = rule_and_place(r.url)
        assert (r.host, r.path, r.rule, r.kept, r.n) == (host, path, str(rule) if rule else None, "mine", 7)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    by_url = {}
    for r in got:
        assert by_url.setdefault(r.url, (r.verdict, r.template)) == (r.verdict, r.template)
    assert url_filter.judge(rows.limit(0)).count() == 0
    for r in QUERIES["op11_url_filters"](spark, sf_dir.replace("sf0.001", "sf0.01")).collect():
        assert r.verdict in ("allow", "block")
        assert r.rule is None or r.verdict == next(x.verdict for x in url_filter.RULES if str(x) == r.rule)


def test_own_columns_named_like_results_are_replaced(spark):
    rows = spark.createDataFrame([(1, "http://a.com/de/1", "old", "old")], "page_id long, url string, host string, verdict string")
    (r,) = url_filter.judge(rows).collect()
    assert (r.host, r.verdict) == ("a.com", "block")


def test_template_tree_learns_from_rules(spark):
    """One host whose labelled branch is blocked, one that is allowed, and pages that no rule decides in each."""
    urls = [f"http://bad.com/de/{i}" for i in range(60)] + [f"http://bad.com/en/{i}" for i in range(30)]
    urls += [f"http://good.com/fr/{i}" for i in range(60)] + [f"http://good.com/en/{i}" for i in range(30)]
    # Two branches that only differ in their name are one template; numbers become a wildcard.
    urls += [f"http://mix.com/{b}/{i}" for b in ("en", "es") for i in range(50)] + [f"http://mix.com/about/page-{i}.html" for i in range(50)]
    urls += [f"http://x.net/user/{i}/photos" for i in range(40)]
    got = {r.url: r for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got["http://bad.com/en/3"].verdict == "block" and got["http://good.com/en/3"].verdict == "allow"
    assert got["http://mix.com/en/1"].template == got["http://mix.com/es/7"].template == "/{en|es}/*"
    assert got["http://mix.com/about/page-1.html"].template == "/about/*"
    assert got["http://x.net/user/8/photos"].template == "/user/*/photos"
    assert got["http://x.net/user/8/photos"].verdict == "allow"


# ---- 12 conversation repair


def damaged(rows):
    """Rows after damage by conversation, None standing for a conversation without rows."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        out[c] += [(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def repaired(rows):
    """Counts, cost and audit by trying, row after row, every edit from every state: all of the least (cost, audit) pairs."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    turns, seen, faults = [t for t, *_ in rows if t is not None], set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    ways = {"": (0, "", ())}

    def put(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserted(ways):
        for _ in range(3):
            for state, (cost, audit, made) in list(ways.items()):
                for name in ("user", "assistant"):
                    if (to := step.get((state, name[0]))) is not None:
                        put(ways, to, (cost + 2, audit + "I", (*made, (name, ""))))
        return ways

    ways = inserted(ways)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, made) in ways.items():
            put(after, state, (cost + 3, audit + "D", made))
            if fault in (1, 2):
                continue
            more = cost + (fault == 3)
            if (to := step.get((state, role[:1]))) is not None:
                put(after, to, (more, audit + "K", (*made, (role, text))))
            for name in ("user", "assistant"):
                if (to := step.get((state, name[0]))) is not None:
                    put(after, to, (more + 2, audit + "R", (*made, (name, text))))
        ways = inserted(after)
    cost, audit, made = min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest), made


def summary(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def noisy(seed, n):
    """Conversations with every kind of trouble: odd roles, nulls, repeats, gaps, rows that share a turn."""
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u", "Assistant"], ["Hi.", "yes", "no!", " \n", None, "", "why? ", "a\nb.", "x" * 5000 + "."]
    return [(rng.randrange(6) if rng.random() > 0.05 else None, rng.randrange(30) if rng.random() > 0.05 else None, rng.choices(roles, [6, 6, 1, 1, 1, 1, 1, 1])[0], rng.choice(texts)) for _ in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_query_against_plain_python(spark, sf_dir, chats):
    want = damaged(chats)
    got = summary(QUERIES["op12_chat_repair"](spark, sf_dir))
    assert got == {c: repaired(want[c])[0] for c in {c for c, *_ in chats}}


@pytest.mark.parametrize("limit,block", [(1024, 512), (4, 3), (0, 1), (20, 512)])
def test_repair_of_noisy_rows_whole_and_in_blocks(spark, limit, block):
    rows = noisy(limit + block, 240)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    held = damaged(rows)
    want = {c: repaired(held[c]) for c in {c for c, *_ in rows}}
    assert summary(chat_repair.summaries(chat_repair.damage(frame), limit, block)) == {c: w[0] for c, w in want.items()}
    turns = defaultdict(dict)
    for c, place, role, text in chat_repair.repaired_turns(chat_repair.damage(frame), limit, block).collect():
        turns[c][place] = (role, text)
    assert {c: tuple(t[k] for k in sorted(t)) for c, t in turns.items()} == {c: w[1] for c, w in want.items() if w[1]}


def test_repaired_conversations_are_legal_and_stay_as_they_are(spark, chats):
    frame = spark.createDataFrame(noisy(3, 200), SCHEMA)
    turns = chat_repair.repaired_turns(chat_repair.plain(frame)).withColumnRenamed("place", "turn")
    by_chat = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.turn)):
        by_chat[r.conv_id].append(r.role[:1])
    for initials in by_chat.values():
        held = "".join(initials).removeprefix("s")
        assert held == "ua" * (len(held) // 2)


def test_agenda_pops_weights_in_order():
    """Every state's weight is the least over all derivations, from any start."""
    rng = random.Random(5)
    for _ in range(200):
        rows = [(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randrange(5))]
        for start in range(4):
            best = {start: (0, "")}

            def closed(ways):
                for _ in range(3):
                    for state, (cost, audit) in list(ways.items()):
                        for r in "ua":
                            if (to := chat_repair.STEP[state].get(r)) is not None:
                                ways[to] = min(ways.get(to, (99, "")), (cost + 2, audit + "I"))
                return ways

            best = closed(best)
            for initial, fault in rows:
                after = {}
                for state, (cost, audit) in best.items():
                    for letter, r, more in chat_repair.edits(initial, fault):
                        to = state if not r else chat_repair.STEP[state].get(r)
                        if to is not None:
                            after[to] = min(after.get(to, (99, "")), (cost + more, audit + letter))
                best = closed(after)
            assert chat_repair.lightest(rows, start, None) == best


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_repair.summaries(chat_repair.damage(empty)).count() == 0
    assert chat_repair.repaired_turns(chat_repair.plain(empty)).count() == 0


def test_a_conversation_of_one_row_many_times(spark):
    """Equal rows spread over partitions and all but the first go."""
    frame = spark.createDataFrame([(1, 5, "user", "Hello.")] * 700 + [(1, 6, "assistant", "Yes.")], SCHEMA).withColumn("extra", chat_repair.F.lit(1))
    (r,) = chat_repair.summaries(chat_repair.plain(frame), 10, 16).collect()
    assert (r.duplicate, r.cost, r.audit, r.illegal) == (699, 3 * 699, "K" + "D" * 699 + "K", 699)


# ---- 13 prefix trie


def nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for *_, role, text in sorted(v)] for c, v in own.items()}
    chats = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        chats[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(set), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(chats[c]) == len(p)))).encode()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_trie_query_against_plain_python(spark, sf_dir, chats):
    assert found(QUERIES["op13_chat_trie"](spark, sf_dir)) == nodes(chats)


CHATS = (
    [(100 * (i % 3) + i % 7, i % 5, "user", f"t{i % 5 % 3}") for i in range(300)]  # each row many times
    + [(None, 1, "user", "x"), (700, None, None, None), (701, 1, "user", ""), (799, 1, "user", "é😀"), (799, 2, None, "z" * 50_000)]
    + [(500, i % 50, "user", f"t{i % 50 % 2}") for i in range(400)]  # one that fills many partitions
    + [(c, t, "user", "same") for c in range(900, 960) for t in range(9)]  # a large group of copies
)


@pytest.mark.parametrize("cells", [1 << 16, 64])
def test_trie_of_awkward_rows(spark, cells):
    """Few cells make most estimates wrong: the exact grouping behind them finds the same nodes."""
    frame = spark.createDataFrame(CHATS, SCHEMA).repartition(6).withColumns({c: chat_trie.F.lit(c) for c in ("c", "d", "n", "part", "h1", "total", "leaf")})
    assert found(chat_trie.trie(frame, cells, cells)) == nodes(CHATS)


def test_trie_of_nothing(spark):
    assert found(chat_trie.trie(spark.createDataFrame([], SCHEMA))) == []
    assert found(chat_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []


def test_only_possibly_shared_prefixes_are_grouped(spark):
    """Without shared prefixes the sketch proves nearly all of them single."""
    rows = [(c, t, "user", f"{c} {t}") for c in range(300) for t in range(8)]
    turns = chat_trie.placed_turns(spark.createDataFrame(rows, SCHEMA), len(rows))
    turns = turns.selectExpr("c", "n AS d", "xxhash64(n, h1) AS g1", "xxhash64(n, h2) AS g2")
    along = chat_trie.running(turns, "c", [chat_trie.F.col("d")], 8, xors=("g1", "g2"))
    digests = along.selectExpr("xor_g1 AS x1", "xor_g2 AS x2", "xor_g1 ^ g1 AS p1", "xor_g2 ^ g2 AS p2")
    assert chat_trie.screened(digests, 1 << 16).filter("shared").count() < 0.05 * len(rows)


def test_running_totals_over_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randrange(-9, 9), rng.randrange(-(1 << 62), 1 << 62)) for i in range(500)]
    got = chat_trie.running(spark.createDataFrame(rows, "k long, at long, a long, x long"), "k", [chat_trie.F.col("at")], 8, ("a",), ("x",))
    state: dict = {}
    for k, at, a, x in sorted(rows):
        n, total, mixed = state.get(k, (0, 0, 0))
        state[k] = (n + 1, total + a, mixed ^ x)
        state[k, at] = state[k]
    assert {(r.k, r.at): (r.n, r.sum_a, r.xor_x) for r in got.collect()} == {k: v for k, v in state.items() if isinstance(k, tuple)}
