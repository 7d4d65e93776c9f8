"""Each operator against its contract in plain Python, on driver tables and on a table of awkward rows."""

from __future__ import annotations

import random
import sys

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import (
    decontaminate,
    entropy_mix,
    jaccard_join,
    language_mix,
    line_dedup,
    page_diff,
    quality_ranking,
    quality_rules,
    token_counts,
    token_files,
)
from riskloom.llm.queries import QUERIES

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box up zinc jars for export"
LINE = "this long line of more than forty characters stands in many documents"
ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, PROSE.upper() + " today", None, None),
    (4, None, "en", "a"),
    (5, "", None, "b"),
    (6, " \t\n\x0b ", "xx", ""),
    (7, "one two", "en", "é"),
    (8, "ONE  two\n", "en", "b"),
    (9, "\n".join([LINE, "x", LINE, f"  {LINE.upper()}\t"]), "en", "b"),
    (10, f"{LINE}\n{LINE}", "en", "b"),
    (11, f"a\n{LINE}", "fr", "b"),
    (12, f"{LINE}\r\nb\n\n", "fr", "b"),
    (13, f"c\x1c{LINE}\n{LINE}", "fr", None),
    (13, f"c\x1c{LINE}\n{LINE}", "fr", None),
    (14, "αβγ δεζ 東京 " * 40 + "#*$ <|endoftext|> ́x", "el", "z"),
    (15, "word " * 30000, "en", "long"),
    (16, " ".join(f"w{i}" for i in range(8000)), "en", "long"),
    (17, " ".join(f"w{i}" for i in range(7990)) + " end", "en", "long"),
    (18, "1234 5678 ... !!!", "en", "a"),
    (19, "don't we'll   sep arated 　 i̇ İ ǅ ﬁ", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
ITEMS = [(1, " ".join(PROSE.split()[2:17])), (2, "seven wizards"), (2, "seven wizards"), (3, None), (4, ""), (None, "zinc jars"), (10, "w100 " + " ".join(f"w{i}" for i in range(101, 120)))]


@pytest.fixture(scope="module")
def awkward(spark):
    """With null ids' worth of trouble, repeated rows, and columns named as operators name theirs."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    clash = {c: F.lit(c) for c in ("_size", "_src", "n_words", "kept", "key", "doc", "own0", "_copies", "list", "w", "text_hash", "shard")}
    return docs.withColumns(clash)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def docs(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


AWKWARD = [(d, t) for d, t, *_ in ROWS]


def by_doc(df, *columns, doc="doc_id"):
    return {r[doc]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


# ---- 1 quality rules


def check_counts(df, docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = by_doc(df, *names)
    for d, t in docs:
        want = plain.quality_counts(t)
        assert got[d] == tuple(want[n] for n in names), d


def test_quality_rules(spark, sf_dir, docs, awkward, empty):
    out = QUERIES["op1_quality_rules"](spark, sf_dir)
    check_counts(out, docs)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in out.collect())
    check_counts(quality_rules.counts(awkward), AWKWARD)
    kept = quality_rules.keep_good(awkward)
    assert kept.columns == awkward.columns
    assert {4, 5, 6, 7, 15}.isdisjoint(r.doc_id for r in kept.collect())
    assert quality_rules.keep_good(empty).count() == 0


def test_rules_find_poor_texts_without_labels(spark, sf_dir):
    verdict = by_doc(QUERIES["op1_quality_rules"](spark, sf_dir.replace("sf0.001", "sf0.01")), "kept", "base_failed")
    labels = pq.read_table(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet").to_pylist()
    good = [verdict[x["doc_id"]] for x in labels if x["quality"] == 1]
    poor = [verdict[x["doc_id"]] for x in labels if x["quality"] == 0]
    assert np.mean([kept for kept, base in good if not base]) > 0.98
    assert np.mean([kept for kept, _ in poor]) < 0.2


# ---- 2 token counts


def test_token_counts(spark, sf_dir, docs, awkward, empty):
    pieces = token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    first, later = {p[1:] for p in pieces if p[0] == "▁" and len(p) > 1}, {p for p in pieces if p[0] != "▁"}
    memo: dict[str, int] = {}

    def count(text):
        return sum(memo.setdefault(w, 0) or memo.update({w: plain.greedy_pieces(w, first, later, "▁" in pieces)}) or memo[w] for w in (text or "").split())

    out = by_doc(QUERIES["op2_token_counts"](spark, sf_dir), "n_words", "n_tokens")
    assert out == {d: (len(t.split()), count(t)) for d, t in docs}
    odd = by_doc(token_counts.token_counts(awkward, public_tokenizers.path("piece_bpe_32k.model")), "n_tokens")
    assert odd == {d: count(t) for d, t in AWKWARD}
    assert token_counts.token_counts(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_automaton_with_gaps():
    pieces = ["▁", "▁ab", "▁abcde", "b", "bc", "cd", "cdx", "e", "ee"]
    first, later = {"ab", "abcde"}, {p for p in pieces if p[0] != "▁"}
    machine, pick = token_counts.Automaton(pieces), np.random.default_rng(3)
    for _ in range(3000):
        word = "".join(pick.choice(list("abcdexé"), pick.integers(1, 12)))
        assert machine.count(word) == plain.greedy_pieces(word, first, later, True), word


# ---- 3 and 4 learned scores, by held-out rows


def test_quality_ranking(spark, sf_dir, awkward, empty):
    out = by_doc(QUERIES["op3_quality_ranking"](spark, sf_dir.replace("sf0.001", "sf0.01")), "held_out", "score", "predicted")
    labels = {x["doc_id"]: x["quality"] for x in pq.read_table(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet").to_pylist()}
    held = [(labels[d], s, p) for d, (h, s, p) in out.items() if h and d in labels]
    good, poor = [s for q, s, _ in held if q], [s for q, s, _ in held if not q]
    assert np.mean([g > b for g in good for b in poor]) > 0.95
    assert np.mean([p == q for q, _, p in held]) > 0.9
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for _, s, p in out.values())
    marks = spark.createDataFrame([(1, 1), (15, 0), (None, 0), (2, None), (99, 1)], "doc_id long, quality int")
    model = quality_ranking.fit(awkward, marks)
    assert quality_ranking.score(awkward, *model).count() == len(ROWS)
    assert quality_ranking.score(awkward, *quality_ranking.fit(awkward, marks.limit(0))).count() == len(ROWS)
    assert quality_ranking.score(empty, *model).count() == 0


def test_language_mix(spark, sf_dir, awkward, empty):
    lang = {x["doc_id"]: x["lang"] for x in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    out = by_doc(QUERIES["op4_language_mix"](spark, sf_dir), "held_out", "lang_pred")
    assert np.mean([p == lang[d] for d, (h, p) in out.items() if h]) > 0.9
    model = language_mix.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    odd = by_doc(language_mix.predict(awkward, model), "lang_pred", "score")
    assert all(odd[d] == ("und", 0.0) for d in (4, 5, 6, 18))
    assert language_mix.predict(empty, model).count() == 0
    assert by_doc(language_mix.predict(awkward, language_mix.fit(empty)), "lang_pred")[1] == "und"


def test_language_mix_finds_both_languages():
    a, b = np.full(language_mix.BINS, 1e-6), np.full(language_mix.BINS, 1e-6)
    x, y = language_mix.counted("lorem ipsum dolor sit amet")[0], language_mix.counted("zwölf boxkämpfer jagen viktor quer")[0]
    a[x], b[y] = 1.0, 1.0
    model = language_mix.Model(["a", "b"], np.stack([a / a.sum(), b / b.sum()], axis=1))
    grams, n = language_mix.counted("lorem ipsum dolor sit amet " * 3 + "zwölf boxkämpfer jagen")
    best, share, shares = model.proportions(grams, n)
    assert best == "a" and set(shares) == {"a", "b"} and 0.6 < share < 0.9
    assert model.proportions(*language_mix.counted("lorem ipsum"))[2] == {"a": 1.0}


# ---- 5 mixing


def test_source_mix(spark, sf_dir, awkward, empty):
    where = by_doc(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source")
    out = QUERIES["op5_source_mix"](spark, sf_dir).collect()
    again = QUERIES["op5_source_mix"](spark, sf_dir).collect()
    assert sorted(out) == sorted(again)
    sizes: dict = {}
    taken: dict = {}
    for r in out:
        s = where[r.doc_id]
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
        assert r.taken <= 3 * r.size
    want = plain.source_targets(sizes)
    for r in out:
        assert r.target == pytest.approx(want[where[r.doc_id]]) and r.source_size == sizes[where[r.doc_id]]
    for s, w in want.items():
        assert abs(taken[s] - w) <= 0.05 * w + 1, s
    odd = entropy_mix.mix(awkward)
    assert odd.count() == len(ROWS)
    mixed = entropy_mix.mixed(awkward)
    assert mixed.columns == awkward.columns and mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 6
    assert entropy_mix.mixed(empty).count() == 0


# ---- 6 pages


def test_page_diff(spark, sf_dir):
    out = QUERIES["op6_page_diff"](spark, sf_dir).collect()
    assert len(out) == pq.read_metadata(f"{sf_dir}/pages.parquet").num_rows
    assert all(r.n_chars == len(r.text) and r.text == " ".join(r.text.split()) for r in out)


def test_page_lines_and_differences(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>Top</header><nav><li>Home</nav><div class='cookie-notice'>We use"
        "</div><main><h1>Big &amp; small</h1><p>one<b>two</b>\n three<p>four<!-- <p>x --><script>var t='</p>'</script>"
        "<div class='comments'><p>first!</div><form>Name<input></form></main><aside>Also</aside><footer>End</footer>"
    )
    assert [t for t, s in page_diff.lines_of(page) if s == page_diff.ARTICLE] == ["Big & small", "onetwo three", "four"]
    rows = [
        (1, "http://h.org/a/1", "<div>Menu</div><p>Alpha</p><p>Shared end</p>"),
        (2, "https://H.org/a/2?x=1", "<div>Menu</div><p>Beta</p><p>Shared end</p>"),
        (3, "http://other.org/a/1", "<div>Menu</div><p>Gamma</p>"),
        (4, None, None),
        (5, "no host", "<p>Menu"),
        (6, "http://h.org/b", ""),
    ]
    got = by_doc(page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "text", doc="page_id")
    assert got == {1: "Alpha", 2: "Beta", 3: "Menu Gamma", 4: "", 5: "Menu", 6: ""}
    assert page_diff.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_extract(rows):
    """The same rules page by page, with a quadratic table for the subsequence."""
    kept = {}
    for k, (_, url, page) in enumerate(rows):
        host, path = page_diff.url_parts(url or "")
        kept[k] = (host, path, [x for x in page_diff.lines_of(page or "") if x[1] != page_diff.DROPPED])
    pages = {}
    for host, path, lines in kept.values():
        if lines:
            key = (host, page_diff.line_hash("\n".join(f"{s}{t}" for t, s in lines)))
            pages[key] = (min(path, pages[key][0]) if key in pages else path, lines)
    order = sorted(pages, key=lambda k: (k[0], pages[k][0], k[1]))
    gone, decided = {}, 0
    for i, key in enumerate(order):
        path, lines = pages[key]
        near, near_path = None, -1
        for j in (i - 1, i + 1):
            if 0 <= j < len(order) and order[j][0] == key[0]:
                n = next((m for m, (x, y) in enumerate(zip(path, pages[order[j]][0], strict=False)) if x != y), min(len(path), len(pages[order[j]][0])))
                if n > near_path:
                    near, near_path = order[j], n
        if near is None:
            continue
        a, b = [t for t, _ in lines], [t for t, _ in pages[near][1]]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                table[x + 1][y + 1] = table[x][y] + 1 if a[x] == b[y] else max(table[x][y + 1], table[x + 1][y])
        shared = page_diff.common_lines(a, b)
        assert len(shared) == table[-1][-1]
        copies = sum(len(a[x]) for x in shared) >= page_diff.NEAR * min(sum(map(len, a)), sum(map(len, b)))
        mine = [k for k in order if k[0] == key[0]]
        for x in shared:
            n = sum(a[x] in [t for t, _ in pages[k][1]] for k in mine)
            most, some = n >= max(3, len(mine) / 2), n >= min(3, len(mine))
            if (not copies and most) if lines[x][1] == page_diff.ARTICLE else (most or (not copies and some)):
                gone.setdefault(key, set()).add(x)
                decided += 1
    out = []
    for host, _, lines in kept.values():
        key = (host, page_diff.line_hash("\n".join(f"{s}{t}" for t, s in lines)))
        has = any(s == page_diff.ARTICLE for _, s in lines)
        out.append(" ".join(t for k, (t, s) in enumerate(lines) if k not in gone.get(key, ()) and (not has or s == page_diff.ARTICLE)))
    return out, decided


def test_pages_without_markup_against_plain_python(spark, sf_dir):
    """Hosts whose pages name no article: menus and notices go by differencing alone, copies and near copies keep their text."""
    pick = np.random.default_rng(11)

    def prose(n):
        return " ".join("".join(pick.choice(list("abcdefgh"), pick.integers(2, 9))) for _ in range(n))

    rows = []
    for h in range(4):
        menu, foot, notice = (prose(3) for _ in range(3))
        for k in range((1, 2, 9, 30)[h]):
            blocks = [menu, "Home", prose(40), prose(30) if k % 2 else prose(5), notice if k % 3 else prose(2), foot]
            wrap = "<article>{}</article>" if h == 3 and k % 2 else "{}"
            inner = "".join(f"<p>{x}</p>" for x in blocks)
            rows.append((len(rows), f"http://h{h}.org/{'ab'[k % 2]}/{k}", "<body>" + wrap.format(inner)))
    rows += [(900 + k, rows[5][1], rows[5][2]) for k in range(3)]  # repeated rows
    rows += [(910, rows[6][1] + "?copy", rows[6][2].replace("</p>", " more</p>", 1))]  # a near copy
    rows += [(920, None, "<p>alone"), (921, "http://empty.org/", None), (922, "http://h2.org/zz", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want, decided = plain_extract(rows)
    got = by_doc(page_diff.extract(pages.repartition(4)), "text", doc="page_id")
    assert [got[r[0]] for r in rows] == want
    assert decided > 80
    assert got[900] == got[901] == got[902] == got[5] and len(got[900].split()) > 30
    assert len(got[910].split()) > 30 and len(got[920]) == 5
    real = pq.read_table(f"{sf_dir}/pages.parquet").select(["page_id", "url", "html"]).to_pylist()
    want, _ = plain_extract([tuple(r.values()) for r in real])
    got = by_doc(QUERIES["op6_page_diff"](spark, sf_dir), "text", doc="page_id")
    assert [got[r["page_id"]] for r in real] == want


def test_titles_and_teasers():
    page = "<main><div class='article-header'><h1>Title</h1></div><article><p>Body</article></main><article><p>Teaser</article><div class='page-header'>Site</div>"
    assert page_diff.lines_of(page) == [("Title", page_diff.ARTICLE), ("Body", page_diff.ARTICLE), ("Teaser", page_diff.PLAIN), ("Site", page_diff.DROPPED)]


def test_common_lines_are_longest():
    pick = np.random.default_rng(5)
    for _ in range(300):
        a, b = ([str(x) for x in pick.integers(0, 4, pick.integers(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        got = sorted(page_diff.common_lines(a, b))
        rest = iter(b)
        assert len(got) == table[-1][-1] and all(a[k] in rest for k in got)


# ---- 7 lines


def test_line_dedup(spark, sf_dir, docs, awkward, empty):
    names = ("n_lines", "n_dropped", "kept_sha256")
    assert by_doc(QUERIES["op7_line_dedup"](spark, sf_dir), *names) == plain.line_dedup(docs)
    kept = line_dedup.apply_bitmaps(awkward, line_dedup.keep_bitmaps(awkward))
    assert kept.count() == len(ROWS)
    got = by_doc(kept.withColumn("kept_sha256", F.sha2("kept_text", 256)), *names)
    assert got == plain.line_dedup(AWKWARD)
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty)).count() == 0


@pytest.mark.parametrize("parts", [2, 8, 4000])
def test_line_streams_with_and_without_hot_keys(spark, parts):
    """One line stands in every document, one in every third, some in four to six; the more ranges, the more keys count as hot."""
    everywhere, often, few = LINE, LINE[::-1], [f"{LINE} {k}" for k in range(40)]
    rows = [(d, "\n".join([everywhere, f"own words of document {d}", *([often] * 2 if d % 3 == 0 else []), *few[d // 5 : d // 5 + 1 + d % 2]])) for d in range(200)]
    rows += [(7, "\n".join([often, everywhere, "another text of one id"])), (None, everywhere)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    lines = line_dedup.written(line_dedup.keyed_lines(docs).filter("doc IS NOT NULL"), "line_keys")
    hot = line_dedup.hot_keys(lines, parts)
    assert hot.count() == {2: 2, 8: 2}.get(parts, lines.groupBy("key").count().filter("count > 1").count())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(min(parts, 16)))
        later = line_dedup.later_lines(lines)
        plan = later._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        got = {(r.doc, r.text_hash, r["at"]) for r in later.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    held: dict[bytes, set[int]] = {}
    stands = lines.collect()
    for r in stands:
        held.setdefault(bytes(r.key), set()).add(r.doc)
    assert got == {(r.doc, r.text_hash, r["at"]) for r in stands if len(held[bytes(r.key)]) >= 5 and r.doc < max(held[bytes(r.key)])}
    assert sorted(r.n_dropped for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).filter("doc_id IS NULL").collect()) == [0]


# ---- 8 token files


def test_token_files(spark, sf_dir, docs, awkward, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    names = ("start", "n_tokens", "ids_crc32")
    assert by_doc(QUERIES["op8_token_files"](spark, sf_dir), *names) == plain.token_ids(docs, path)
    got = token_files.read_segments(token_files.write_segments(awkward, path))
    want = plain.token_ids([(d, t or "") for d, t in AWKWARD], path)
    assert got.count() == len(ROWS)
    assert {d: v[1:] for d, v in by_doc(got, *names).items()} == {d: v[1:] for d, v in want.items()}
    assert token_files.read_segments(token_files.write_segments(empty, path)).count() == 0


def _each(ids: token_files._Ids, texts: list[str], kind: pa.DataType | None = None) -> list[list[int]]:
    out, column = [], pa.array(texts, kind or pa.string())
    for first, stop in token_files._slices(column):
        got, counts = ids.of(column.slice(first, stop - first), token_files.END_ID)
        assert len(got) == counts.sum()
        out += [x.tolist() for x in np.split(got, np.cumsum(counts))[:-1]]
    return out


@pytest.mark.parametrize("size", [1, 60, 1 << 20])
def test_ids_of_slices_of_texts(monkeypatch, size):
    """Runs and pieces of odd characters, in slices of one text and of many, with a memory that forgets, and by whole texts."""
    monkeypatch.setattr(token_files, "SLICE", size)
    pick = random.Random(8)
    parts = [*"abXYZ019'.,!<>|\n\n   \t\xa0\x00", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "\u00e9", "e\u0301", "H\u0331", "\u0130", "\u0131", "\u03a3", "\u4e2d", "\u212b", "\U0001f600"]
    texts = ["", " ", "\n", *("".join(pick.choices(parts, k=pick.randrange(30))) for _ in range(1500))]
    ids = token_files._Ids(str(public_tokenizers.path("word_bpe_49k.json")))
    want = [[*e.ids, token_files.END_ID] for e in ids.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids.words and _each(ids, texts) == want
    ids.runs.half = ids.pieces.half = 5
    assert _each(ids, texts, pa.large_string()) == want
    ids.pattern = None
    assert _each(ids, texts) == want


def test_python_calls_follow_distinct_pieces_not_runs():
    """40,000 distinct runs of 400 pieces: no call of Python's for each run."""
    pick = random.Random(3)
    names = ["".join(pick.choices("abcdefgh", k=7)) for _ in range(400)]
    texts = [" ".join(f"{a}.{b}" for b in names[:100]) for a in names]
    ids, calls = token_files._Ids(str(public_tokenizers.path("word_bpe_49k.json"))), []
    ids.of(pa.array(["a first call imports modules"]), token_files.END_ID)
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        ids.of(pa.array(texts), token_files.END_ID)
    finally:
        sys.setprofile(None)
    assert len(calls) < 20_000


def test_packed_ids_of_every_width():
    pick = np.random.default_rng(4)
    for width in range(33):
        ids = pick.integers(0, 1 << width, 700, dtype=np.uint64).astype(np.uint32)
        payload = token_files.pack(ids, [1], [700])
        assert (token_files.unpack(payload)[0] == ids).all() and (token_files.unpack(payload, 1, 2)[0] == ids[256:512]).all()


def test_packed_ids_round_trip():
    pick = np.random.default_rng(9)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = pick.integers(0, 300, n).astype(np.uint32)
        ids[pick.random(n) < 0.02] = np.uint32(0xFFFFFFFF)
        payload = token_files.pack(ids, [7, None], [n, 0])
        back, docs, lengths = token_files.unpack(payload)
        assert (back == ids).all() and docs == [7, None] and lengths.tolist() == [n, 0]
        part, _, _ = token_files.unpack(payload, 1, 3)
        assert (part == ids[256:768]).all()


# ---- 9 decontamination


def test_decontaminate(spark, sf_dir, docs, awkward, empty):
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pydict()
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    out = by_doc(QUERIES["op9_decontaminate"](spark, sf_dir), *names)
    assert out == plain.contamination(docs, list(zip(items["item_id"], items["text"], strict=True)))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.contamination(awkward, bench)
    assert found.count() == len(ROWS)
    got = by_doc(found, "n_words", "n_hit", "contaminated", doc="doc")
    want = plain.contamination(AWKWARD, ITEMS)
    assert got == {d: (v[0], v[1], v[4]) for d, v in want.items()}
    assert by_doc(found, "items", doc="doc")[1] == ["1", "2"]
    left = decontaminate.drop_contaminated(awkward, bench)
    assert left.columns == awkward.columns and {r.doc_id for r in left.collect()} == {d for d, v in want.items() if not v[4]}
    assert decontaminate.drop_contaminated(awkward, bench.limit(0)).count() == len(ROWS)
    assert decontaminate.drop_contaminated(empty, bench).count() == 0


# ---- 10 Jaccard join


def test_jaccard_join(spark, sf_dir, docs, awkward, empty):
    out = by_doc(QUERIES["op10_jaccard_join"](spark, sf_dir), "n_shingles", "component_id")
    assert out == plain.similar_groups(docs)
    odd = jaccard_join.similar_groups(awkward)
    assert odd.count() == len(ROWS)
    assert by_doc(odd, "n_shingles", "component_id", doc="doc") == plain.similar_groups(AWKWARD)
    kept = jaccard_join.keep_one(awkward)
    assert kept.columns == awkward.columns
    want = plain.similar_groups(AWKWARD)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    assert jaccard_join.keep_one(empty).count() == 0


def test_jaccard_join_on_small_sets_and_families(spark):
    pick = np.random.default_rng(11)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for d in range(400):
        words = list(base[: pick.integers(5, 24)] if d % 2 else base)
        for k in pick.integers(0, len(words), pick.integers(0, 4)):
            words[k] = f"x{pick.integers(0, 3)}"
        rows.append((d * 3, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_doc(jaccard_join.similar_groups(df), "n_shingles", "component_id", doc="doc") == plain.similar_groups(rows)


# ---- the pipeline


def test_pipeline(spark, sf_dir, docs):
    """Later stages against plain Python on what the stages before them kept."""
    frame, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")
    columns, kept = frame.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.written(stage(spark, frame, sf_dir), "stage")
        assert frame.columns == columns
        kept.append(sorted((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()))
    groups = plain.similar_groups(kept[0])
    assert [d for d, _ in kept[1]] == [d for d, _ in kept[0] if groups[d][1] == d]
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pydict()
    dirty = plain.contamination(kept[1], list(zip(items["item_id"], items["text"], strict=True)))
    assert [d for d, _ in kept[2]] == [d for d, _ in kept[1] if not dirty[d][4]]
    assert set(kept[3]) <= set(kept[2])
    last = corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir)
    got = sorted(tuple(r) for r in last.select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    start = 0
    for (s, d, n, crc), (d2, t) in zip(got, kept[3], strict=True):
        assert (s, d) == (start, d2) and plain.token_ids([(d, t)], path)[d][1:] == (n, crc)
        start += n
