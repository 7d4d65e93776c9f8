"""Exact n-gram Jaccard join: a size-aware join with a light and a heavy side, and the groups that its links make.

A document's set holds 64-bit hashes of its word shingles. Two sets link if their Jaccard similarity reaches a bound (three
quarters); the work goes in steps, each of which loses no link:

1. Equal sets become one node, so copies never meet as pairs.
2. A linked pair shares several of each side's hash-least shingles (its region). Nodes that share too few of theirs with any other
   node are left out; only region entries are shuffled, and what a task can tell from its own rows is not sent.
3. Of the rest, shingles that one node alone has can't match and are left out; nodes without enough others too.
4. Small sets list the fixed-size subsets that any partner must share with them; large sets list the rare end of their shingles,
   and the inverted lists of these are scanned. The size where the listing changes is chosen by cost.
5. Lists link their members to hubs first, a few rounds of one pair a list place. Members that are then in one group need no more
   pairs; only members of other groups than their list's largest meet the rest, where sizes and shared shingles allow a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import shielded, small, text_of, unshielded, written

SHINGLE = 5
#: Similarity bound as a fraction.
NEED, OF = 3, 4
#: Share of a set that its region holds beyond the part that a partner may lack.
SLACK = 0.08
#: Sizes up to which listing subsets is weighed against scanning lists.
LIGHT_LIMIT = 24
#: Bytes of text that a task hashes at once, and region entries that it combines before sending.
CHUNK, COMBINE = 1 << 20, 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    value = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    value[65:91] = value[97:123]  # A-Z as a-z
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    value[blank] = 0
    return value, blank


VALUE, BLANK = _tables()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def _powers(n: int, _held: list = []) -> np.ndarray:  # noqa: B006  grows once a worker
    if not _held or len(_held[0]) < n:
        _held[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 256), np.uint64(0x5851F42D4C957F2D))]))]
    return _held[0]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in UTF-8 ``data``, whose documents begin at ``starts``, and each document's number of words."""
    inside = ~BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = starts[starts < len(data)]
    begins[heads] = inside[heads]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    body = data[first[0] :]
    length = np.diff(np.append(first, len(data)))
    place = np.arange(first[0], len(data)) - np.repeat(first, length)
    place *= inside[first[0] :]
    hashes = np.add.reduceat(VALUE[body] * _powers(int(place.max()) + 1)[place], first - first[0])
    edges = np.searchsorted(first, np.append(starts, len(data)))
    return _mixed(hashes), np.diff(edges)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text: of all its words together if there are fewer than five, none without words."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        raw, size, start = [], 0, at
        while at < len(texts) and (not raw or size < CHUNK):
            raw.append(texts[at].encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
            at += 1
        lengths = np.array([len(r) for r in raw], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        hashes, counts = word_hashes(np.frombuffer(b"".join(raw), np.uint8), starts)
        if len(hashes) >= SHINGLE:
            grams = hashes[: 1 - SHINGLE].copy()
            for k in range(1, SHINGLE):
                grams = (grams ^ (grams >> np.uint64(29))) * _MIX + hashes[k : len(hashes) - SHINGLE + 1 + k]
            grams = _mixed(grams)
        else:
            grams = np.zeros(0, np.uint64)
        first = 0
        for n in counts.tolist():
            if n >= SHINGLE:
                s = np.sort(grams[first : first + n - SHINGLE + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif n:
                s = np.array([n], np.uint64)
                for h in hashes[first : first + n]:
                    s = (s ^ (s >> np.uint64(29))) * _MIX + h
                out.append(_mixed(s))
            else:
                out.append(np.zeros(0, np.uint64))
            first += n
    return out


def least_shared(n: int) -> int:
    """Shingles that any partner of a set of ``n`` must share with it."""
    return -(-NEED * n // OF)


def region(n: int) -> tuple[int, int]:
    """Length of a set's region, and how many of it a partner's region must hold.

    Sets that share ``c`` of their elements share ``k`` of their ``n - c + k`` least ones.
    """
    c = least_shared(n)
    k = min(c, max(1, int(SLACK * n)))
    return n - c + k, k


def _node(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``key`` identifies a row's text: the document id or, without one, the text's hash."""
    body = text_of(text)
    hashed = F.xxhash64(body)
    return docs.select(F.coalesce(F.col(doc).cast("long"), hashed).alias("key"), F.col(doc).cast("long").alias("doc"), hashed.alias("text_hash"), body.alias("text"))


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def node_table(rows: DataFrame) -> DataFrame:
    """``key``, ``doc``, ``text_hash``, ``n`` (set size) and ``node`` (16 bytes that name the set; null for an empty one) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist())
            own = {c: batch.column(c) for c in ("key", "doc", "text_hash")}
            yield _batch(own | {"n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array([_node(s) for s in sets], pa.binary())})

    return written(rows.mapInArrow(run, "key long, doc long, text_hash long, n long, node binary"), "nodes")


def _short(node: bytes) -> int:
    return int.from_bytes(node[:8], "big", signed=True)


def region_counts(rows: DataFrame) -> DataFrame:
    """``short`` (first 8 bytes of a node) and ``shared``: at least the number of its region's shingles that other nodes' regions hold.

    A task combines its entries before they are shuffled: a shingle of several of its nodes is settled for these and announced in one
    row. So a shingle that a third of all documents hold comes to one row a combined batch.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            names = np.array(list(held), np.int64)
            owner = np.repeat(np.arange(len(names)), [len(v) for v in held.values()])
            tokens = np.concatenate(list(held.values()))
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            same = tokens[1:] == tokens[:-1]
            multiple = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            first = multiple & np.concatenate([[True], ~same])
            alone = ~multiple
            settled = np.bincount(owner[multiple], minlength=len(names))
            some = np.flatnonzero(settled)
            token = np.concatenate([tokens[alone], tokens[first]]).view(np.int64)
            node = np.concatenate([names[owner[alone]], names[owner[first]]])
            n = np.concatenate([np.zeros(alone.sum(), np.int32), np.full(first.sum(), -1, np.int32)])
            # What is settled travels under the node's own name.
            token, node, n = np.concatenate([token, names[some]]), np.concatenate([node, names[some]]), np.concatenate([n, settled[some].astype(np.int32)])
            for k in range(0, len(token), 1 << 17):
                yield _batch({"token": pa.array(token[k : k + (1 << 17)]), "node": pa.array(node[k : k + (1 << 17)]), "n": pa.array(n[k : k + (1 << 17)])})

        for batch in batches:
            for s in shingle_sets(batch.column("text").to_pylist()):
                if len(s) and (name := _short(_node(s))) not in held:
                    held[name] = s[: region(len(s))[0]].copy()
                    size += len(held[name])
                    if size >= COMBINE:
                        yield from send()
                        held.clear()
                        size = 0
        if held:
            yield from send()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

        def counts(token: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            told = n > 0
            names, add = [node[told]], [n[told].astype(np.int64)]
            token, node, n = token[~told], node[~told], n[~told]
            if len(token):
                head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(token))))
                other = np.concatenate([[False], (node[1:] != node[:-1]) & (token[1:] == token[:-1])])
                shared = (np.bincount(run, weights=(n < 0) | other) > 0)[run] & (n == 0)
                shared[1:] &= (token[1:] != token[:-1]) | (node[1:] != node[:-1])  # copies met in several batches
                names.append(node[shared])
                add.append(np.ones(shared.sum(), np.int64))
            names, where = np.unique(np.concatenate(names), return_inverse=True)
            return _batch({"short": pa.array(names), "shared": pa.array(np.bincount(where, weights=np.concatenate(add), minlength=len(names)).astype(np.int64))})

        for batch in batches:
            now = tuple(batch.column(c).to_numpy() for c in ("token", "node", "n"))
            if rest is not None:
                now = tuple(np.concatenate(p) for p in zip(rest, now, strict=True))
            # The last token may go on in the next batch.
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            if cut:
                yield counts(*(c[:cut] for c in now))
            rest = tuple(c[cut:] for c in now)
        if rest is not None and len(rest[0]):
            yield counts(*rest)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.select("text").mapInArrow(entries, "token long, node long, n int")
    sent = sent.repartition(parts, "token").sortWithinPartitions("token", "node")
    return sent.mapInArrow(settle, "short long, shared long").groupBy("short").agg(F.sum("shared").alias("shared"))


def candidate_sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id``, ``node``, ``n``, ``tokens`` (bytes of the sorted set) of each node that shares enough of its region."""
    classes = nodes.filter("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"))
    short = F.expr("cast(conv(hex(substr(node, 1, 8)), 16, -10) AS bigint)")
    need = F.least(F.ceil(F.col("n") * NEED / OF), F.greatest(F.lit(1), F.floor(F.col("n") * SLACK)))
    counts = region_counts(rows)
    keys = classes.withColumn("short", short).join(counts, "short").filter(F.col("shared") >= need).select("key").distinct()
    kept = rows.join(small(written(keys, "candidate_keys")), "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column("text").to_pylist()) if len(s)]
            yield _batch({"node": pa.array([_node(s) for s in sets], pa.binary()), "n": pa.array([len(s) for s in sets], pa.int32()), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())})

    sets = kept.select("text").mapInArrow(run, "node binary, n int, tokens binary").dropDuplicates(["node"])
    return written(sets.withColumn("id", F.monotonically_increasing_id()), "candidate_sets")


def shared_tokens(sets: DataFrame) -> DataFrame:
    """``id``, ``n``, ``listed``: the set's shingles that other sets hold, rarest first as (df, token), of sets with enough of them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, raw in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens"), strict=True):
                tokens = np.frombuffer(raw.as_py(), np.int64)
                for k in range(0, n, 1 << 17):
                    part = tokens[k : k + (1 << 17)]
                    yield _batch({"token": pa.array(part), "id": pa.array(np.full(len(part), name, np.int64)), "n": pa.array(np.full(len(part), n, np.int32))})

    entries = sets.select("id", "n", "tokens").mapInArrow(spread, "token long, id long, n int")
    df = entries.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    found = entries.join(df, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("listed"))
    return written(found.filter(F.size("listed") >= F.ceil(F.col("n") * NEED / OF)), "shared_tokens")


def boundary(listed: DataFrame, limit: int = LIGHT_LIMIT) -> int:
    """The largest size whose sets list subsets: the one with the least cost, in rows listed and list places scanned."""
    prefix = F.slice("listed", F.lit(1), (F.size("listed") - F.ceil(F.col("n") * NEED / OF) + 1).cast("int"))
    scan = F.aggregate(prefix, F.lit(0).cast("bigint"), lambda a, x: a + x["df"] + 1)
    # One row a size, at most a third above the limit.
    sizes = {r["n"]: r for r in listed.filter(F.col("n") <= limit * OF // NEED).groupBy("n").agg(F.count("*").alias("sets"), F.sum(scan).alias("scan")).collect()}

    def cost(x: int) -> int:
        light = sum(r["sets"] * subsets(n) for n, r in sizes.items() if n <= x)
        # Sets above x scan lists, and those whose partners may be above it stand in them.
        return light + sum(r["scan"] for n, r in sizes.items() if n > x or n >= least_shared(x + 1))

    return min(range(limit + 1), key=lambda x: (cost(x), x))


def subsets(n: int) -> int:
    """Rows that a set of ``n`` lists as a light one."""
    return sum(comb(n, m) for m in range(n - least_shared(n) + 1))


def list_entries(sets: DataFrame, listed: DataFrame, light: int) -> DataFrame:
    """``list``, ``id``, ``n``, ``rest``: a row for each list that a set stands in.

    ``rest`` bounds what the set shares with a partner whose first common list this is: its shared shingles from here on.

    Sets of at most ``light`` elements list, for each size ``c`` of what a partner up to that size shares, all their subsets of ``c``
    elements. Larger ones, and those that such a one may link to, list their rarest shared shingles, so far that a partner has
    one of them.
    """
    prefixes = listed.select("id", "n", F.size("listed").alias("held"), F.transform(F.slice("listed", F.lit(1), (F.size("listed") - F.ceil(F.col("n") * NEED / OF) + 1).cast("int")), lambda x: x["token"]).alias("tokens"))
    heavy = prefixes.filter(F.col("n") >= least_shared(light + 1)).select("id", F.col("n").cast("int").alias("n"), "held", F.posexplode_outer("tokens").alias("at", "list"))
    heavy = heavy.select("list", "id", "n", (F.col("held") - F.col("at")).alias("rest"))

    def enumerate_subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, raw in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens"), strict=True):
                tokens = _mixed(np.frombuffer(raw.as_py(), np.uint64) ^ _STEP)
                total = tokens.sum(dtype=np.uint64)
                keys = [_mixed(np.array([total], np.uint64) ^ np.uint64(n))]
                for m in range(1, n - least_shared(n) + 1):
                    gone = np.array(list(combinations(range(n), m)))
                    keys.append(_mixed((total - tokens[gone].sum(axis=1, dtype=np.uint64)) ^ np.uint64(n - m)))
                keys = np.concatenate(keys).view(np.int64)
                yield _batch({"list": pa.array(keys), "id": pa.array(np.full(len(keys), name, np.int64)), "n": pa.array(np.full(len(keys), n, np.int32)), "rest": pa.array(np.full(len(keys), n, np.int32))})

    few = sets.filter(F.col("n") <= light).join(listed.filter(F.col("n") <= light).select("id"), "id", "left_semi")
    lit = few.select("id", "n", "tokens").mapInArrow(enumerate_subsets, "list long, id long, n int, rest int")
    return written(heavy.unionByName(lit), "list_entries")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``a``, ``b`` of ``pairs`` whose sets link, by their whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(OF * both >= NEED * (len(x) + len(y) - both))
            yield _batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    body = sets.select("id", "tokens")
    both = pairs.join(body.toDF("a", "x"), "a").join(body.toDF("b", "y"), "b")
    return written(both.mapInArrow(run, "a long, b long"), "links")


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """``id`` and ``root`` (least id reachable) of every end of ``links``, by alternate large-star and small-star steps."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = written(edges, "stars")
    before = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small_star.union(least.toDF("u", "v")).filter("u != v").distinct(), "stars")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("groups did not settle")
    tips = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return tips.union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def measures(listed: DataFrame) -> DataFrame:
    """``id``, ``held`` (its shingles that other sets hold) and ``center`` (how common its shingles are, in whole thousandths)."""
    total = F.aggregate("listed", F.lit(0).cast("bigint"), lambda a, x: a + x["df"])
    return listed.select("id", F.size("listed").alias("held"), F.floor(total * 1000 / F.col("n")).alias("center"))


def _fits(n1: str, held1: str, n2: str, held2: str) -> F.Column:
    """Whether two sets may link for all that their sizes and their shared shingles say."""
    both = F.least(held1, held2)
    return OF * both >= NEED * (F.col(n1) + F.col(n2) - both)


def links_of(entries: DataFrame, listed: DataFrame, sets: DataFrame, rounds: int = 2) -> DataFrame:
    """Enough verified links to join all linked sets.

    In each round every list offers its members one hub, the one whose shingles are the most common, of those that an earlier round's
    dice left in; only members of other groups are compared. Then what is still apart is compared pair by pair, but for
    members of a list's largest group among themselves and for pairs that their sizes and places in the list rule out.
    """
    entries = written(entries.join(measures(listed), "id"), "measured_entries")
    links = done = groups = None
    for k in range(rounds):
        member = entries.withColumn("root", F.col("id")) if groups is None else entries.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
        dice = F.when(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(4)) == 0, 1).otherwise(0) if k else F.lit(0)
        hub = F.max(F.struct(dice.alias("dice"), "center", F.col("id").alias("a"), F.col("n").alias("an"), F.col("held").alias("ah"), F.col("root").alias("ar"))).alias("h")
        hubs = member.groupBy("list").agg(hub, F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("list", "h.*")
        star = member.join(hubs, "list").filter((F.col("ar") != F.col("root")) & _fits("n", "held", "an", "ah"))
        star = star.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        star = written(star if done is None else star.join(done, ["a", "b"], "left_anti"), "star_pairs")
        found = verified(star, sets)
        links, done = (found, star) if links is None else (links.union(found), done.union(star))
        groups = written(components(links), "set_groups")
    member = entries.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    tally = member.groupBy("list", "root").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    split = tally.groupBy("list").agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("groups"), F.min("least").alias("least")).filter("groups > 1")
    member = written(member.join(split.select("list", "least", F.col("top.root").alias("top")), "list"), "apart")
    # A pair is met at its first common list or not at all, so what both hold from here on bounds what they share. Who fits not even
    # the list's smallest member needs no partner here.
    left = member.filter("root != top").filter(OF * F.col("rest") >= NEED * (F.col("n") + F.col("least") - F.col("rest")))
    left = left.select("list", F.col("id").alias("a"), F.col("n").alias("an"), F.col("rest").alias("ah"), F.col("root").alias("ar"))
    right = member.select("list", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("rest").alias("bh"), F.col("root").alias("br"), (F.col("root") == F.col("top")).alias("in_top"))
    pairs = left.join(right, "list").filter((F.col("ar") != F.col("br")) & (F.col("in_top") | (F.col("a") < F.col("b"))) & _fits("an", "ah", "bn", "bh"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links.union(verified(pairs.join(done, ["a", "b"], "left_anti"), sets))


def similar_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``key``, ``text_hash``, ``n_shingles``, ``component_id``, ``group`` and ``keeper`` for every row of ``docs``.

    ``component_id`` is the least document id that links lead to, the row's own included. Equal sets link; empty ones (null or empty
    texts) link with nothing. Rows without a document id take part; ``component_id`` is null only where no row of a group has one.
    ``keeper`` marks the row that stands for its group: that with the least id (rows without one come last).
    Repeated rows are equal in all columns.
    """
    rows = _rows(docs, doc, text)
    nodes = node_table(rows)
    sets = candidate_sets(rows, nodes)
    listed = shared_tokens(sets)
    entries = list_entries(sets, listed, boundary(listed))
    groups = components(links_of(entries, listed, sets))
    names = sets.select("id", "node")
    roots = groups.join(names, "id").select("node", "root")
    # Sums over rows combine map-side, so a set that a third of all rows share is no hot key.
    least = F.min(F.struct(F.col("doc").isNull().alias("late"), "key", "node")).alias("least")
    own = nodes.filter("n > 0").groupBy("node").agg(least)
    own = written(own.join(roots, "node", "left"), "node_groups")
    joint = small(written(own.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("joint")), "group_least"))
    final = own.join(joint, "root", "left").select("node", F.coalesce("joint", "least").alias("least"))
    out = nodes.join(small(written(final, "node_least")), "node", "left")
    alone = F.struct(F.col("doc").isNull().alias("late"), "key", "node")
    out = out.withColumn("least", F.coalesce("least", alone))
    return out.select(
        "doc",
        "key",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(~F.col("least.late"), F.col("least.key")).alias("component_id"),
        F.col("least.node").alias("group"),
        (F.col("least.key") == F.col("key")).alias("keeper"),
    )


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of similar ones, with its own columns; rows with an empty text all stay.

    The row with the least document id stays; of several rows with that id in a group, any one.
    """
    groups = written(similar_groups(docs, doc, text), "groups")
    rows, names = shielded(docs)
    body = F.coalesce(F.col(names[text]), F.lit(""))
    hashed = F.xxhash64(body)
    key = F.coalesce(F.col(names[doc]).cast("long"), hashed)
    gone = groups.filter("NOT keeper").select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    gone = small(written(gone, "not_kept"))
    match = (key == F.col("_key")) & (hashed == F.col("_hash"))
    left = rows.join(gone, match, "left_anti")
    keepers = groups.filter("keeper AND n_shingles > 0")
    several = keepers.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    several = keepers.join(several, "group").select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash"), F.col("group").alias("_group"))
    several = written(several.distinct(), "repeated")
    if not several.isEmpty():
        one = left.join(several, match).dropDuplicates(["_group"]).drop("_key", "_hash", "_group")
        left = left.join(several, match, "left_anti").unionByName(one)
    return unshielded(left, docs)
