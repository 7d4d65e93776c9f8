"""The prefix trie of conversations, screened by a count-min sketch.

A prefix of turns is known by a 128-bit digest: the exclusive or of its turns' hashes, each mixed with its place. Such digests
build up along a conversation, so a conversation that fills many partitions is digested piece by piece. Tasks count digests in
count-min sketches that stop at two; merged, they are a bitmap of fixed size. A prefix whose estimate is one belongs to one
conversation for sure, and its node is written where the row stands. Only prefixes that may be shared are shuffled and grouped
exactly, so a wrong estimate costs time, never rightness.

Sums over subtrees need no walk down the tree: a node's value is booked on its least member. Running from a conversation's end
to its start and adding up over a node's members, each node below is met once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import small, written

#: Conversations take their first turns from the one whose id ends a block of so many; fewer than ``SHARED`` of them.
FAMILY, SHARED = 100, 6
#: Cells of a row of the sketch: four for each prefix, at least and at most these; two rows.
CELLS_LEAST, CELLS_MOST = 1 << 16, 1 << 24
PIECE = 1 << 16
#: Rows of a range partition; the number of partitions grows with the rows.
PART_ROWS = 2_000_000
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ("d", "x1", "x2")


def _parts(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // PART_ROWS + 1)


def running(df: DataFrame, by: str, order: Sequence[Column], parts: int, adds: Sequence[str] = (), xors: Sequence[str] = ()) -> DataFrame:
    """``df`` (written, sorted) with ``n``, a row's number among those of its ``by`` (a long, never null) in ``order``, and the running
    sums and exclusive ors of some long columns as ``sum_*`` and ``xor_*``. A value of ``by`` may fill any number of partitions.
    """
    sums, ors = [f"sum_{c}" for c in adds], [f"xor_{c}" for c in xors]
    new = ["n", *sums, *ors]

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, [0] * len(new)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(by).to_numpy()
            begins = np.concatenate([[True], keys[1:] != keys[:-1]])
            group, starts = np.cumsum(begins) - 1, np.nonzero(begins)[0]
            inputs = [np.ones(len(keys), np.int64), *(batch.column(c).to_numpy() for c in (*adds, *xors))]
            out = []
            for k, values in enumerate(inputs):
                if k <= len(adds):
                    total = np.cumsum(values)
                    total -= (total - values)[starts][group]
                    total[group == 0] += carried[k] if keys[0] == last else 0
                else:
                    total = np.bitwise_xor.accumulate(values)
                    total ^= (total ^ values)[starts][group]
                    total[group == 0] ^= carried[k] if keys[0] == last else 0
                out.append(total)
            last, carried = keys[-1], [c[-1] for c in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in out)], names=[*batch.schema.names, *new])

    placed = df.repartitionByRange(parts, F.col(by), *order).sortWithinPartitions(F.col(by), *order).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    local = written(placed.mapInArrow(along, ", ".join([fields, *(f"{c} long" for c in new)])), "running")
    # Only the first and the last value of a partition can go on elsewhere: two rows a partition.
    edges = local.groupBy("part").agg(F.array_distinct(F.array(F.min(by), F.max(by))).alias("edge"))
    edges = edges.select("part", F.explode("edge").alias(by))
    ends = local.join(F.broadcast(edges), ["part", by]).groupBy(by, "part").agg(F.max("n").alias("n"), *[F.max_by(c, "n").alias(c) for c in new[1:]])
    from pyspark.sql import Window

    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    folded = [F.sum(c).over(before).alias(f"off_{c}") for c in ("n", *sums)] + [F.bit_xor(c).over(before).alias(f"off_{c}") for c in ors]
    offsets = written(ends.select(by, "part", *folded).filter("off_n IS NOT NULL"), "offsets")
    joined = local.join(F.broadcast(offsets), [by, "part"], "left")
    put = {c: F.col(c) + F.coalesce(F.col(f"off_{c}"), F.lit(0)) for c in ("n", *sums)}
    put |= {c: F.col(c).bitwiseXOR(F.coalesce(F.col(f"off_{c}"), F.lit(0))) for c in ors}
    return joined.select(*df.columns, *[put[c].alias(c) for c in new])


def placed_turns(conversations: DataFrame, rows: int) -> DataFrame:
    """``c``, ``h1``, ``h2``, ``size``, ``n``: each turn's hashes, code points of its text and its place from 1, null turns first.

    Rows of one turn are ordered by their hashes. Rows without ``conv_id`` belong to no conversation and are left out.
    """
    held = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), *held).alias("h1"), F.xxhash64(F.lit(2), *held).alias("h2"), F.length(held[1]).cast("long").alias("size"),
    )
    turns = turns.withColumn("read_at", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"), F.col("read_at")]
    return running(turns, "c", order, _parts(turns, rows)).select("c", "h1", "h2", "size", "n")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its family's first turns: ``c``, ``total`` (written), and its turns ``c``, ``d``, ``total``, ``size``, ``g1``, ``g2``."""
    own = written(turns.groupBy("c").agg(F.max("n").alias("own")), "chat_sizes")
    first = (F.crc32(F.col("c").cast("string").cast("binary")) % SHARED).cast("long")
    given = own.select("c", "own", first.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("base"))
    bases = own.filter(F.col("c") % FAMILY == 0).select(F.col("c").alias("base"), F.col("own").alias("held"))
    given = given.join(bases, "base", "left").withColumn("b", F.least("h", F.coalesce("held", F.lit(0).cast("long"))))
    total = F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = written(given.select("c", "base", "h", "b", total.alias("total")), "chats")
    rest = turns.join(small(convs), "c").filter("n > h").select("c", (F.col("n") - F.col("h") + F.col("b")).alias("d"), "total", "size", "h1", "h2")
    heads = turns.filter((F.col("c") % FAMILY == 0) & (F.col("n") < SHARED)).withColumnRenamed("c", "base")
    taken = heads.join(convs.filter("b > 0"), "base").filter("n <= b").select("c", F.col("n").alias("d"), "total", "size", "h1", "h2")
    both = rest.unionByName(taken)
    return convs, both.select("c", "d", "total", "size", F.xxhash64("d", "h1").alias("g1"), F.xxhash64("d", "h2").alias("g2"))


def _bits(cells: np.ndarray, more: bool) -> Iterator[tuple[int, bytes, bytes]]:
    """Pieces of a row of a sketch: cells seen, and cells seen twice or more."""
    found, counts = np.unique(cells, return_counts=True)
    edges = np.nonzero(np.diff(found // PIECE, prepend=-1))[0].tolist()
    for a, b in zip(edges, [*edges[1:], len(found)], strict=True):
        maps = []
        for which in (slice(None), counts[a:b] > 1):
            bits = np.zeros(PIECE, bool)
            bits[found[a:b][which] % PIECE] = True
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield int(found[a]) // PIECE, *maps


def sketch(digests: DataFrame, cells: int) -> list[np.ndarray]:
    """Two rows of ``cells`` bits over all rows of ``x1`` and ``x2``: whether a cell was met twice. Of fixed size, whatever the rows."""
    schema = "line int, piece int, seen binary, twice binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def close() -> Iterator[pa.RecordBatch]:
            for line in (0, 1):
                for piece, seen, twice in _bits(np.concatenate(held[line]), True):
                    yield pa.RecordBatch.from_arrays([pa.array([line], pa.int32()), pa.array([piece], pa.int32()), pa.array([seen]), pa.array([twice])], ["line", "piece", "seen", "twice"])
            held[0].clear()
            held[1].clear()

        size = 0
        for batch in batches:
            for line in (0, 1):
                held[line].append((batch.column(line).to_numpy() & (cells - 1)).astype(np.int32))
            size += batch.num_rows
            if size >= PART_ROWS:
                yield from close()
                size = 0
        if size:
            yield from close()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for line, piece, *maps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen, twice = (np.frombuffer(zlib.decompress(m), np.uint8) for m in maps)
                old = kept.setdefault((line, piece), [np.zeros(PIECE // 8, np.uint8), np.zeros(PIECE // 8, np.uint8)])
                old[1] |= twice | (old[0] & seen)
                old[0] |= seen
        for (line, piece), (_, twice) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([line], pa.int32()), pa.array([piece], pa.int32()), pa.array([twice.tobytes()])], ["line", "piece", "twice"])

    merged = digests.select("x1", "x2").mapInArrow(count, schema).repartition("line", "piece").mapInArrow(merge, "line int, piece int, twice binary")
    out = [np.zeros(max(cells, PIECE) // 8, np.uint8) for _ in range(2)]
    for row in merged.collect():  # cells / PIECE rows of PIECE / 8 bytes for each line
        out[row.line][row.piece * PIECE // 8 : (row.piece + 1) * PIECE // 8] = np.frombuffer(row.twice, np.uint8)
    return out


def screened(prefixes: DataFrame, cells: int) -> DataFrame:
    """``prefixes`` with ``shared`` and ``p_shared``: the prefix, and the one a turn shorter, may belong to several conversations."""
    held = prefixes.sparkSession.sparkContext.broadcast(sketch(prefixes, cells))

    def twice(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for bits, x in zip(held.value, (a, b), strict=True):
            at = x & (cells - 1)
            out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x1, x2, p1, p2 = (batch.column(c).to_numpy() for c in ("x1", "x2", "p1", "p2"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(twice(x1, x2)), pa.array(twice(p1, p2))], names=[*batch.schema.names, "shared", "p_shared"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema)
    return prefixes.mapInArrow(look, f"{fields}, shared boolean, p_shared boolean")


def _digests(ends: DataFrame) -> DataFrame:
    """The SHA-256 of each node's ids in ascending order, comma-joined: ids of one node stream through one task, which holds none of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, out = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in node), pa.array([out.hexdigest()])], [*NODE, "ends_sha256"])

        for batch in batches:
            for *at, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at != node:
                    if node is not None:
                        yield closed()
                    node, out = at, hashlib.sha256(str(c).encode())
                else:
                    out.update(f",{c}".encode())
        if node is not None:
            yield closed()

    ordered = ends.repartition(*NODE).sortWithinPartitions(*NODE, "c")
    return ordered.select(*NODE, "c").mapInArrow(read, "d long, x1 long, x2 long, ends_sha256 string")


def trie(conversations: DataFrame, cells_least: int = CELLS_LEAST, cells_most: int = CELLS_MOST) -> DataFrame:
    """The nodes of the prefix trie of rebuilt conversations: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    A conversation begins with the first turns of its family's first one (see ``rebuilt``), then come its own later turns. Null roles and
    texts are empty; rows without an id belong to no conversation; repeated rows are turns of their own. Without conversations there is no node, not even a root.
    """
    rows = conversations.count()
    convs, turns = rebuilt(placed_turns(conversations, rows))
    along = running(turns, "c", [F.col("d")], _parts(turns, rows), xors=("g1", "g2"))
    prefixes = along.select(
        "c", "d", "total", "size", F.col("xor_g1").alias("x1"), F.col("xor_g2").alias("x2"),
        F.col("xor_g1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("xor_g2").bitwiseXOR(F.col("g2")).alias("p2"),
    )
    cells = cells_least
    while cells < min(4 * rows, cells_most):
        cells *= 2
    looked = written(screened(prefixes, cells), "prefixes")
    single, many = looked.filter("NOT shared"), looked.filter("shared")

    groups = many.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"),
        *[F.max(c).alias(c) for c in ("p1", "p2", "p_shared")],
    )
    groups = written(groups, "shared_nodes")
    up = [(F.col("d") - 1).alias("d"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    children = groups.filter("d > 1").select(*up).unionByName(single.filter("p_shared AND d > 1").select(*up))
    children = children.groupBy(*NODE).agg(F.count("*").alias("n_children"))
    nodes = groups.join(children, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    leaf, saved = (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")
    nodes = written(nodes.withColumns({"leaf": leaf, "saved": saved}), "counted_nodes")

    # From the end of each conversation to its start: what is booked on it, then the node that asks.
    zero = F.lit(0).cast("long")
    asks = many.select("c", "d", F.lit(1).alias("asks"), "x1", "x2", zero.alias("leaf"), zero.alias("saved"))
    booked = nodes.select(F.col("conv_id").alias("c"), "d", F.lit(0).alias("asks"), zero.alias("x1"), zero.alias("x2"), "leaf", "saved")
    tails = single.filter("d = total").select("c", "d", F.lit(0).alias("asks"), zero.alias("x1"), zero.alias("x2"), F.lit(1).cast("long").alias("leaf"), zero.alias("saved"))
    below = running(asks.unionByName(booked).unionByName(tails), "c", [F.col("d").desc(), F.col("asks")], _parts(looked, rows), adds=("leaf", "saved"))
    below = below.filter("asks = 1").groupBy(*NODE).agg(F.sum("sum_leaf").alias("n_leaves"), F.sum("sum_saved").alias("saved_tokens"))

    ends = many.filter("d = total").select(*NODE, "c").unionByName(convs.filter("total = 0").select(zero.alias("d"), zero.alias("x1"), zero.alias("x2"), "c"))
    ends = written(_digests(ends), "node_ends")
    top = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = top.first()
    root_id = F.lit(root.conv_id if root else None).cast("long")
    named = small(written(groups.select((F.col("d") + 1).alias("d"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("above")), "node_names"))
    parent = F.when(F.col("d") == 1, root_id).when(F.col("p_shared"), F.col("above"))

    shared = nodes.join(below, list(NODE)).join(ends, list(NODE), "left").join(named, ["d", "p1", "p2"], "left")
    shared = shared.select(
        "conv_id", F.col("d").alias("depth"), parent.otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    one = F.lit(1).cast("long")
    own = F.when(F.col("d") == F.col("total"), F.sha2(F.col("c").cast("string"), 256)).otherwise(EMPTY)
    tops = single.filter("p_shared AND d > 1").join(named, ["d", "p1", "p2"], "left")
    rest = single.filter("NOT (p_shared AND d > 1)").withColumn("above", F.lit(None).cast("long"))
    alone = tops.unionByName(rest.select(tops.columns)).select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), parent.otherwise(F.col("c")).alias("parent_conv_id"), one.alias("n_convs"),
        (F.col("d") < F.col("total")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), own.alias("ends_sha256"),
    )
    sums = nodes.agg(F.coalesce(F.sum("leaf"), zero).alias("l"), F.coalesce(F.sum("saved"), zero).alias("s"), F.count_if(F.col("d") == 1).alias("k"))
    lone = single.agg(F.count_if(F.col("d") == F.col("total")).alias("l"), F.count_if(F.col("d") == 1).alias("k"))
    counts, others, turnless = sums.first(), lone.first(), ends.filter("d = 0").first()
    fields = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    row = [] if root is None else [(root.conv_id, 0, None, root.n_convs, counts.k + others.k, max(1, counts.l + others.l), counts.s, turnless.ends_sha256 if turnless else EMPTY)]
    return shared.unionByName(alone).unionByName(conversations.sparkSession.createDataFrame(row, fields))
