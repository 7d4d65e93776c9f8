"""Token ids as compressed files: patched frame-of-reference blocks in ascending document order.

Documents are range-partitioned by id, tokenized in Arrow batches and packed into segments of whole documents. A segment is one
row of a written table, so Spark's own commit protocol makes it whole or absent when executors are lost, on any store.
Its payload is self-contained:

    header   magic, number of documents, ids and blocks, block length (5 x uint32)
    documents  doc id (int64), null flag (uint8), number of ids (uint32), a column each
    index    start of each block's packed bits (uint32), block minimum (uint32), width (uint8), exceptions (uint16)
    packed   id - minimum, in the width that holds the chosen percentile of the block; low bits of larger ones
    exceptions  place in block (uint16) and value above the width (uint32), in block order
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import small, text_of, written

BLOCK, END_ID = 256, 2
#: Percentile of a block's values that the packed width holds; larger ones become exceptions.
PERCENTILE = 0.9
#: Ids after which a segment is closed. A longer document is a segment of its own.
SEGMENT_IDS = 1 << 19
MAGIC = 0x50464F52
#: Runs and pieces of text whose ids a worker remembers, of each kind; those used last stay.
MEMO = 1_000_000
#: Bytes of text whose runs are told apart at a time. A longer text is taken alone.
SLICE = 16 << 20

#: Stands for the blank between two runs among the ids of their pieces; no vocabulary is that large.
GAP_ID = np.uint32(0xFFFFFFFF)
GAP = GAP_ID.tobytes()

_state: dict = {}


class _Recent(dict):
    """Ids by text, made by ``make`` when first asked for: at half the size all become ``old``, and what was used least recently is gone."""

    def __init__(self, size: int, make: Callable[[str], bytes]):
        self.half, self.make, self.old = size // 2, make, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        self[text] = ids = self.make(text) if ids is None else ids
        return ids

    def make_room(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


#: Characters on which the normalizer and the patterns of every Unicode version agree: no blanks, marks or compositions.
PLAIN = "^[!-~\xa1-\u012f\u0131-\u024f]*$"
LETTERS = r"^\p{L}+$"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 characters for themselves, the others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class _Ids:
    """Ids of texts. Where the tokenizer's own rules say that no token crosses a blank, the distinct runs of many texts are cut into
    pieces by one pass of the pattern, and each distinct piece is encoded once; otherwise texts are encoded whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.added = [t["content"] for t in rules["added_tokens"]]
        self.pattern = _piece_pattern(rules)
        #: Whether a run of letters is one piece: whatever the pattern tries before letters starts with an apostrophe.
        before, letters, _ = (self.pattern.pattern if self.pattern else "").partition("[\\p{L}]+|")
        self.words = bool(letters) and "(" not in before and all(x.startswith("'") for x in before.split("|")[:-1]) and before[-1:] in ("", "|")
        self.runs, self.pieces = _Recent(MEMO, self._run), _Recent(MEMO, self._piece)
        letters = _byte_letters()
        self.letters = {b: letters[b] for b in range(256) if letters[b] != chr(b)}

    def of(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all texts, one after another, each followed by ``end_id``, and the number of ids of each."""
        if self.pattern is None:
            ids, sizes = _joined(self._encoded(texts.to_pylist()))
            runs, ends = np.arange(len(sizes)), np.arange(1, len(sizes) + 1)
        else:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
            known = split.flatten().dictionary_encode()
            ids, sizes, place = self._of_runs(known.dictionary)
            runs = place[known.indices.to_numpy()]
        # The run behind the last holds the end id alone.
        ids, sizes, firsts = np.append(ids, np.uint32(end_id)), np.append(sizes, 1), np.append(0, np.cumsum(sizes))
        runs = np.insert(runs, ends, len(sizes) - 1)
        counts = sizes[runs]
        stops = np.cumsum(counts)
        at = np.repeat(firsts[runs] - stops + counts, counts)
        at += np.arange(len(at))
        return ids[at], np.diff(stops[ends + np.arange(len(ends))], prepend=0)

    def _of_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct runs, kind by kind, the number of ids of each in that order, and each run's place in it."""
        self.runs.make_room()
        self.pieces.make_room()
        self.pieces[" "] = GAP
        plain = pc.match_substring_regex(runs, PLAIN).to_numpy(zero_copy_only=False)
        for token in self.added:
            plain &= ~pc.match_substring(runs, token).to_numpy(zero_copy_only=False)
        word = plain & pc.match_substring_regex(runs, LETTERS).to_numpy(zero_copy_only=False) if self.words else np.zeros_like(plain)
        kinds = [np.nonzero(kind)[0] for kind in (word, plain & ~word, ~plain)]
        words, cuttable, others = (runs.take(pa.array(kind)) for kind in kinds)
        found = [_joined([self.pieces[w] for w in _line(words).lower().split(" ")] if len(words) else [])]
        pieces = self.pattern.findall(_line(cuttable).lower() + " " * (len(cuttable) > 0))
        ids, _ = _joined([self.pieces[p] for p in pieces])
        gaps = ids == GAP_ID
        found.append((ids[~gaps], np.diff(np.nonzero(gaps)[0], prepend=-1) - 1))
        found.append(_joined([self.runs[r] for r in others.to_pylist()]))
        place = np.empty(len(runs), np.int64)
        place[np.concatenate(kinds)] = np.arange(len(runs))
        ids, sizes = map(np.concatenate, zip(*found, strict=True))
        return ids, sizes, place

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _run(self, run: str) -> bytes:
        return self._encoded([run])[0]

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        tokens = self.model.tokenize(letters)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])


def _line(runs: pa.Array) -> str:
    """All runs, a blank between two."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(runs)], runs.cast(pa.string())), " ")[0].as_py()


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


def _piece_pattern(rules: dict):
    """The pattern whose matches are a text's pieces, and blanks, if the tokenizer's rules are of the kind that ``_Ids`` can follow piece
    by piece: composed, with blanks joined, in lower case, cut by a pattern that keeps its matches only, then taken as bytes. Else ``None``."""
    kinds = [(x["type"], x.get("pattern"), x.get("content")) for x in (rules["normalizer"] or {}).get("normalizers", [])]
    cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    fits = (
        kinds == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and "Regex" in cuts[0]["pattern"]
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        and rules["model"]["type"] == "BPE" and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"])
    )
    if not fits:
        return None
    import regex

    own = cuts[0]["pattern"]["Regex"]
    # A match that could hold a blank would cross runs.
    if regex.compile(own).groups or any(" " in m for m in regex.findall(own, "a b\u00e9 1 . '\u00e9 ")):
        return None
    return regex.compile(f"{own}| ")


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most ``SLICE`` bytes together, or of one longer text."""
    first = size = 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if k > first and size + n > SLICE:
            yield first, k
            first, size = k, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def _ids(path: str) -> _Ids:
    if path not in _state:
        _state[path] = _Ids(path)
    return _state[path]


def _low_bytes(values: np.ndarray, width: int) -> np.ndarray:
    """The bytes of 32-bit values that hold their lowest ``width`` bits, along a new axis."""
    return values.astype("<u4").view(np.uint8).reshape(*values.shape, 4)[:, :, : -(-int(width) // 8)]


def pack(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> bytes:
    """The payload of a segment: ``ids`` (uint32) of its documents, one after another."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n % BLOCK:
        full[n:] = full[(blocks - 1) * BLOCK : n].min()
    grid = full.reshape(blocks, BLOCK)
    least = grid.min(axis=1)
    over = grid - least[:, None]
    rank = int(PERCENTILE * (BLOCK - 1))
    typical = np.partition(over, rank, axis=1)[:, rank]
    widths = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.uint8)
    high = over >> widths[:, None].astype(np.uint32)
    row, place = np.nonzero(high)
    counts = np.bincount(row, minlength=blocks).astype(np.uint16)
    packed = [b""] * blocks
    for width in np.unique(widths):
        which = np.nonzero(widths == width)[0]
        if not width:
            continue
        bits = np.unpackbits(_low_bytes(over[which], width), axis=2, count=width, bitorder="little")
        rows = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
        for k, r in zip(which, rows, strict=True):
            packed[k] = r.tobytes()
    starts = np.concatenate([[0], np.cumsum([len(p) for p in packed])[:-1]]).astype(np.uint32) if blocks else np.zeros(0, np.uint32)
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([
        np.array([MAGIC, len(doc_ids), n, blocks, BLOCK], "<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), np.array(lengths, "<u4").tobytes(),
        starts.astype("<u4").tobytes(), least.astype("<u4").tobytes(), widths.tobytes(), counts.astype("<u2").tobytes(),
        b"".join(packed), place.astype("<u2").tobytes(), high[row, place].astype("<u4").tobytes(),
    ])


def _values(packed: np.ndarray, width: int) -> np.ndarray:
    """The values of ``width`` bits that ``packed`` holds: eight of them fill ``width`` bytes, and each lies within eight bytes of its first."""
    rows = np.zeros((packed.size // width, width + 8), np.uint8)
    rows[:, :width] = packed.reshape(-1, width)
    out = np.empty((len(rows), 8), np.uint32)
    for k in range(8):
        byte, bit = divmod(k * width, 8)
        window = np.ascontiguousarray(rows[:, byte : byte + 8]).view("<u8")[:, 0]
        out[:, k] = (window >> np.uint64(bit)) & np.uint64((1 << width) - 1)
    return out.ravel()


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, list, np.ndarray]:
    """Ids of blocks ``first`` to ``last`` (all by default), document ids and numbers of ids of the segment.

    Only the index is read besides the wanted blocks: each block's start is looked up, not computed from those before it.
    """
    magic, docs, n, blocks, block = map(int, np.frombuffer(payload, "<u4", 5))
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = 20

    def column(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, null, lengths = column("<i8", docs), column("u1", docs), column("<u4", docs)
    starts, least, widths, counts = column("<u4", blocks), column("<u4", blocks), column("u1", blocks), column("<u2", blocks)
    base = at
    sizes = widths.astype(np.int64) * block // 8
    at = base + int(starts[-1] + sizes[-1]) if blocks else base
    places, high = column("<u2", int(counts.sum())), column("<u4", int(counts.sum()))
    last = blocks if last is None else min(last, blocks)
    out = np.zeros((max(last - first, 0), block), np.uint32)
    for width in np.unique(widths[first:last]):
        which = np.nonzero(widths[first:last] == width)[0] + first
        if not width:
            continue
        raw = np.stack([np.frombuffer(payload, np.uint8, int(sizes[k]), base + int(starts[k])) for k in which])
        out[which - first] = _values(raw, int(width)).reshape(len(which), block)
    row = np.repeat(np.arange(blocks), counts)
    mine = (row >= first) & (row < last)
    out[row[mine] - first, places[mine]] |= high[mine] << widths[row[mine]].astype(np.uint32)
    out += least[first:last, None]
    ids = out.reshape(-1)[: max(0, min(n, last * block) - first * block)]
    return ids, [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], lengths


def write_segments(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode every whole text (null: empty), append ``end_id`` and write segments; the written table of
    ``shard``, ``segment``, ``n_docs``, ``n_ids``, ``payload``.

    Shards and segments are numbered in ascending order of (doc id, text hash), nulls first. Repeated rows are encoded each time.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc"), text_of(text).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _ids(tokenizer).of
        held: list[np.ndarray] = []
        doc_ids: list = []
        lengths: list[int] = []
        segment = shard = size = 0

        def close() -> pa.RecordBatch:
            payload = pack(np.concatenate(held), doc_ids, lengths)
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())}
            )

        for batch in batches:
            shard = batch.column("shard")[0].as_py() if batch.num_rows else shard
            for first, stop in _slices(batch.column("text")):
                docs = batch.slice(first, stop - first)
                ids, counts = of(docs.column("text"), end_id)
                ends = np.cumsum(counts).tolist()
                for d, n, e in zip(docs.column("doc").to_pylist(), counts.tolist(), ends, strict=True):
                    if held and size + n > SEGMENT_IDS:
                        yield close()
                        held, doc_ids, lengths = [], [], []
                        segment, size = segment + 1, 0
                    held.append(ids[e - n : e])
                    doc_ids.append(d)
                    lengths.append(n)
                    size += n
        if held:
            yield close()

    packed = rows.mapInArrow(encode, "shard int, segment int, n_docs long, n_ids long, payload binary")
    return written(packed, "token_segments")


def read_segments(segments: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of each document, from the segments' payloads.

    ``start`` counts the ids of all documents before it: those of earlier segments (a running sum over one narrow row for each
    shard, then over a shard's segments) and those before it in its own.
    """
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    shards = shards.withColumn("shard_start", F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).drop("ids")
    inner = Window.partitionBy("shard").orderBy("segment")
    starts = segments.select("shard", "segment", "n_ids").withColumn("inner_start", F.sum("n_ids").over(inner) - F.col("n_ids"))
    starts = starts.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("inner_start")).alias("base"))
    placed = segments.select("shard", "segment", "payload").join(small(written(starts, "token_starts")), ["shard", "segment"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column("base").to_pylist(), batch.column("payload"), strict=True):
                ids, doc_ids, lengths = unpack(payload.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(base + ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.select("base", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
