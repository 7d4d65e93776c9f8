"""Named-entity path: chunking, a pluggable model, softmax, label choice and span decoding.

One row is one chunk, so its tokens (bounded by the model window) stay together and decoding runs
inside the row. The only Python boundary is the model call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.catalog import CATEGORY_BY_TYPE, CHUNK_CHARS, ENTITY_OF_LABEL, EXCERPT_RADIUS, LABELS
from riskloom.functions.matching import cut, pieces, quoted
from riskloom.operators.detect import DETECTIONS, explode_detections

TOKENS = "array<struct<start:int,stop:int,logits:array<float>>>"


def chunks(df: DataFrame, *keys: str, text: str = "text", width: int = CHUNK_CHARS) -> DataFrame:
    """Non-overlapping chunks with their offset and the characters around them for excerpts."""
    cut = df.withColumn("_p", F.expr(pieces(f"coalesce(`{text}`, '')", width)))
    rows = f"""transform(_p, (p, i) -> named_struct(
        'chunk_start', int(i * {width}), 'chunk', p,
        'before', if(i > 0, right(_p[i - 1], {EXCERPT_RADIUS}), ''),
        'after', coalesce(left(get(_p, i + 1), {EXCERPT_RADIUS}), '')))"""
    return cut.select(*keys, F.explode_outer(F.expr(rows)).alias("_c")).filter("_c IS NOT NULL").select(*keys, "_c.*")


Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]


def predict(chunked: DataFrame, factory: Callable[[], Callable[[list[str]], list[Tokens]]]) -> DataFrame:
    """Add ``tokens`` from a user model.

    ``factory`` builds ``texts -> per text (starts, stops, logits)`` once per Python worker; starts
    and stops are integer arrays, logits a float array with one row per token. Batches cross as
    Arrow and the token columns are assembled from whole arrays.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunked.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        model = factory()
        for batch in batches:
            found = model(batch.column(batch.schema.get_field_index("chunk")).to_pylist())
            counts = np.array([len(starts) for starts, _, _ in found], dtype=np.int32)
            logits = np.concatenate([np.asarray(v, dtype=np.float32).reshape(len(s), -1) for s, _, v in found if len(s)] or
                                    [np.zeros((0, 1), dtype=np.float32)])
            width = logits.shape[1]
            inner = pa.ListArray.from_arrays(
                np.arange(len(logits) + 1, dtype=np.int32) * width, pa.array(logits.reshape(-1), type=pa.float32())
            )
            flat = [
                pa.array(np.concatenate([np.asarray(t[i], dtype=np.int32) for t in found] or [np.zeros(0, np.int32)]), type=pa.int32())
                for i in (0, 1)
            ]
            tokens = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum(counts)]).astype(np.int32),
                pa.StructArray.from_arrays([*flat, inner], ["start", "stop", "logits"]),
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], [*batch.schema.names, "tokens"])

    return chunked.mapInArrow(run, f"{schema}, tokens {TOKENS}")


def label_tokens(df: DataFrame) -> DataFrame:
    """Replace logits by the most likely label (first on ties) and its softmax probability.

    Zero-width tokens are dropped; the probability is only worked out for labels of an entity.
    """
    peak = "array_max(t.logits)"
    power = f"aggregate(t.logits, 0D, (a, x) -> a + exp(double(x) - double({peak})))"
    entity = [quoted(ENTITY_OF_LABEL.get(x[2:], "")) for x in LABELS]
    opens = [str(x.startswith("B-")).lower() for x in LABELS]
    chosen = f"""transform(filter(tokens, t -> t.start <> t.stop), t -> named_struct(
        't', t, 'label', int(array_position(t.logits, {peak}) - 1)))"""
    named = f"""transform(_chosen, c -> named_struct(
        'start', c.t.start, 'stop', c.t.stop, 'opens', array({', '.join(opens)})[c.label],
        'pii_type', nullif(array({', '.join(entity)})[c.label], ''), 't', c.t))"""
    typed = f"""transform(_named, n -> named_struct('start', n.start, 'stop', n.stop, 'opens', n.opens,
        'pii_type', n.pii_type, 'p', if(n.pii_type IS NULL, NULL, 1D / {power.replace('t.logits', 'n.t.logits')})))"""
    steps = (("_chosen", chosen), ("_named", named), ("labels", typed))
    for name, step in steps:
        df = df.withColumn(name, F.expr(step))
    return df.drop("_chosen", "_named", "tokens")


def decode(df: DataFrame, *keys: str) -> DataFrame:
    """Entities of each chunk as an array of detections with absolute offsets.

    A label without an entity ends a span; a begin label, another type, or the first label after an
    end starts one. The marks cut the token array, so each span is one slice and the work is linear.
    """
    begins = """t.pii_type IS NOT NULL AND (t.opens OR i = 0 OR NOT (labels[i - 1].pii_type <=> t.pii_type))"""
    marks = f"""filter(transform(labels, (t, i) -> named_struct('at', i, 'first', {begins}, 'other', t.pii_type IS NULL)),
        m -> m.first OR m.other)"""
    spans = """filter(transform(_marks, (m, k) -> named_struct('first', m.first, 'tokens', if(m.first,
        slice(labels, m.at + 1, coalesce(get(_marks, k + 1).at, size(labels)) - m.at), NULL))), s -> s.first)"""
    category = "map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in CATEGORY_BY_TYPE.items()) + ")"
    around = "concat(before, chunk, after)"
    lead = "char_length(before)"
    space = quoted(r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$")
    flat = """transform(_spans, s -> named_struct('pii_type', s.tokens[0].pii_type, 'start', s.tokens[0].start,
        'stop', s.tokens[size(s.tokens) - 1].stop, 'p', aggregate(s.tokens, 0D, (a, t) -> a + t.p) / size(s.tokens)))"""
    built = f"""filter(transform(array(_around), z -> transform(_found, e -> named_struct(
        'start', chunk_start + e.start, 'pii_type', e.pii_type, 'stop', chunk_start + e.stop,
        'value', regexp_replace(substring(chunk, e.start + 1, e.stop - e.start), {space}, ''),
        'category', {category}[e.pii_type], 'method', 'ner', 'confidence', round(e.p, 4),
        'excerpt', substring(z, greatest({lead} + e.start - {EXCERPT_RADIUS}, 0) + 1,
            {lead} + e.stop + {EXCERPT_RADIUS} - greatest({lead} + e.start - {EXCERPT_RADIUS}, 0)))))[0],
        d -> d.value <> '')"""
    for name, step in (("_marks", marks), ("_spans", spans), ("_found", flat), ("_around", around)):
        df = df.withColumn(name, F.expr(step))
    return df.select(*keys, "chunk_start", F.expr(f"cast({built} AS {DETECTIONS})").alias("detections"))


#: Chunks that a model sees at once.
MODEL_CHUNKS = 64
#: Chunks whose entities leave Python together, at the end of a text; a longer text leaves alone.
OUTPUT_CHUNKS = 256
SPANS = "array<struct<start:int,stop:int,kind:int,confidence:double,value:string>>"


def _entity_spans(factory: Callable, types: list[str], opens: list[bool], width: int) -> Callable:
    """Arrow lists of chunks to Arrow lists of entities: argmax, softmax and span decoding on whole arrays of tokens.

    Only entities leave Python, not logits, with offsets in their text, the number of their type in sorted order and their
    characters without blanks at the ends, if any are left. They leave after a bounded number of chunks, so what a worker holds does not grow with Spark's batches.
    """

    def decoded(found: list[Tokens], first: int, known: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
        counts = [len(s) for s, _, _ in found]
        chunk = np.repeat(np.arange(first, first + len(found)), counts)
        start, stop = (np.concatenate([np.asarray(t[k], np.int64) for t in found]) for k in (0, 1))
        logits = np.concatenate([np.asarray(t[2], np.float32).reshape(n, -1) for t, n in zip(found, counts, strict=True) if n] or [np.zeros((0, 1), np.float32)])
        real = start != stop
        chunk, start, stop, logits = chunk[real], start[real], stop[real], logits[real].astype(np.float64)
        label = logits.argmax(axis=1) if len(logits) else np.zeros(0, np.int64)
        power = np.zeros(len(label))
        if len(label):
            peak = logits.max(axis=1)
            for column in logits.T:
                power += np.exp(column - peak)
        kind = known[label] if len(label) else np.zeros(0, np.int64)
        before = np.concatenate([[-1], np.where(chunk[1:] == chunk[:-1], kind[:-1], -1)]) if len(kind) else kind
        begins = (kind >= 0) & (begin[label] | (kind != before)) if len(kind) else np.zeros(0, bool)
        inside = kind >= 0
        span, at = np.cumsum(begins)[inside] - 1, np.nonzero(begins)[0]
        held = np.bincount(span, minlength=len(at))
        total = np.bincount(span, weights=1.0 / power[inside], minlength=len(at))
        last = at + held - 1
        return [chunk[at].astype(np.int32), start[at].astype(np.int32), stop[last].astype(np.int32), kind[at].astype(np.int32), total / np.maximum(held, 1)]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        model = factory()
        names = sorted({t for t in types if t})
        known, begin = np.array([names.index(t) if t else -1 for t in types]), np.array(opens)
        empty = [np.zeros(0, np.int32)] * 4 + [np.zeros(0)]
        for batch in batches:
            texts = batch.flatten()
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch), 0), np.int64)
            ends = np.cumsum(sizes)
            row = done = 0
            while row < len(sizes):
                # Whole texts, at least one.
                after = max(row + 1, int(np.searchsorted(ends, done + OUTPUT, side="right")))
                until = int(ends[after - 1])
                shown = texts.slice(done, until - done).to_pylist()
                parts = [decoded(model(shown[k : k + MODEL]), done + k, known, begin) for k in range(0, len(shown), MODEL)]
                found = [np.concatenate([p[k] for p in parts] or [empty[k]]) for k in range(5)]
                values = [shown[c][a:b].strip() for c, a, b in zip((found[0] - done).tolist(), found[1].tolist(), found[2].tolist(), strict=True)]
                if "" in values:
                    kept = [k for k, v in enumerate(values) if v]
                    found, values = [f[kept] for f in found], [values[k] for k in kept]
                chunk, start, stop, kind, sure = found
                doc = np.searchsorted(ends, chunk, side="right")
                own = ((chunk - (ends - sizes)[doc]) * width).astype(np.int32) if len(doc) else chunk
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc - row, minlength=after - row))])
                rows = pa.StructArray.from_arrays([pa.array(own + start), pa.array(own + stop), pa.array(kind), pa.array(sure), pa.array(values, pa.string())], ["start", "stop", "kind", "confidence", "value"])
                yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
                row, done = after, until

    MODEL, OUTPUT = MODEL_CHUNKS, OUTPUT_CHUNKS
    return run


def tag(df: DataFrame, text: str, factory: Callable, output: str = "entities", width: int = CHUNK_CHARS, excerpts: bool = True) -> DataFrame:
    """Add ``output``: the entities that a model finds in each text, in the shape and order of ``detect``'s detections.

    A text is cut into chunks inside its row and its entities come back to the row, so nothing is shuffled however many
    chunks it has; the model sees a bounded number of chunks at once. ``factory`` is the one of ``predict``. Without
    ``excerpts``, which are most of what an entity holds, they are null.
    """
    types = [ENTITY_OF_LABEL.get(x[2:], "") for x in LABELS]
    spans = _entity_spans(factory, types, [x.startswith("B-") for x in LABELS], width)
    found = F.arrow_udf(spans, SPANS)
    names = sorted({t for t in types if t})
    kinds, categories = (f"array({', '.join(map(quoted, x))})[e.kind]" for x in (names, [CATEGORY_BY_TYPE[t] for t in names]))
    around = cut("z.p", f"greatest(e.start - {EXCERPT_RADIUS}, 0)", f"least(e.stop + {EXCERPT_RADIUS}, z.n)") if excerpts else "NULL"
    held = "'p', _pieces, 'n', _len, " if excerpts else ""
    built = f"""transform(array(named_struct({held}'e', _found)), z -> transform(z.e, e -> named_struct(
        'start', e.start, 'pii_type', {kinds}, 'stop', e.stop, 'value', e.value, 'category', {categories}, 'method', 'ner',
        'confidence', round(e.confidence, 4), 'excerpt', {around})))[0]"""
    columns = [f"`{c}`" for c in df.columns]
    cutting = df.selectExpr(*columns, f"coalesce(`{text}`, '') AS _text").selectExpr(*columns, "_text", f"{pieces('_text', width)} AS _chunks")
    tagged = cutting.withColumn("_found", found(F.col("_chunks")))
    if excerpts:
        tagged = tagged.selectExpr(*columns, "_found", f"{pieces('_text')} AS _pieces", "char_length(_text) AS _len")
    return tagged.selectExpr(*columns, f"cast({built} AS {DETECTIONS}) AS `{output}`")


def detect_entities(df: DataFrame, *keys: str, factory: Callable, text: str = "text", excerpts: bool = True) -> DataFrame:
    """One row per entity found by the model, in the shape of the other detections."""
    return explode_detections(tag(df.select(*keys, text), text, factory, "detections", excerpts=excerpts), *keys)
