"""Benchmark decontamination by winnowing: fingerprints of documents and items are joined, hits are extended.

Of every 9 consecutive 5-word grams the one with the least hash is a fingerprint (the first of equals), so any 13 words that a
document shares with an item hold a gram that both sides chose. A joined fingerprint is compared word by word and extended to
both sides as far as words agree; runs of 13 words and more are hits. Items of fewer than 13 words are one window each and
are looked up by the hash of the whole window. Texts stay in their rows: only matches are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower, shielded, small, text_of, unshielded, words_of, written

#: Characters that end a word, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 13, 5
SLIDE = WINDOW - GRAM + 1
#: Words beside a fingerprint that a window through it can reach.
REACH = WINDOW - GRAM
#: Fingerprint rows of about 300 bytes up to which the benchmark side is broadcast.
BROADCAST_FINGERPRINTS = 200_000


def _words(text: str) -> Column:
    return words_of(ascii_lower(text_of(text)), SEPARATORS)


def _every_window(size: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size("w") - size),
        lambda i: F.struct(i.alias("at"), F.lit(size).alias("len"), F.xxhash64(F.slice("w", i + 1, F.lit(size))).alias("hash")),
    )


def _places(df: DataFrame, lengths: list[int]) -> DataFrame:
    """``df`` (with ``w``) and ``places``: (at, len, hash) of its fingerprints (len 0) and of all windows of each short length."""
    n = F.size("w")
    gram = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(GRAM)]))
    df = df.withColumn("h", F.when(n >= WINDOW, gram).otherwise(F.array().cast("array<bigint>")))

    def least(i: Column) -> Column:
        view = F.slice("h", i + 1, F.lit(SLIDE))
        return (i + F.array_position(view, F.array_min(view)) - 1).cast("int")

    chosen = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("h") - SLIDE), least))
    df = df.withColumn("chosen", F.when(n >= WINDOW, chosen).otherwise(F.array().cast("array<int>")))
    places = [F.transform("chosen", lambda i: F.struct(i.alias("at"), F.lit(0).alias("len"), F.get("h", i).alias("hash")))]
    for size in lengths:
        places.append(F.when(n >= size, _every_window(size)).otherwise(F.array().cast("array<struct<at:int,len:int,hash:bigint>>")))
    return df.withColumn("places", F.concat(*places)).drop("h", "chosen")


def _context(at: Column, size: Column) -> Column:
    """The words of a place with those that a window through it can reach."""
    start = F.when(size > 0, at).otherwise(F.greatest(at - REACH, F.lit(0)))
    stop = F.when(size > 0, at + size).otherwise(at + GRAM + REACH)
    return F.slice("w", start + 1, stop - start)


def item_fingerprints(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """Distinct fingerprints of all items, as a written table, and the lengths of items with fewer than 13 words (12 at most)."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), _words(text).alias("w")).filter(F.size("w") > 0)
    short = F.size("w") < WINDOW
    lengths = sorted(r[0] for r in items.filter(short).select(F.size("w")).distinct().collect())
    long_rows = _places(items.filter(~short), []).select("item", "w", F.explode_outer("places").alias("p"))
    rows = long_rows.select("item", F.col("p.at").alias("at"), F.col("p.len").alias("len"), F.col("p.hash").alias("hash"), "w")
    whole = items.filter(short).select("item", F.lit(0).alias("at"), F.size("w").alias("len"), F.xxhash64("w").alias("hash"), "w")
    rows = rows.unionByName(whole)
    rows = rows.select("item", "hash", "len", _context(F.col("at"), F.col("len")).alias("iw"), F.least("at", F.lit(REACH)).alias("ip"))
    return written(rows.distinct(), "item_fingerprints"), lengths


def _agreeing(left: Column, at_left: Column, right: Column, at_right: Column, step: int) -> Column:
    """Number of equal words side by side, from the one next to the place on, at most ``REACH``."""
    out = F.lit(REACH)
    for k in range(REACH, 0, -1):
        a, b = at_left + step * k, at_right + step * k
        same = F.coalesce(F.get(left, a) == F.get(right, b), F.lit(False))
        out = F.when(~same, k - 1).otherwise(out)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc``, ``text_hash``, ``n_words``, ``n_hit``, ``items`` (sorted strings), ``contaminated`` for every row of ``docs``.

    A document word is hit if it stands in any occurrence of a window of an item. Null and empty texts have no words. Repeated rows
    get equal results; items without an id hit but are not listed; repeated items count once. An empty benchmark
    hits nothing.
    """
    prints, lengths = item_fingerprints(benchmark, item, item_text)
    prints = small(prints, BROADCAST_FINGERPRINTS)
    rows = docs.select(F.col(doc).alias("doc"), F.xxhash64(text_of(text)).alias("text_hash"), _words(text).alias("w"))
    # The last place stands for the document itself: it matches nothing and brings each row to the sums below.
    own = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("len"), F.lit(None).cast("bigint").alias("hash"))
    rows = _places(rows, lengths).withColumn("places", F.concat("places", F.array(own)))
    rows = rows.withColumn("n_words", F.size("w")).select("doc", "text_hash", "n_words", "w", F.explode_outer("places").alias("p"))
    at, size = F.col("p.at"), F.col("p.len")
    rows = rows.select("doc", "text_hash", "n_words", at.alias("at"), size.alias("len"), F.col("p.hash").alias("hash"),
                       F.when(at >= 0, _context(at, size)).alias("dw"), F.least(at, F.lit(REACH)).alias("dp"))
    hits = rows.join(prints, ["hash", "len"], "left").filter("item IS NOT NULL OR iw IS NOT NULL OR at = -1")
    dw, dp, iw, ip = (F.col(c) for c in ("dw", "dp", "iw", "ip"))
    same_gram = F.slice(dw, dp + 1, F.lit(GRAM)) == F.slice(iw, ip + 1, F.lit(GRAM))
    before = _agreeing(dw, dp, iw, ip, -1)
    after = _agreeing(dw, dp + GRAM - 1, iw, ip + GRAM - 1, 1)
    hits = hits.select("doc", "text_hash", "n_words", "at", "len", "item", (dw == iw).alias("equal"), same_gram.alias("same_gram"),
                       before.alias("before"), after.alias("after"))
    whole = (F.col("len") > 0) & F.col("equal")
    run = (F.col("len") == 0) & F.col("same_gram") & (F.col("before") + F.col("after") + GRAM >= WINDOW)
    span = F.when(whole, F.struct(F.col("at").alias("a"), (F.col("at") + F.col("len")).alias("b"))).when(
        run, F.struct((F.col("at") - F.col("before")).alias("a"), (F.col("at") + GRAM + F.col("after")).alias("b"))
    )
    sums = hits.groupBy("doc", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum((F.col("at") == -1).cast("int")).alias("copies"),
        F.collect_set(span).alias("spans"),
        F.sort_array(F.collect_set(F.when(span.isNotNull(), F.col("item")))).alias("items"),
    )
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    out = sums.withColumn("n_hit", covered).withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
    dirty = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc", "text_hash", "n_words", "n_hit", "items", dirty.alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    rows, names = shielded(docs)
    found = contamination(rows, benchmark, names[doc], names[text]).filter("contaminated")
    dirty = small(written(found.select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), "contaminated"))
    same = F.col(names[doc]).eqNullSafe(F.col("_doc")) & (F.xxhash64(text_of(names[text])) == F.col("_hash"))
    return unshielded(rows.join(dirty, same, "left_anti"), docs)
