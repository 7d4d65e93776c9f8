"""One query for each operator over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    chat_repair,
    chat_trie,
    decontaminate,
    entropy_mix,
    jaccard_join,
    language_mix,
    line_dedup,
    page_diff,
    quality_ranking,
    quality_rules,
    sql,
    token_counts,
    token_files,
    url_filter,
)
from riskloom.llm.common import written


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(doc: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc).cast("string").cast("binary"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = written(quality_rules.counts(docs), "counted")
    judged = quality_rules.judge(counted, quality_rules.fit(counted))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_ranking.fit(docs, labels.filter(_crc() % 5 != 0))
    scored = quality_ranking.score(docs, *model)
    return scored.select("doc_id", (_crc() % 5 == 0).alias("held_out"), "score", "predicted")


def op4_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_mix.fit(docs.filter(_crc() % 4 != 2))
    found = language_mix.predict(docs, model)
    return found.select("doc_id", (_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = entropy_mix.words_of(entropy_mix.text_of("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(sized).alias("words"))
    out = entropy_mix.mix(docs, size="words")
    return out.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def op6_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = page_diff.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = token_files.write_segments(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return token_files.read_segments(segments)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "template", "verdict")


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.summaries(chat_repair.damage(table(spark, sf_dir, "conversations")))


def op13_chat_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_trie.trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_token_counts,
        op3_quality_ranking,
        op4_language_mix,
        op5_source_mix,
        op6_page_diff,
        op7_line_dedup,
        op8_token_files,
        op9_decontaminate,
        op10_jaccard_join,
        op11_url_filters,
        op12_chat_repair,
        op13_chat_trie,
        pipeline,
    )
}

_SPACE = r"\x09-\x0D\x20"

#: A key is a trimmed, ASCII-lower-cased line.
LINE_DEDUP = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM docs
),
keyed AS (
    SELECT *, translate(regexp_replace(line, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
common AS (
    SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.holder AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

DECONTAMINATE = r"""
WITH split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
),
items AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, lengths WHERE len(w) >= n)
),
hits AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN windows v ON p.win = v.win AND p.n = v.n),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM split s LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLE: dict[str, str] = {
    "op7_line_dedup": LINE_DEDUP,
    "op9_decontaminate": DECONTAMINATE,
    "op11_url_filters": sql.url_filters(),
    "op12_chat_repair": sql.chat_repair(),
    "op13_chat_trie": sql.chat_trie(),
}
