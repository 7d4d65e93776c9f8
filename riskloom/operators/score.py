"""Privacy-debt score of documents: weights, category breakdown, bonuses and severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.catalog import (
    BONUS_LOCATIONS,
    BONUS_WEIGHT,
    CATEGORY_BY_TYPE,
    DEFAULT_CATEGORY,
    DEFAULT_WEIGHT,
    OLD_FILE_SECONDS,
    RULES,
    SCORE_CAP,
    SCORE_CATEGORIES,
    SCORE_ORANGE,
    SCORE_YELLOW,
    WEIGHT_BY_TYPE,
    Rule,
)
from riskloom.functions.matching import any_of, quoted


def _weights(rules: Sequence[Rule]) -> dict[str, int]:
    return WEIGHT_BY_TYPE | {r.pii_type: r.weight for r in rules}


def _categories(rules: Sequence[Rule]) -> dict[str, str]:
    return CATEGORY_BY_TYPE | {r.pii_type: r.category for r in rules}


def weight_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Type, category and weight, one row per known type and rule."""
    categories = _categories(rules)
    rows = [(t, categories[t], w) for t, w in _weights(rules).items()]
    return spark.createDataFrame(rows, "pii_type string, category string, weight int")


def _literal_map(values: dict[str, object]) -> str:
    pairs = ", ".join(f"{quoted(k)}, {quoted(v) if isinstance(v, str) else v}" for k, v in values.items())
    return f"map({pairs})"


def weights_of(types: str, rules: Sequence[Rule] = RULES) -> str:
    """SQL: array of types to array of weights."""
    return f"transform({types}, t -> coalesce(try_element_at({_literal_map(_weights(rules))}, t), {DEFAULT_WEIGHT}))"


def severity(score: Column) -> Column:
    return F.when(score >= SCORE_ORANGE, "orange").when(score >= SCORE_YELLOW, "yellow").otherwise("green")


def location_bonus(path: Column) -> Column:
    return any_of(F.lower(path), BONUS_LOCATIONS)


def age_bonus(modified: Column, encrypted: Column, as_of: Column) -> Column:
    age = F.unix_micros(as_of) - F.unix_micros(modified)
    return F.coalesce((age > OLD_FILE_SECONDS * 1_000_000) & ~F.coalesce(encrypted, F.lit(False)), F.lit(False))


def bonuses(path: Column, modified: Column, encrypted: Column, as_of: Column) -> Column:
    """``array<struct<reason,weight>>`` in the order the reasons are checked."""

    def entry(condition: Column, reason: str) -> Column:
        return F.when(condition, F.struct(F.lit(reason).alias("reason"), F.lit(BONUS_WEIGHT).alias("weight")))

    found = F.array(
        entry(location_bonus(path), "sensitive_location"),
        entry(age_bonus(modified, encrypted, as_of), "old_unencrypted_file"),
    )
    return F.filter(found, lambda b: b.isNotNull())


def score_types(df: DataFrame, types: str, bonus: str = "0", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add raw score, capped score and severity from an array of types, inside the row.

    ``types`` and ``bonus`` are SQL expressions; ``rules`` are those the types were detected by. No shuffle: a document's types are already together.
    """
    raw = f"int(aggregate({weights_of(types, rules)}, 0, (a, w) -> a + w) + {bonus})"
    capped = df.withColumn("raw_score", F.expr(raw)).withColumn("score", F.least("raw_score", F.lit(SCORE_CAP)))
    return capped.withColumn("severity", severity(F.col("score")))


def breakdown(df: DataFrame, types: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add one zero-filled column per category with the weight it contributes, inside the row."""
    categories, weights = _literal_map(_categories(rules)), _literal_map(_weights(rules))

    def part(name: str) -> Column:
        mine = f"filter({types}, t -> coalesce(try_element_at({categories}, t), {quoted(DEFAULT_CATEGORY)}) = {quoted(name)})"
        return F.expr(
            f"aggregate({mine}, 0, (a, t) -> a + coalesce(try_element_at({weights}, t), {DEFAULT_WEIGHT}))"
        ).alias(name)

    return df.select("*", *[part(name) for name in SCORE_CATEGORIES])


def types_of_any(detections: str | None = None, pii_types: str | None = None) -> str:
    """SQL for the types in whichever result shape is present: detections first, then plain types."""
    empty = "cast(array() as array<string>)"
    shapes = [f"{detections}.pii_type" if detections else None, pii_types]
    return f"coalesce({', '.join(s for s in shapes if s)}, {empty})"


def weigh(detections: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Long detections with weight and category: a left join to the table of known types.

    A category already on the detection wins over the table's.
    """
    dim = weight_table(detections.sparkSession, rules).withColumnRenamed("category", "_category")
    own = F.col("category") if "category" in detections.columns else F.lit(None).cast("string")
    rest = [c for c in detections.columns if c != "category"]
    return detections.join(F.broadcast(dim), "pii_type", "left").select(
        *rest,
        F.coalesce(F.nullif(own, F.lit("")), "_category", F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce("weight", F.lit(DEFAULT_WEIGHT)).alias("weight"),
    )


def score_rows(weighed: DataFrame, key: str) -> DataFrame:
    """Raw score and breakdown from long weighed rows: one partial-then-final aggregate per key."""
    parts = [
        F.coalesce(F.sum(F.when(F.col("category") == c, F.col("weight"))), F.lit(0)).alias(c) for c in SCORE_CATEGORIES
    ]
    return weighed.groupBy(key).agg(F.sum("weight").alias("raw_score"), *parts)


def with_file_metadata(scores: DataFrame, files: DataFrame, as_of: Column, key: str = "path") -> DataFrame:
    """Join scores to file metadata, add the bonuses and finish score and severity.

    ``files`` has one row per ``key`` with ``path``, ``modified`` and optionally ``encrypted``; files
    without detections keep a score made of bonuses alone.
    """
    encrypted = F.col("encrypted") if "encrypted" in files.columns else F.lit(False)
    joined = files.join(scores, key, "left").fillna(0, ["raw_score", *SCORE_CATEGORIES])
    listed = joined.withColumn("bonus_list", bonuses(F.col("path"), F.col("modified"), encrypted, as_of))
    summed = listed.withColumn("bonuses", (F.size("bonus_list") * BONUS_WEIGHT).cast("long"))
    raw = summed.withColumn("raw_score", F.col("raw_score") + F.col("bonuses"))
    scored = raw.withColumn("score", F.least("raw_score", F.lit(SCORE_CAP)))
    return scored.withColumn("severity", severity(F.col("score")))
