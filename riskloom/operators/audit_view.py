"""The audit view: normalised file rows with types, severity, category and excerpt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.catalog import (
    VIEW_CATEGORIES,
    VIEW_EXCERPT,
    VIEW_FALLBACK,
    VIEW_RAISED,
    VIEW_SEVERE,
    VIEW_TOP_PII,
)
from riskloom.functions import paths as P
from riskloom.functions.matching import quoted
from riskloom.operators.detect import presence

NO_TYPES = "cast(array() as array<string>)"


def normalize_types(types: str) -> str:
    """SQL: lower-cased distinct type names without blanks, in first-seen order."""
    return f"array_distinct(filter(transform(coalesce({types}, {NO_TYPES}), t -> lower(t)), t -> t <> ''))"


def normalize_type_structs(items: str, fields: tuple[str, ...] = ("pii_type", "type", "label", "name")) -> str:
    """SQL: the same for structs, taking the first non-blank of the naming fields."""
    name = ", ".join(f"nullif(t.{f}, '')" for f in fields)
    return normalize_types(f"transform({items}, t -> coalesce({name}))")


def view_category(types: str, file_type: str) -> Column:
    """First category, in catalogue order, one of whose keywords occurs in any type."""
    cases = " ".join(
        f"WHEN exists({types}, t -> t RLIKE {quoted('|'.join(words))}) THEN {quoted(name)}"
        for name, words in VIEW_CATEGORIES
    )
    fallback = " ".join(f"WHEN {file_type} = {quoted(t)} THEN {quoted(c)}" for t, c in VIEW_FALLBACK)
    return F.expr(f"CASE {cases} {fallback} ELSE 'uncategorized' END")


def view_severity(types: str, override: str = "cast(NULL AS double)") -> Column:
    """0 to 3; a numeric override is rounded half up and clamped."""
    return F.expr(f"""CASE
        WHEN {override} IS NOT NULL THEN int(greatest(0, least(3, floor({override} + 0.5))))
        WHEN exists({types}, t -> t RLIKE {quoted(VIEW_SEVERE)}) THEN 3
        WHEN size({types}) >= 3 OR exists({types}, t -> t RLIKE {quoted(VIEW_RAISED)}) THEN 2
        WHEN size({types}) >= 1 THEN 1 ELSE 0 END""")


def view_metadata(files: DataFrame) -> Column:
    """``map<string,string>`` of ``modified``, ``size`` and ``source`` where given; entries of a ``metadata`` map come before them.

    Missing values have no entry, except those of ``metadata``, which hide the file's own.
    """
    has = dict(files.dtypes)
    none = "cast(map() AS map<string,string>)"
    own = [f"struct('{c}' AS key, string(`{c}`) AS value)" for c in ("modified", "size", "source") if c in has]
    fixed = f"map_from_entries(filter(array({', '.join(own)}), e -> e.value IS NOT NULL))" if own else none
    if "metadata" not in has:
        return F.expr(fixed)
    given = f"coalesce(cast(`metadata` AS map<string,string>), {none})"
    return F.expr(f"map_concat(map_filter({fixed}, (k, v) -> NOT map_contains_key({given}, k)), {given})")


def normalize_files(files: DataFrame, declared: str | None = None, metadata: bool = False) -> DataFrame:
    """One audit row per scanned file; ``pii`` holds every type, ``top_pii`` the first few for display.

    A file without a path is named by its ``id``, or else by a position of its own, so that no two share a name; rows of equal content
    stay apart. ``metadata`` adds what ``view_metadata`` merges.

    ``declared`` is a SQL expression for the types reported with the file. Optional columns are used
    when present: value sources in order of preference, ``severity``, ``category``, ``excerpt``,
    ``id``, ``file_type``, ``content``.
    """
    has = set(files.columns)

    def column(name: str, kind: str) -> str:
        return f"`{name}`" if name in has else f"cast(NULL AS {kind})"

    sources = [s for s in ("value", "privacy_debt", "token_count", "tokens", "size") if s in has]
    value = f"coalesce({', '.join([f'nullif(double({s}), 0)' for s in sources] + ['1D'])})"
    content, excerpt = column("content", "string"), column("excerpt", "string")
    # A file without content is judged by its excerpt.
    start = files.withColumn("_content", F.expr(f"coalesce({content}, '')")).withColumn(
        "_judged", F.expr(f"coalesce(nullif({content}, ''), {excerpt}, '')")
    )
    if metadata:
        start = start.withColumn("_metadata", view_metadata(files))
    own = F.expr(f"nullif({column('id', 'string')}, '')") if "id" in has else F.lit(None)
    unknown = F.concat(F.lit("unknown-"), F.coalesce(own, F.monotonically_increasing_id().cast("string")))
    start = start.withColumn("path", F.when(F.coalesce(F.col("path"), F.lit("")) == "", unknown).otherwise(F.col("path")))
    present = start.withColumn("_present", presence("_judged"))
    typed = present.withColumn("_declared", F.expr(normalize_types(declared or "NULL")))
    merged = typed.withColumn("pii", F.expr("array_union(_declared, _present)"))
    every = merged.withColumn("_types", F.expr("array_union(if(size(_declared) > 0, _declared, pii), _present)"))
    kinded = every.withColumn(
        "_kind", F.coalesce(F.expr(f"nullif({column('file_type', 'string')}, '')"), P.view_extension(F.col("path")))
    )
    given = f"nullif({column('category', 'string')}, '')"
    return kinded.select(
        F.coalesce(F.expr(f"nullif({column('id', 'string')}, '')"), P.stable_id("path")).alias("id"),
        P.view_name(F.col("path")).alias("name"),
        "path",
        F.expr(f"bigint(greatest(1D, {value}))").alias("value"),
        view_severity("_types", column("severity", "double")).alias("severity"),
        "pii",
        F.expr(f"slice(pii, 1, {VIEW_TOP_PII})").alias("top_pii"),
        F.expr(f"coalesce(nullif({excerpt}, ''), left(_content, {VIEW_EXCERPT}))").alias("excerpt"),
        F.coalesce(F.expr(given), view_category("pii", "_kind")).alias("category"),
        F.col("_kind").alias("file_type"),
        *([F.col("_metadata").alias("metadata")] if metadata else []),
    )
