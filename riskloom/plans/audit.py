"""Whole audits: from files on disk to detections, scores and the audit view."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.catalog import RULES, Rule
from riskloom.operators.audit_view import normalize_files
from riskloom.operators.detect import dedupe, detect
from riskloom.operators.entities import tag
from riskloom.operators.inventory import dispatch, scan_stats, visit, with_metadata, within_budget
from riskloom.operators.score import bonuses, breakdown, score_types
from riskloom.sources.files import WHOLE, Bounds, extract, read_tree
from riskloom.sources.tree import closed_directories, inventory_of, list_tree, with_contents


@dataclass(frozen=True)
class Scan:
    """``files``: text and metadata of every file read; ``visited``: all files seen; ``stats``: counters; ``errors``: unreadable files."""

    files: DataFrame
    visited: DataFrame
    stats: DataFrame
    errors: DataFrame


def scan(
    spark: SparkSession,
    roots: Sequence[str],
    as_of: Column | None = None,
    max_depth: int | None = None,
    max_files: int | None = None,
    max_file_size_mb: float | None = None,
    bounds: Bounds = WHOLE,
    inventory: DataFrame | None = None,
    complete: bool = False,
) -> Scan:
    """Scan directory roots, or any ``inventory`` table with ``path, size, modified, content`` and, if known, ``error``.

    Nothing is left out by default; depth, size and number of files are limits of the caller. ``complete`` lists roots on a file system
    that every executor mounts name by name: hidden names, empty files, and files and directories that cannot be read, which
    become ``errors`` and end nothing. Otherwise Spark lists the roots, in any store it knows.
    """
    closed = None
    if inventory is None and complete:
        tree = list_tree(spark, roots, max_depth)
        closed = closed_directories(tree, roots, max_depth)
        listed = inventory_of(tree).withColumn("content", F.lit(None).cast("binary"))
    else:
        listed = read_tree(spark, roots) if inventory is None else inventory
    seen = visit(listed, roots, max_depth)
    if max_files is not None:
        seen = within_budget(seen, max_files)
    visited = dispatch(seen, max_file_size_mb)
    held = visited if closed is None else with_contents(visited.filter("outcome = 'read'"))
    files = extract(with_metadata(held, as_of if as_of is not None else F.current_timestamp()), bounds)
    why = F.col("error") if "error" in visited.columns else F.lit(None).cast("string")
    errors = visited.filter("outcome = 'error'").select("path", why.alias("error"))
    if closed is not None:
        errors = errors.unionByName(closed.select("path", "error"))
    return Scan(files, visited.drop("content"), scan_stats(visited, roots, closed), errors)


Model = Callable[[], Callable]


def classified(files: DataFrame, text: str = "content", rules: Sequence[Rule] = RULES, model: Model | None = None, excerpts: bool = True) -> DataFrame:
    """``files`` with ``detections``: matches of the rules and, with a ``model``, its entities, each finding once, in order.

    Both are sorted arrays of the text's own row; where they name the same span, the surer one stays, the rules' first. Entities
    come without excerpts if the caller needs none.
    """
    found = detect(files, text=text, rules=rules)
    if model is not None:
        found = tag(found, text, model, "_entities", excerpts=excerpts)
        found = found.withColumn("detections", F.concat("detections", "_entities")).drop("_entities")
    return dedupe(found)


def scored_files(files: DataFrame, as_of: Column, rules: Sequence[Rule] = RULES, model: Model | None = None) -> DataFrame:
    """Detections, score, severity, breakdown and bonuses of every file, without a shuffle."""
    found = classified(files, "content", rules, model).withColumn(
        "bonuses", bonuses(F.col("path"), F.col("modified"), F.lit(False), as_of)
    )
    scored = score_types(found, "detections.pii_type", "aggregate(bonuses, 0, (a, b) -> a + b.weight)", rules)
    return breakdown(scored, "detections.pii_type", rules)


def audit(files: DataFrame, rules: Sequence[Rule] = RULES, model: Model | None = None) -> DataFrame:
    """Audit-view rows of scanned files, declared types coming from the detections."""
    return normalize_files(classified(files, "content", rules, model, excerpts=False), "array_distinct(detections.pii_type)")
