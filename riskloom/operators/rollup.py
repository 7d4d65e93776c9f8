"""Rollups of the audit view: groups, top-N with an "others" row, directories, portfolio, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.catalog import GROUP_VISIBLE, TONE_CRITICAL, TONE_ELEVATED, TOP_N_FILES
from riskloom.functions.paths import stable_id
from riskloom.operators.ordering import cutoff, numbered
from riskloom.sources.sinks import materialize

GROUP_KEYS = {"category": "category", "type": "file_type", "file": "'files'"}
FILE_COLUMNS = ("id", "name", "path", "value", "severity", "pii", "top_pii", "excerpt", "category", "file_type")


def group_key(by: str) -> Column:
    return F.expr(GROUP_KEYS[by])


def group_totals(files: DataFrame, by: str = "category") -> DataFrame:
    """Value, severity and count per group; the files themselves stay in their own rows."""
    totals = files.groupBy(group_key(by).alias("group_name")).agg(
        F.sum("value").alias("value"), F.max("severity").alias("severity"), F.count("*").alias("file_count")
    )
    name = F.concat(F.lit(f"{by}:"), "group_name")
    return totals.select(stable_id(f"concat('{by}:', group_name)").alias("id"), name.alias("name"), "*")


def all_group_totals(files: DataFrame) -> DataFrame:
    """The three groupings and the grand total in one pass over the files."""
    grouped = files.groupingSets([["category"], ["file_type"], []], "category", "file_type").agg(
        F.grouping("category").alias("gc"),
        F.grouping("file_type").alias("gt"),
        F.sum("value").alias("value"),
        F.max("severity").alias("severity"),
        F.count("*").alias("file_count"),
    )
    view = F.when(F.col("gc") == 0, "category").when(F.col("gt") == 0, "type").otherwise("root")
    return grouped.select(
        view.alias("view"),
        F.coalesce("category", "file_type", F.lit("root")).alias("group_name"),
        "value",
        "severity",
        "file_count",
    )


def top_n_with_others(files: DataFrame, n: int = TOP_N_FILES) -> DataFrame:
    """The ``n`` largest files and one row for the rest.

    The boundary is the key of the ``n``-th file, so kept and remaining rows are told apart by a
    comparison instead of a join.
    """
    cut = cutoff(files, [("value", True), ("path", False)], n).scalar()
    key = F.struct((-F.col("value")).alias("a"), F.col("path").alias("b"))
    edge = F.struct((-F.col("_cut.value")).alias("a"), F.col("_cut.path").alias("b"))
    marked = files.withColumn("_cut", cut).withColumn("_kept", F.col("_cut").isNull() | (key <= edge))
    rest = (
        marked.filter("NOT _kept")
        .agg(F.count("*").alias("k"), F.sum("value").alias("value"), F.max("severity").alias("severity"))
        .filter("k > 0")
    )
    others = rest.select(
        stable_id("concat('others-', k, '-', value)").alias("id"),
        F.concat(F.lit("Others ("), F.col("k").cast("string"), F.lit(")")).alias("name"),
        F.lit("").alias("path"),
        "value",
        "severity",
        F.expr("cast(array() as array<string>)").alias("pii"),
        F.expr("cast(array() as array<string>)").alias("top_pii"),
        F.lit("").alias("excerpt"),
        F.lit("others").alias("category"),
        F.lit("aggregate").alias("file_type"),
    )
    return marked.filter("_kept").select(*FILE_COLUMNS).unionByName(others)


def group_children(files: DataFrame, by: str = "category", visible: int = GROUP_VISIBLE) -> DataFrame:
    """Children of every group: all files of a small group, else the largest and one "others" row.

    Rank is only computed for the first rows of a group (kept per task before the shuffle); the rest
    is told apart by the group's cut-off key and aggregated with partial sums, so a group holding
    most files never meets in one task.
    """
    keyed = files.withColumn("group_name", group_key(by))
    narrow = keyed.select("group_name", "value", "path")
    w = Window.partitionBy("group_name").orderBy(F.desc("value"), "path")
    ranked = narrow.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= visible + 1)
    # A group with more than ``visible`` files shows ``visible - 1`` of them.
    edge = F.struct((-F.col("value")).alias("a"), F.col("path").alias("b"))
    cuts = ranked.groupBy("group_name").agg(
        F.max(F.when(F.col("rn") == visible - 1, edge)).alias("edge"), F.max("rn").alias("seen")
    )
    cuts = cuts.filter(F.col("seen") > visible).select("group_name", "edge")
    if by == "file":
        joined = keyed.withColumn("edge", cuts.select("edge").scalar())
    else:
        joined = keyed.join(cuts, "group_name", "left")
    mine = F.struct((-F.col("value")).alias("a"), F.col("path").alias("b"))
    marked = joined.withColumn("_kept", F.col("edge").isNull() | (mine <= F.col("edge")))
    rest = marked.filter("NOT _kept")
    totals = rest.groupBy("group_name").agg(
        F.count("*").alias("k"), F.sum("value").alias("value"), F.max("severity").alias("severity")
    )
    seen = (
        rest.select("group_name", "value", "path", F.posexplode("pii").alias("pos", "pii_type"))
        .groupBy("group_name", "pii_type")
        .agg(F.min(F.struct((-F.col("value")).alias("a"), F.col("path").alias("b"), "pos")).alias("at"))
    )
    # One entry per distinct type of a group, never one per file.
    kinds = seen.groupBy("group_name").agg(F.array_sort(F.collect_list(F.struct("at", "pii_type"))).alias("s"))
    others = totals.join(kinds, "group_name", "left").select(
        "group_name",
        stable_id("concat('others-', group_name, '-', k, '-', value)").alias("id"),
        F.expr("concat('+', k, ' other files')").alias("name"),
        F.expr("concat(k, ' other files')").alias("path"),
        "value",
        "severity",
        F.expr("coalesce(s.pii_type, cast(array() as array<string>))").alias("pii"),
        F.expr("slice(coalesce(s.pii_type, cast(array() as array<string>)), 1, 3)").alias("top_pii"),
        F.expr("concat('Contains ', k, ' smaller files in the ', group_name, ' category.')").alias("excerpt"),
        F.col("group_name").alias("category"),
        F.lit("aggregate").alias("file_type"),
    )
    return marked.filter("_kept").select("group_name", *FILE_COLUMNS).unionByName(others)


def treemap(files: DataFrame, by: str = "category", n: int = TOP_N_FILES) -> tuple[DataFrame, DataFrame]:
    """Groups and their children after the global top-N cut, as two flat tables."""
    shown = top_n_with_others(files, n)
    return group_totals(shown, by), group_children(shown, by)


def root_totals(groups: DataFrame) -> DataFrame:
    """One row over the groups."""
    return groups.agg(
        F.coalesce(F.sum("value"), F.lit(0)).alias("value"),
        F.coalesce(F.max("severity"), F.lit(0)).alias("severity"),
        F.count("*").alias("group_count"),
    )


def common_prefix(files: DataFrame, path: str = "path") -> DataFrame:
    """One row with the longest common directory of all paths.

    The common prefix of a whole set is that of its smallest and largest member, so two aggregates
    replace a pairwise fold.
    """
    parts = F.expr(f"split(`{path}`, '[\\\\\\\\/]', -1)")
    ends = files.filter(F.col(path) != "").agg(F.min(parts).alias("lo"), F.max(parts).alias("hi"))
    same = "zip_with(lo, hi, (a, b) -> a <=> b)"
    length = f"coalesce(nullif(int(array_position({same}, false)), 0) - 1, size(lo))"
    shared = ends.withColumn("shared", F.expr(f"slice(lo, 1, {length})"))
    trimmed = "if(contains(coalesce(try_element_at(shared, -1), ''), '.'), slice(shared, 1, size(shared) - 1), shared)"
    return shared.select(F.coalesce(F.array_join(F.expr(trimmed), "/"), F.lit("")).alias("prefix"))


def relative_parts(files: DataFrame) -> DataFrame:
    """Add ``dirs`` (directories below the common prefix) and ``leaf`` (name within them)."""
    prefix = common_prefix(files).scalar()
    with_prefix = files.withColumn("_prefix", prefix)
    relative = """if(_prefix <> '' AND startswith(path, _prefix),
        regexp_replace(substring(path, char_length(_prefix) + 1), '^[\\\\\\\\/]', ''), path)"""
    split = with_prefix.withColumn("_parts", F.expr(f"filter(split({relative}, '[\\\\\\\\/]', -1), p -> p <> '')"))
    return split.select(
        *files.columns,
        F.expr("slice(_parts, 1, greatest(size(_parts) - 1, 0))").alias("dirs"),
        F.expr("coalesce(try_element_at(_parts, -1), nullif(name, ''), path)").alias("leaf"),
    )


def directory_nodes(files: DataFrame) -> DataFrame:
    """Every directory with the totals of all files below it, the root having level 0.

    Files are summed per directory first; only directories, not files, are repeated per ancestor.
    """
    local = (
        relative_parts(files)
        .groupBy("dirs")
        .agg(F.sum("value").alias("value"), F.max("severity").alias("severity"), F.count("*").alias("n"))
    )
    ancestors = local.select(
        "value", "severity", "n", "dirs", F.explode(F.expr("sequence(0, size(dirs))")).alias("level")
    )
    nodes = (
        ancestors.withColumn("path", F.expr("array_join(slice(dirs, 1, level), '/')"))
        .groupBy("path", "level")
        .agg(
            F.sum("value").alias("value"),
            F.max("severity").alias("severity"),
            F.sum("n").alias("file_count"),
            F.sum(F.when(F.size("dirs") == F.col("level"), F.col("n")).otherwise(0)).alias("local_count"),
        )
    )
    # The root is named by the directory that all files share.
    root = F.coalesce(F.nullif(common_prefix(files).scalar(), F.lit("")), F.lit("root"))
    parent = F.when(F.col("level") > 1, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).when(F.col("level") == 1, "")
    return nodes.select(
        F.when(F.col("level") == 0, "root").otherwise(stable_id("concat('dir:', path)")).alias("id"),
        F.when(F.col("level") == 0, root).otherwise(F.substring_index("path", "/", -1)).alias("name"),
        "path",
        parent.alias("parent"),
        "level",
        "value",
        "severity",
        "file_count",
        "local_count",
    )


def ordered_tree(files: DataFrame) -> DataFrame:
    """Directories and files as a tree in reading order: ``path, name, level, is_dir, value, severity, enter, leave``.

    Below a directory come its directories by name, then its files by name. ``enter`` numbers the rows from 1 in that order and ``leave`` is the
    number of the last row below, so that the rows inside a directory are those between its two numbers. A row's key is
    the list of names that leads to it, directories before files, so one range partitioning orders a tree of any shape.
    """
    split = relative_parts(files)

    def key(names: str, kind: int) -> str:
        return f"transform({names}, d -> named_struct('kind', {kind}, 'name', d))"

    leaves = split.select(
        F.expr(f"concat({key('dirs', 0)}, {key('array(leaf)', 1)})").alias("key"), F.expr("array_join(concat(dirs, array(leaf)), '/')").alias("path"),
        F.col("leaf").alias("name"), F.expr("size(dirs) + 1").alias("level"), F.lit(False).alias("is_dir"), F.col("value").cast("long").alias("value"), "severity", F.lit(0).cast("long").alias("below"),
    )
    local = split.groupBy("dirs").agg(F.sum("value").alias("value"), F.max("severity").alias("severity"), F.count("*").alias("n"))
    above = local.select("dirs", "value", "severity", "n", F.explode(F.expr("sequence(0, size(dirs))")).alias("level"))
    nodes = above.groupBy(F.expr("slice(dirs, 1, level)").alias("dirs")).agg(F.sum("value").alias("value"), F.max("severity").alias("severity"), F.sum("n").alias("n"))
    nodes = materialize(nodes)
    # Directories below a directory: each counts for all those above it.
    inner = nodes.select(F.explode(F.expr("transform(sequence(0, size(dirs)), i -> slice(dirs, 1, i))")).alias("dirs")).groupBy("dirs").agg(F.count("*").alias("d"))
    inside = nodes.join(inner, "dirs").select(
        F.expr(key("dirs", 0)).alias("key"), F.array_join("dirs", "/").alias("path"), F.coalesce(F.try_element_at("dirs", F.lit(-1)), F.lit("")).alias("name"),
        F.size("dirs").alias("level"), F.lit(True).alias("is_dir"), F.col("value").cast("long").alias("value"), "severity", (F.col("n") + F.col("d") - 1).alias("below"),
    )
    rows = numbered(leaves.unionByName(inside), ["key"], "enter")
    return rows.select("path", "name", "level", "is_dir", "value", "severity", "enter", (F.col("enter") + F.col("below")).alias("leave"))


def ordered_groups(groups: DataFrame) -> DataFrame:
    """Groups with ``place``: by value, largest first, then by name."""
    keyed = groups.withColumn("_down", -F.col("value"))
    return numbered(keyed, ["_down", "group_name"], "place").drop("_down")


def node_paths(files: str = "files", path: str = "path") -> Column:
    """Paths behind a node: those of its files, else its own."""
    own = f"filter(array({path}), p -> p <> '')"
    return F.expr(f"if(size({files}) > 0, filter({files}.path, p -> p <> ''), {own})")


def portfolio_score(files: DataFrame) -> DataFrame:
    """One row: 0 to 100 share of the highest possible risk, and its tone."""
    total = files.agg(F.coalesce(F.sum("severity"), F.lit(0)).alias("risk"), F.count("*").alias("files"))
    ratio = F.floor(F.try_divide(F.col("risk") * 100.0, F.col("files") * 3.0) + 0.5)
    scored = total.withColumn("score", F.coalesce(ratio, F.lit(0)).cast("int"))
    tone = F.when(F.col("score") >= TONE_CRITICAL, "critical").when(F.col("score") >= TONE_ELEVATED, "elevated")
    return scored.withColumn("tone", tone.otherwise("calm"))


def dashboard_metrics(files: DataFrame, by: str = "category") -> DataFrame:
    """One row: files, high-risk files, distinct types and groups.

    Distinct counts come from separate aggregates read as scalars, so no row is multiplied.
    """
    shown = files.select(F.explode("pii").alias("t")).distinct().agg(F.count("*").alias("n"))
    groups = files.select(group_key(by).alias("g")).distinct().agg(F.count("*").alias("n"))
    return files.agg(
        F.count("*").alias("files"), F.coalesce(F.count_if(F.col("severity") >= 3), F.lit(0)).alias("high_risk")
    ).select("files", "high_risk", shown.scalar().alias("pii_types"), groups.scalar().alias("categories"))


def matches_term(term: str) -> Column:
    """A file matches by name, path or any type, without regard to case."""
    low = F.lit(term.lower())
    return (
        F.contains(F.lower("name"), low)
        | F.contains(F.lower("path"), low)
        | F.exists("pii", lambda p: F.contains(F.lower(p), low))
    )


def search_groups(children: DataFrame, totals: DataFrame, term: str) -> DataFrame:
    """Groups with at least one matching child; their totals are not recomputed."""
    hit = children.filter(matches_term(term)).select("group_name").distinct()
    return totals.join(hit, "group_name", "left_semi")


def search_directories(files: DataFrame, nodes: DataFrame, term: str) -> DataFrame:
    """Directories that survive a search.

    A directory without sub-directories is tested by its own name and path; any other survives
    through a matching local file or a surviving sub-directory. Matches are found once and carried
    up to all ancestors, so no level-by-level loop is needed.
    """
    low = F.lit(term.lower())
    inner = nodes.filter("level > 0").select(F.col("parent").alias("path")).distinct().withColumn("inner", F.lit(True))
    marked = nodes.join(inner, "path", "left")
    by_name = marked.filter(
        F.col("inner").isNull() & (F.contains(F.lower("name"), low) | F.contains(F.lower("path"), low))
    ).select("path")
    found = (
        relative_parts(files)
        .select(F.array_join("dirs", "/").alias("path"), matches_term(term).alias("hit"))
        .filter("hit")
        .select("path")
        .distinct()
    )
    by_file = found.join(inner, "path", "left_semi")
    up = by_name.unionByName(by_file).select(
        F.explode(F.expr("""transform(sequence(0, if(path = '', 0, size(split(path, '/', -1)))),
            i -> array_join(slice(split(path, '/', -1), 1, i), '/'))""")).alias("path")
    )
    return nodes.join(up.distinct(), "path", "left_semi")
