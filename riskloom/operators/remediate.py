"""Remediation of tables: redact, encrypt, decrypt, purge, path overrides and their audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.catalog import ENCRYPTED_SUFFIX, NOT_REDACTABLE, REDACTION_MARK
from riskloom.functions.matching import quoted
from riskloom.functions.paths import view_name
from riskloom.sources.sinks import materialize


def redact(df: DataFrame, content: str = "content", pii_list: str = "pii_list") -> DataFrame:
    """Replace every listed value, in list order, by the mark; count the listed values that occurred.

    ``pii_list`` is ``array<struct<value,pii_type>>``. ``pii_types`` lists the requested types, also
    those that did not occur.
    """
    fold = f"""aggregate(coalesce(`{pii_list}`, array()),
        named_struct('text', `{content}`, 'n', 0),
        (a, p) -> if(coalesce(p.value, '') <> '' AND contains(a.text, p.value),
            named_struct('text', replace(a.text, p.value, {quoted(REDACTION_MARK)}), 'n', a.n + 1), a))"""
    types = f"array_sort(array_distinct(transform(coalesce(`{pii_list}`, array()), p -> coalesce(p.pii_type, 'unknown'))))"
    # Generating from the value keeps the optimizer from testing it in a filter below, which would detect and redact twice,
    # once in the few tasks that read the table.
    done = df.select("*", F.explode_outer(F.array(F.expr(fold))).alias("_redacted"))
    return (
        done.withColumn("pii_types", F.expr(types))
        .withColumn(content, F.col("_redacted.text"))
        .withColumn("replacements", F.col("_redacted.n"))
        .drop("_redacted")
    )


def eligibility(df: DataFrame) -> DataFrame:
    """Add whether a file may be redacted or decrypted."""
    return df.withColumn("can_redact", ~F.coalesce("file_type", F.lit("")).isin(*NOT_REDACTABLE)).withColumn(
        "can_decrypt", F.endswith("path", F.lit(ENCRYPTED_SUFFIX))
    )


def decrypt_rejection(paths: DataFrame, shown: int = 3) -> DataFrame:
    """One message naming at most ``shown`` paths that are not encrypted and how many more there are."""
    bad = paths.filter(~F.endswith("path", F.lit(ENCRYPTED_SUFFIX)))
    names = bad.orderBy("path").limit(shown).agg(F.array_sort(F.collect_list("path")).alias("p"))
    listed = names.select(F.array_join(F.transform("p", view_name), ", ").alias("names"))
    more = F.when(F.col("n") > shown, F.format_string(" (+%d more)", F.col("n") - shown)).otherwise("")
    return (
        bad.agg(F.count("*").alias("n"))
        .filter("n > 0")
        .select("n", F.concat(listed.scalar(), more).alias("message"))
    )


def encrypt(df: DataFrame, key: Column, content: str = "content") -> DataFrame:
    """AES-GCM over the content column; the path gains the encrypted suffix."""
    sealed = F.base64(F.aes_encrypt(F.col(content).cast("binary"), key, F.lit("GCM")))
    return (
        df.withColumn("original", F.col("path"))
        .withColumn(content, sealed)
        .withColumn("path", F.concat("path", F.lit(ENCRYPTED_SUFFIX)))
    )


def opened(df: DataFrame, key: Column, content: str = "content") -> DataFrame:
    """Every row with ``reason``: NULL where it was opened, else why not. A wrong key rejects instead of failing the job.

    Opened rows have their text, their path without the suffix and ``encrypted_file``, the path before; the rest is unchanged.
    Each content is decrypted once.
    """
    suffixed = F.endswith("path", F.lit(ENCRYPTED_SUFFIX))
    plain = F.try_aes_decrypt(F.try_to_binary(content, F.lit("base64")), key, F.lit("GCM")).cast("string")
    # Generating from the value keeps the optimizer from copying it into each of its uses.
    tried = df.select("*", F.explode_outer(F.array(F.when(suffixed, plain))).alias("_open"))
    done = F.col("_open").isNotNull()
    rest = [c for c in df.columns if c not in (content, "path", "encrypted_file", "reason")]
    return tried.select(
        *rest,
        F.when(done, F.left("path", F.char_length("path") - len(ENCRYPTED_SUFFIX))).otherwise(F.col("path")).alias("path"),
        F.coalesce("_open", F.col(content)).alias(content),
        F.when(done, F.col("path")).alias("encrypted_file"),
        F.when(~F.coalesce(suffixed, F.lit(False)), "not an encrypted file").when(~done, "invalid key or corrupted content").alias("reason"),
    )


def decrypt(df: DataFrame, key: Column, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Opened rows and rejected rows (``reason``). Where both are used, split a written ``opened`` instead to decrypt only once."""
    tried = opened(df, key, content)
    return tried.filter("reason IS NULL").drop("reason"), tried.filter("reason IS NOT NULL").select("path", "reason")


def purge(files: DataFrame, removed: DataFrame) -> DataFrame:
    """Files without the removed paths; write the result as a new table version."""
    return files.join(removed.select("path").distinct(), "path", "left_anti")


def requested(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Files named by a request, with the request's value list."""
    return files.join(requests, "path", "inner")


def apply_cleaned(files: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Cleaned paths drop to severity 0 and are flagged; the other files keep theirs."""
    flags = cleaned.select("path").distinct().withColumn("_c", F.lit(True))
    joined = files.join(flags, "path", "left")
    return (
        joined.withColumn("cleaned", F.coalesce("_c", F.lit(False)))
        .withColumn("severity", F.when(F.col("cleaned"), 0).otherwise(F.col("severity")))
        .drop("_c")
    )


def cleaned_nodes(files: DataFrame, node: Column) -> DataFrame:
    """A node is cleaned when it has files and all of them are; its severity is then 0."""
    grouped = files.groupBy(node.alias("node")).agg(
        F.bool_and("cleaned").alias("cleaned"), F.max("original_severity").alias("severity"), F.count("*").alias("n")
    )
    return grouped.withColumn("severity", F.when(F.col("cleaned"), 0).otherwise(F.col("severity")))


def rename_paths(files: DataFrame, renames: DataFrame) -> DataFrame:
    """Apply old-to-new paths (unique ``old_path``) and recompute names."""
    moved = files.join(renames.withColumnRenamed("old_path", "path"), "path", "left")
    path = F.coalesce("new_path", "path")
    return moved.withColumn("path", path).withColumn("name", view_name(F.col("path"))).drop("new_path")


def final_paths(renames: DataFrame) -> DataFrame:
    """``path`` and ``new_path``: where each first name of a chain of renames ends up.

    ``renames`` has ``old_path``, ``new_path`` and their order ``ord`` (unique). A chain may come back to an earlier name, so renames,
    not names, are followed: each points to the next one that takes its new path away, then every pointer jumps to where its
    target points until none is left. A chain of n renames takes log2(n) joins.
    """
    comes = renames.select(F.col("new_path").alias("p"), "ord", F.lit(None).cast("long").alias("leaves"))
    goes = renames.select(F.col("old_path").alias("p"), "ord", F.col("ord").cast("long").alias("leaves"))
    # Within one name: the first departure after each arrival; a name without earlier arrival begins a chain.
    after = Window.partitionBy("p").orderBy("ord", F.col("leaves").asc_nulls_first()).rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy("p").orderBy("ord", F.col("leaves").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    seen = comes.unionByName(goes).withColumns({"next": F.min("leaves").over(after), "first": F.count("*").over(before) == 0})
    step = seen.filter("leaves IS NULL").select(F.col("ord").cast("long").alias("at"), "next")
    begins = seen.filter("leaves IS NOT NULL AND first").select("p", F.col("leaves").alias("at"))
    hops = materialize(step.select("at", F.coalesce("next", "at").alias("to")))
    while True:
        ahead = hops.select(F.col("at").alias("to"), F.col("to").alias("further"))
        jumped = materialize(hops.join(ahead, "to").select("at", F.col("further").alias("to"), (F.col("to") != F.col("further")).alias("moved")))
        hops = jumped.drop("moved")
        if not jumped.filter("moved").take(1):
            break
    ends = renames.select(F.col("ord").cast("long").alias("to"), "new_path")
    return begins.join(hops, "at").join(ends, "to").select(F.col("p").alias("path"), "new_path")


def follow_renames(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """``rows`` with ``path`` where all ``renames`` lead, in their order, and ``name`` recomputed if there is one.

    Used alike for files and for the set of cleaned paths, so that a cleaned file stays cleaned under its new name.
    """
    moved = rows.join(final_paths(renames), "path", "left").withColumn("path", F.coalesce("new_path", "path")).drop("new_path")
    return moved.withColumn("name", view_name(F.col("path"))) if "name" in rows.columns else moved


def selected_files(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """Distinct files of the selected nodes, a later selection winning, without removed paths.

    ``nodes`` has ``path`` and ``selection_ord`` per file of each selected node.
    """
    rest = [c for c in nodes.columns if c not in ("path", "selection_ord")]
    last = nodes.groupBy("path").agg(F.max_by(F.struct("selection_ord", *rest), "selection_ord").alias("_r"))
    return purge(last.select("path", "_r.*"), removed)


def _event(df: DataFrame, kind: str, source: str, payload: Column) -> DataFrame:
    return df.select(F.lit(f"remediation.{kind}").alias("type"), F.lit(f"remediation.{source}").alias("source"), payload.alias("payload"))


def shred_events(df: DataFrame, path: str = "path") -> DataFrame:
    return _event(df, "shred", "secure_delete", F.to_json(F.struct(F.col(path).alias("file"))))


def encrypt_events(df: DataFrame) -> DataFrame:
    """Each encrypted file reports that the original was shredded and where the sealed file is."""
    sealed = _event(
        df, "encrypt", "encrypt_file", F.to_json(F.struct(F.col("path").alias("file"), F.col("original").alias("original")))
    )
    return shred_events(df, "original").unionByName(sealed)


def redact_events(df: DataFrame) -> DataFrame:
    """File, sorted types and count; never the values."""
    payload = F.to_json(F.struct(F.col("path").alias("file"), "pii_types", "replacements"))
    return _event(df, "redact", "redact_file", payload)


def decrypt_events(df: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct(F.col("encrypted_file"), F.col("path").alias("file")))
    return _event(df, "decrypt", "decrypt_file", payload)
