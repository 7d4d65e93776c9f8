"""Path and label expressions: names, extensions, tags, identifiers and size labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.catalog import (
    BROWSER_MARKERS,
    CHAT_EXTENSIONS,
    CHAT_NAME_MARKERS,
    CONFIG_NAME_MARKERS,
    HIGH_RISK_LOCATIONS,
    MEDIUM_RISK_LOCATIONS,
    SEVERITY_LABELS,
    SKIPPED_EXTENSIONS,
    TEXT_EXTENSIONS,
)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; a file directly below the root is in ``/``."""
    return F.when(path.rlike("^/[^/]*$"), "/").otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def without_store(path: Column) -> Column:
    """The path within its file system: scheme and authority removed, so ``hdfs://nn:8020/a`` is ``/a``."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?/+", "/")


def normalized(path: str) -> Column:
    """Absolute path without empty, ``.`` and ``..`` parts; ``path`` is a SQL expression."""
    folded = f"""aggregate(split({path}, '/', -1), cast(array() AS array<string>), (done, p) -> CASE
        WHEN p IN ('', '.') THEN done
        WHEN p = '..' THEN slice(done, 1, greatest(size(done) - 1, 0))
        ELSE concat(done, array(p)) END)"""
    return F.expr(f"concat('/', array_join({folded}, '/'))")


def extension(path: Column) -> Column:
    """Suffix with its dot, lower case; leading dots of a name do not start a suffix."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def view_extension(path: Column) -> Column:
    """Suffix without a dot for the audit view: a leading dot counts, no dot gives ``unknown``."""
    name = view_name(path)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("unknown")


def view_name(path: Column) -> Column:
    """Last path part, splitting on either slash."""
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def _lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a literal map, NULL when absent; refers to ``key`` once."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def is_chat_name(path: Column) -> Column:
    """A text or JSON file whose name holds a chat marker; one pattern over the last path part."""
    markers = "|".join(m.replace(".", r"\.") for m in CHAT_NAME_MARKERS)
    endings = "|".join(e.replace(".", r"\.") for e in CHAT_EXTENSIONS)
    return F.lower(path).rlike(rf"(?s)(?:^|/)(?=[^/]*(?:{markers}))[^/]*(?:{endings})$")


def is_config_name(path: Column) -> Column:
    return F.lower(path).rlike(rf"(?:{'|'.join(CONFIG_NAME_MARKERS)})[^/]*$")


def file_type(path: Column) -> Column:
    by_suffix = {".pdf": "pdf", ".csv": "spreadsheet", ".xlsx": "spreadsheet", ".json": "json"}
    browser = F.when(F.lower(path).rlike("|".join(BROWSER_MARKERS)), "browser_db")
    return F.coalesce(
        F.when(is_chat_name(path), "chat_log"), _lookup(by_suffix, extension(path)), browser, F.lit("text")
    )


def extract_kind(path: Column) -> Column:
    """Which extractor reads the file; NULL for files that none of them supports."""
    by_suffix = {".pdf": "pdf", ".csv": "csv", ".xlsx": "csv", ".json": "json", ".db": "db"}
    return F.coalesce(
        F.when(is_chat_name(path), "chat"),
        _lookup(by_suffix, extension(path)),
        F.when(F.contains(F.lower(path), F.lit("sqlite")), "db"),
        _lookup(dict.fromkeys(TEXT_EXTENSIONS, "text"), extension(path)),
        F.when(is_config_name(path), "text"),
    )


def is_skipped(path: Column) -> Column:
    return extension(path).isin(*SKIPPED_EXTENSIONS)


def location_risk(path: Column) -> Column:
    low = F.lower(path)
    high, medium = (
        "|".join(m.replace(".", r"\.") for m in markers) for markers in (HIGH_RISK_LOCATIONS, MEDIUM_RISK_LOCATIONS)
    )
    return F.when(low.rlike(high), "high").when(low.rlike(medium), "medium").otherwise("low")


def age_days(modified: Column, as_of: Column) -> Column:
    return F.greatest(
        F.lit(0), F.floor((F.unix_micros(as_of) - F.unix_micros(modified)) / F.lit(86_400_000_000)).cast("int")
    )


def stable_id(value: str) -> Column:
    """Node identifier: a 31-polynomial hash over UTF-16 units in 32 bits, base 36.

    ``value`` is a SQL expression; empty and NULL hash as ``unknown``.
    """
    wrap = "4294967295"
    step = (
        f"if(c < 65536, (h * 31 + c) & {wrap}, "
        f"((((h * 31 + 55296 + (c - 65536) div 1024) & {wrap}) * 31) + 56320 + (c - 65536) % 1024) & {wrap})"
    )
    units = (
        f"transform(regexp_extract_all(coalesce(nullif({value}, ''), 'unknown'), '(?s).', 0), "
        "ch -> bigint(ascii(ch)))"
    )
    folded = f"aggregate({units}, 0L, (h, c) -> {step}, h -> abs(if(h >= 2147483648, h - 4294967296, h)))"
    return F.expr(f"concat('node-', lower(conv(string({folded}), 10, 36)))")


def format_bytes(size: Column) -> Column:
    """1024-based label: whole numbers from 10 up and for bytes, one decimal otherwise."""
    number = size.cast("double")
    unit = F.when(number < 1024, 0).when(number < 1024**2, 1).when(number < 1024**3, 2).otherwise(3)
    value = number / F.pow(F.lit(1024.0), unit)
    name = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), unit + 1)
    whole = F.floor(value + 0.5).cast("string")
    tenths = F.floor(value * 10 + 0.5)
    one = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    label = F.concat(F.when((value >= 10) | (unit == 0), whole).otherwise(one), F.lit(" "), name)
    return F.when(number > 0, label).otherwise("0 B")


def severity_label(severity: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in SEVERITY_LABELS]), severity)
