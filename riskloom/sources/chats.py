"""Chat exports: message tables, JSON exports and plain-text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.catalog import CHAT_HEADER, CHAT_MESSAGES, CHAT_SAMPLE
from riskloom.functions.matching import quoted
from riskloom.functions.paths import extension

SPACE_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def stripped(text: str) -> str:
    """SQL: text without white space at either end."""
    return f"regexp_replace({text}, {quoted(SPACE_ENDS)}, '')"


def message_lines(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, sender, line`` for every message with text: no grouping, no order needed."""
    sender = F.coalesce(F.nullif("from", F.lit("")), F.nullif("from_id", F.lit("")), F.lit("unknown"))
    line = F.concat(F.coalesce("date", F.lit("")), F.lit(" "), sender, F.lit(": "), "text")
    return messages.filter(F.expr(f"{stripped('text')} <> ''")).select(
        "conv_id", "turn", sender.alias("sender"), line.alias("line")
    )


def chat_metadata(lines: DataFrame, sample: int = CHAT_SAMPLE) -> DataFrame:
    """Message and participant counts and the first participants by name, over whole chats.

    Messages are counted per sender first, so a chat with very many messages is combined before the
    shuffle. The sample is a ranked top list: only ``sample`` names of a chat are ever collected.
    """
    per_sender = lines.groupBy("conv_id", "sender").agg(F.count("*").alias("n"))
    counts = per_sender.groupBy("conv_id").agg(
        F.sum("n").alias("message_count"), F.count("*").alias("participant_count")
    )
    by_name = Window.partitionBy("conv_id").orderBy("sender")
    first = per_sender.select("conv_id", "sender", F.row_number().over(by_name).alias("rn")).filter(F.col("rn") <= sample)
    names = first.groupBy("conv_id").agg(F.array_sort(F.collect_list("sender")).alias("participants_sample"))
    return counts.join(names, "conv_id")


def chat_documents(lines: DataFrame, part_size: int = CHAT_MESSAGES) -> DataFrame:
    """Searchable text of each chat in parts of ``part_size`` turns.

    Part 0 is what an interactive parser shows; the later parts hold the rest, so nothing is dropped
    and no group grows with the chat.
    """
    part = F.floor(F.col("turn") / part_size).alias("part")
    grouped = lines.groupBy("conv_id", part).agg(
        F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("m"), F.count("*").alias("messages")
    )
    return grouped.select("conv_id", "part", "messages", F.expr("array_join(m.line, '\n')").alias("content"))


def _limit(array: str, n: int | None) -> str:
    return array if n is None else f"slice({array}, 1, {n})"


def _json_messages(parsed: str, limit: int | None) -> str:
    """SQL: ``array<struct<sender,line>>`` of a JSON export, an object with ``messages`` or a bare list.

    Text may be a list of parts; messages without text and entries that are no objects are skipped.
    """
    listed = f"""coalesce(try_variant_get({parsed}, '$.messages', 'array<variant>'),
        try_variant_get({parsed}, '$', 'array<variant>'), cast(array() AS array<variant>))"""
    part = """coalesce(if(startswith(schema_of_variant(p), 'OBJECT'),
        coalesce(try_variant_get(p, '$.text', 'string'), ''), try_variant_get(p, '$', 'string')), '')"""
    text = f"""if(startswith(schema_of_variant(m), 'OBJECT'),
        coalesce(if(startswith(coalesce(schema_of_variant(try_variant_get(m, '$.text', 'variant')), ''), 'ARRAY'),
            array_join(transform(try_variant_get(m, '$.text', 'array<variant>'), p -> {part}), ''),
            try_variant_get(m, '$.text', 'string')), ''), '')"""
    sender = """coalesce(nullif(try_variant_get(m, '$.from', 'string'), ''),
        nullif(try_variant_get(m, '$.from_id', 'string'), ''), 'unknown')"""
    rows = f"""transform({_limit(listed, limit)}, m -> named_struct(
        'sender', {sender}, 'text', {text}, 'date', coalesce(try_variant_get(m, '$.date', 'string'), '')))"""
    return f"""transform(filter({rows}, m -> {stripped('m.text')} <> ''),
        m -> named_struct('sender', m.sender, 'line', concat(m.date, ' ', m.sender, ': ', m.text)))"""


def _text_messages() -> str:
    """SQL: the same of a plain-text export, from its lines ``_l`` and the positions ``_h`` of header lines.

    Header lines start messages, other lines continue the one before; each message is one slice.
    """
    header = quoted("(?U)" + CHAT_HEADER)

    def group(number: int) -> str:
        return stripped(f"regexp_extract(_l[p], {header}, {number})")

    tail = """array_join(transform(filter(
        slice(_l, p + 2, coalesce(get(_h, k + 1), size(_l)) - p - 1), l -> l <> ''), l -> concat(' ', l)), '')"""
    return f"""transform(_h, (p, k) -> named_struct(
        'sender', {group(1)}, 'line', concat({group(1)}, ': ', {group(2)}, {tail})))"""


def _json_fault(parsed: str) -> str:
    """SQL: why a JSON export holds no list of messages; NULL where it does. A missing list and one that is a text are empty."""
    listed = f"""coalesce(schema_of_variant(if(schema_of_variant({parsed}) LIKE 'OBJECT%',
        try_variant_get({parsed}, '$.messages', 'variant'), {parsed})), 'ARRAY')"""
    return f"""CASE WHEN content IS NULL OR {parsed} IS NULL THEN 'not JSON'
        WHEN {listed} LIKE 'ARRAY%' OR {listed} = 'STRING' THEN NULL ELSE 'no list of messages' END"""


def with_messages(
    files: DataFrame, is_chat: Column, messages: int | None = None, raw_chars: int | None = None
) -> DataFrame:
    """Add ``_m``, the messages of each chat file (NULL for other files), in one pass over the files.

    JSON and plain-text exports are told apart by extension. Everything happens inside the file's
    row, so chats need neither a scan of their own nor a shuffle. Also adds ``_chat`` (the platform),
    ``_raw`` (what stands for the content of a chat without any message) and ``_fault`` (why a JSON export has none).
    """
    platform = F.when(is_chat & (extension(F.col("path")) == ".json"), "telegram").when(is_chat, "whatsapp")
    raw = "content" if raw_chars is None else f"left(content, {raw_chars})"
    header = quoted("(?U)" + CHAT_HEADER)
    steps = (
        ("_v", "if(_chat = 'telegram', try_parse_json(content), NULL)"),
        ("_fault", f"if(_chat = 'telegram', {_json_fault('_v')}, NULL)"),
        ("_raw", f"CASE _chat WHEN 'whatsapp' THEN {raw} WHEN 'telegram' THEN '' END"),
        ("_l", f"if(_chat = 'whatsapp', transform(split(_raw, {quoted(LINE_BREAK)}, -1), l -> {stripped('l')}), NULL)"),
        ("_h", f"filter(transform(_l, (l, i) -> if(l RLIKE {header}, i, -1)), i -> i >= 0)"),
        ("_m", f"CASE _chat WHEN 'telegram' THEN {_json_messages('_v', messages)} WHEN 'whatsapp' THEN {_text_messages()} END"),
    )
    df = files.withColumn("_chat", platform)
    for name, step in steps:
        df = df.withColumn(name, F.expr(step))
    return df.drop("_v", "_l", "_h")


CHAT_COLUMNS = ("chat_platform", "chat_message_count", "chat_participant_count", "chat_participants_sample", "chat_parse_error")


def chat_columns() -> list[Column]:
    """Metadata columns from the result of ``with_messages``; NULL for other files.

    An export that does not parse has its platform and ``chat_parse_error``, and no counts.
    """
    counted = "_chat IS NOT NULL AND _fault IS NULL"
    senders = "array_sort(array_distinct(_m.sender))"
    return [
        F.col("_chat").alias("chat_platform"),
        F.expr(f"if({counted}, size(_m), NULL)").alias("chat_message_count"),
        F.expr(f"if({counted}, size({senders}), NULL)").alias("chat_participant_count"),
        F.expr(f"if({counted}, slice({senders}, 1, {CHAT_SAMPLE}), NULL)").alias("chat_participants_sample"),
        F.col("_fault").alias("chat_parse_error"),
    ]


CHAT_CONTENT = "if(size(_m) > 0, array_join(_m.line, '\n'), _raw)"


def parse_chat_files(
    files: DataFrame, messages: int | None = None, raw_chars: int | None = None, chars: int | None = None
) -> DataFrame:
    """Content and metadata of files that are all chat exports."""
    parsed = with_messages(files, F.lit(True), messages, raw_chars)
    content = CHAT_CONTENT if chars is None else f"left({CHAT_CONTENT}, {chars})"
    rest = [c for c in files.columns if c != "content"]
    return parsed.select(*rest, F.expr(content).alias("content"), *chat_columns())
