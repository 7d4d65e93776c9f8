"""Tables as text: rows of structured tables rendered for detection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.catalog import TABLE_ROWS
from riskloom.operators.ordering import running_totals

#: Bytes that a block of rows holds at most, unless a single row is longer.
BLOCK_BYTES = 1 << 20


def _line(columns: Sequence[str]) -> Column:
    """A row as text: its values in brackets, ``NULL`` for missing ones."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns]
    return F.concat(F.lit("("), F.concat_ws(", ", *shown), F.lit(")"))


def table_as_text(df: DataFrame, name: str, key: str, rows: int = TABLE_ROWS, chars: int | None = None) -> DataFrame:
    """``table_name, block, content``: the rows of each key range of ``rows`` as one text.

    ``key`` is a dense integer key. Every row lands in exactly one block of bounded size; block 0 is
    what a preview of the first rows shows.
    """
    line = _line(df.columns)
    grouped = df.groupBy(F.floor(F.col(key) / rows).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line")))).alias("m"),
        F.count("*").alias("row_count"),
    )
    body = "concat('[', array_join(m.line, ', '), ']')"
    body = body if chars is None else f"left({body}, {chars})"
    head = F.lit(f"\n--- {name} ---\n")
    return grouped.select(F.lit(name).alias("table_name"), "block", "row_count", F.concat(head, F.expr(body)).alias("content"))


def tables_as_text(
    tables: Mapping[str, tuple[DataFrame | None, str]], rows: int = TABLE_ROWS, chars: int | None = None
) -> DataFrame:
    """Several named tables; a missing one (``None``) is skipped."""
    dumps = [table_as_text(df, name, key, rows, chars) for name, (df, key) in tables.items() if df is not None]
    return reduce(DataFrame.unionByName, dumps)


def table_blocks(
    df: DataFrame, name: str, order: Sequence[str], rows: int = TABLE_ROWS, size: int = BLOCK_BYTES, parts: int | None = None
) -> DataFrame:
    """``table_name, first_row, row_count, size, content``: all rows in ``order`` as texts of at most ``rows`` rows and ``size`` bytes.

    Blocks are cut at running totals of bytes and rows, not at key values, so null, repeated and sparse keys change nothing, and a key
    that many rows share spreads over tasks and blocks. Laid end to end, the rows cover cells of ``size`` bytes: the rows inside a
    cell form a block, and the one row that crosses into the next cell stands alone, as does a row longer than a cell. Rows of equal keys
    are ordered by their text, so reruns agree. ``first_row`` counts from 1; ``size`` is that of the block's body. An empty table has no block.
    """
    keys = [f"_key{i}" for i in range(len(order))]
    lined = df.select(*[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], _line(df.columns).alias("_line"))
    length = F.octet_length("_line") + 2
    placed = running_totals(lined, [*keys, "_line"], {"_row": F.lit(1), "_stop": length}, parts)
    cells = [F.floor((F.col("_stop") - length) / size), F.floor((F.col("_stop") - 1) / size), F.floor((F.col("_row") - 1) / rows)]
    grouped = placed.groupBy(*[c.alias(f"_cell{i}") for i, c in enumerate(cells)]).agg(
        F.min("_row").alias("first_row"),
        F.count("*").alias("row_count"),
        F.sum(length).alias("size"),
        F.array_sort(F.collect_list(F.struct("_row", "_line"))).alias("m"),
    )
    body = F.concat(F.lit(f"\n--- {name} ---\n["), F.expr("array_join(m._line, ', ')"), F.lit("]"))
    return grouped.select(F.lit(name).alias("table_name"), "first_row", "row_count", "size", body.alias("content"))
