"""What the training-data operators share: word expressions, scratch tables, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import scratch_dir

#: The six ASCII white-space characters that end a word, as a class of a regular expression.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: The same characters as text.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a table of narrow rows counts as small enough to be broadcast.
BROADCAST_ROWS = 500_000


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, separators: str = SPACE_RUN) -> Column:
    return F.array_remove(F.split(text, separators), "")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it and survive lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table, with a broadcast hint if it has at most ``rows`` rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named ``own0``, ``own1``, ... and the new name of each: nothing that an operator adds clashes with them."""
    names = [f"own{k}" for k in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def unshielded(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, under their names, from a frame that ``shielded`` made."""
    return df.select([f"own{k}" for k in range(len(like.columns))]).toDF(*like.columns)
