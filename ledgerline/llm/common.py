"""Pieces shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A chunk of ordered work: large enough to be worth a task, small enough to sort in memory.
ROWS_PER_CHUNK = 100_000
#: Order numbers are the first 15 hex digits of a digest, 60 bits.
ORDER_BITS = 60


def text_of(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_order(column: Column) -> Column:
    """A repeatable random order number in [0, 2**60)."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, ORDER_BITS // 4), 16, 10).cast("long")


def order_chunk(order: str, rows: int, per_chunk: int = ROWS_PER_CHUNK) -> Column:
    """Chunk of an order number, monotone in it; the number of chunks follows the number of rows."""
    chunks = max(1, -(-rows // per_chunk))
    return F.floor(F.col(order) / F.lit(float(2**ORDER_BITS / chunks))).cast("long")


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, found {df.columns}")


def single(rows: list, what: str):
    if len(rows) != 1:
        raise ValueError(f"{what}: expected one row, found {len(rows)}")
    return rows[0]
