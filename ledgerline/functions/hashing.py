"""Stable hash buckets and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key prefixes and the decile rule of the card split.
GROUP_PREFIX, SPLIT_PREFIX = "group:", "split:"
SPLIT_DECILES = {"validation": [0], "test": [1, 2]}


def hex_number(text: Column, hex_digits: int = 15, bits: int = 256) -> Column:
    """Leading hex digits of a digest as a bigint (15 digits always fit)."""
    digest = F.sha1(text) if bits == 160 else F.sha2(text, bits)
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")


def bucket(text: Column, n: int, hex_digits: int = 8, bits: int = 256) -> Column:
    return F.pmod(hex_number(text, hex_digits, bits), F.lit(n)).cast("int")


def unit_interval(text: Column) -> Column:
    """Deterministic uniform number in [0, 1) from 13 hex digits."""
    return hex_number(text, 13).cast("double") / F.lit(float(16 ** 13))


def group_token(key: Column) -> Column:
    return F.sha2(F.concat(F.lit(GROUP_PREFIX), key), 256)


def split_name(token: Column) -> Column:
    x = bucket(F.concat(F.lit(SPLIT_PREFIX), token), 10)
    out = None
    for name, deciles in SPLIT_DECILES.items():
        cond = x.isin(deciles)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("train")


def stable_id(*parts: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256))
