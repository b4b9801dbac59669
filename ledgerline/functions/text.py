"""String cleaning and parsing as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BOM = "﻿"

# Kilometres per mile, and the bare speed above which km/h is assumed.
KM_PER_MILE = 1.609344
BARE_MPH_LIMIT = 75.0

# Words that carry no meaning in a stop's name, and spellings that mean the same; more are arguments.
NAME_STOP_WORDS = ("station", "terminal", "line")
NAME_SPELLINGS = {"&": "and"}

# Fixed value: a fare token is "<line number>号线<station name>".
LINE_TOKEN = r"^(\d+)号线(.+)$"


def clean(c: Column) -> Column:
    """Trim and drop byte-order marks."""
    return F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit(BOM), F.lit("")))


def norm_id(c: Column) -> Column:
    """Identifier text: trimmed, a trailing ``.0`` of a float-typed id dropped, null as empty."""
    return F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"^(\d+)\.0$", "$1")


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^0-9]", "")


def code4(c: Column) -> Column:
    """Four-digit code: digits only, zero-padded on the left, the last four when longer."""
    d = digits(c)
    return (F.when(d == "", F.lit("")).when(F.length(d) <= 4, F.lpad(d, 4, "0")).otherwise(F.right(d, F.lit(4))))


def normalized_name(c: Column, spellings: Mapping[str, str] = NAME_SPELLINGS, stop_words: Sequence[str] = NAME_STOP_WORDS) -> Column:
    """Comparison key of a name: small letters and digits, without remarks in brackets and stop words."""
    x = F.lower(c.cast("string"))
    for old, new in spellings.items():
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.regexp_replace(x, r"\([^)]*\)", " ")
    if stop_words:
        x = F.regexp_replace(x, rf"\b({'|'.join(stop_words)})\b", " ")
    return F.regexp_replace(x, r"[^a-z0-9]+", "")


def line_station(c: Column) -> Column:
    """Struct (line, station, token) of a fare token, null when it does not parse."""
    token = clean(c)
    line = F.regexp_extract(token, LINE_TOKEN, 1)
    padded = F.when(F.length(line) < 2, F.lpad(line, 2, "0")).otherwise(line)
    return F.when(token.rlike(LINE_TOKEN), F.struct(
        padded.alias("line"), F.trim(F.regexp_extract(token, LINE_TOKEN, 2)).alias("station"), token.alias("token")))


def pipe_ints(c: Column) -> Column:
    """Sorted distinct integers of a ``|`` list; items that are no integers are ignored."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x).try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))


def chevron(c: Column) -> Column:
    """Elements of an ``a>b>c`` chain; an empty chain has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), ">"), lambda x: x != "")


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def speed_mph(c: Column) -> Column:
    """First number as miles per hour; km/h when said so, or when implausibly high and unmarked."""
    v, s = first_number(c), F.lower(c.cast("string"))
    metric = s.contains("km") | (~s.contains("mph") & (v > BARE_MPH_LIMIT))
    return F.when(metric, v / KM_PER_MILE).otherwise(v)


def trim_decimal(c: Column) -> Column:
    """Plain text of a decimal without trailing zeros."""
    s = c.cast("string")
    return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
