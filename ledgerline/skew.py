"""Ordered operators that survive a hot key.

A plain window puts every row of a key in one task. Each function here splits
the key's rows into ordered *chunks* (a time span or a value span), works inside
``(keys, chunk)`` and then carries one row per chunk across chunk borders. The
carried table has as many rows per key as the key has chunks, whatever the
number of rows, so the only unsplit step is bounded by the chunk width.

Cost of one call, however many columns it adds: the rows are shuffled once by
(keys, chunk); a second, column-pruned read is combined map-side to one row per
key and chunk. Put everything a step needs into one call.

``chunk`` must not decrease along the order: all rows of a lower chunk come
before all rows of a higher one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_CHUNK = "__chunk"


def span(col: str | Column, width: float) -> Column:
    """Chunk number of a numeric column: monotone, exact for any positive width."""
    return F.floor((F.col(col) if isinstance(col, str) else col) / F.lit(width))


def null_safe(keys: Sequence[str], prefix: str) -> Column:
    """Equality on keys against the prefixed columns of the other side, nulls matching."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return cond


def prefixed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], *[c for c in df.columns if c not in keys])


def _join_carry(local: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [*keys, _CHUNK]
    right = prefixed(carry, names, "__r_")
    return local.join(right, null_safe(names, "__r_"), "left").drop(*[f"__r_{n}" for n in names])


def _add(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


_FOLD = {"sum": (F.sum, _add), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None,
            near: dict[str, tuple[Sequence[str], bool]] | None = None,
            known: dict[str, tuple[str, bool, bool]] | None = None,
            folds: dict[str, tuple[str, str, bool]] | None = None,
            totals: dict[str, tuple[str, str]] | None = None,
            local: Callable[[DataFrame, WindowSpec], DataFrame] | None = None) -> DataFrame:
    """All ordered columns of one step in one pass.

    ``near``    out -> (fields, following): struct of the previous (or next) row.
    ``known``   out -> (value, following, strict): latest non-null value at or before the row (or after it).
    ``folds``   out -> (sum|max|min, column, suffix): running aggregate, inclusive of the row.
    ``totals``  out -> (sum|max|min, column): aggregate of the whole key.
    ``local``   adds columns from the window of the row's own chunk first; only for facts that
                never cross a chunk border, such as equal timestamps.

    ``order`` must be a total order within the key. ``chunk`` may be None only where a key
    is short by its nature, such as the stops of one trip: then nothing has to be carried.
    """
    near, known, folds, totals = near or {}, known or {}, folds or {}, totals or {}
    bounded = chunk is None
    part = keys if bounded else [*keys, _CHUNK]
    base = Window.partitionBy(*part).orderBy(*order)
    rank = F.struct(*order)
    d = df if bounded else df.withColumn(_CHUNK, chunk)
    if local is not None:
        d = local(d, base)
    cols, edges, cw = {}, [], Window.partitionBy(*keys).orderBy(_CHUNK)
    # what lies ahead is read as a running window of the reversed order: a frame that ends at the
    # last row of its partition is computed anew for every row
    back, ahead = cw.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy(F.desc(_CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    turned = Window.partitionBy(*part).orderBy(*[F.desc(o) for o in order])
    carried, final = [], {}
    for out, (fields, following) in near.items():
        payload = F.struct(*fields)
        cols[f"__l_{out}"] = (F.lead if following else F.lag)(payload).over(base)
        edges.append((F.min_by if following else F.max_by)(payload, rank).alias(f"__e_{out}"))
        carried.append((F.lead if following else F.lag)(F.col(f"__e_{out}")).over(cw).alias(f"__c_{out}"))
        final[out] = F.coalesce(f"__l_{out}", f"__c_{out}")
    for out, (value, following, strict) in known.items():
        frame = (turned if following else base).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
        cols[f"__l_{out}"] = F.last(value, ignorenulls=True).over(frame)
        seen = F.when(F.col(value).isNotNull(), rank)
        edges.append((F.min_by if following else F.max_by)(F.col(value), seen).alias(f"__e_{out}"))
        carried.append(F.last(f"__e_{out}", ignorenulls=True).over(ahead if following else back).alias(f"__c_{out}"))
        final[out] = F.coalesce(f"__l_{out}", f"__c_{out}")
    for out, (kind, value, suffix) in folds.items():
        agg, merge = _FOLD[kind]
        cols[f"__l_{out}"] = agg(value).over((turned if suffix else base).rowsBetween(Window.unboundedPreceding, 0))
        edges.append(agg(value).alias(f"__e_{out}"))
        carried.append(agg(f"__e_{out}").over(ahead if suffix else back).alias(f"__c_{out}"))
        final[out] = merge(F.col(f"__l_{out}"), F.col(f"__c_{out}"))
    for out, (kind, value) in totals.items():
        agg = _FOLD[kind][0]
        edges.append(agg(value).alias(f"__e_{out}"))
        carried.append(agg(f"__e_{out}").over(Window.partitionBy(*keys)).alias(out))
    if bounded:
        whole = {out: _FOLD[kind][0](value).over(Window.partitionBy(*keys)) for out, (kind, value) in totals.items()}
        return d.withColumns({**{o: cols[f"__l_{o}"] for o in final}, **whole})
    carry = d.groupBy(*keys, _CHUNK).agg(*edges).select(*keys, _CHUNK, *carried)
    joined = _join_carry(d.withColumns(cols) if cols else d, carry, keys)
    return joined.withColumns(final).drop(_CHUNK, *[f"__{p}_{o}" for o in final for p in "lc"])


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None,
              fields: Sequence[str], out: str, following: bool = False) -> DataFrame:
    """Adds ``out``: a struct of ``fields`` from the previous (or next) row of the key."""
    return chunked(df, keys, order, chunk, near={out: (fields, following)})


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None,
               value: str, out: str, following: bool = False, strict: bool = False) -> DataFrame:
    """Adds ``out``: the latest non-null ``value`` at or before the row (or after it)."""
    return chunked(df, keys, order, chunk, known={out: (value, following, strict)})


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None,
            folds: dict[str, tuple[str, str]], suffix: bool = False, totals: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Adds running aggregates, inclusive of the row: ``{out: ("sum"|"max"|"min", column)}``."""
    return chunked(df, keys, order, chunk, folds={o: (k, c, suffix) for o, (k, c) in folds.items()}, totals=totals)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None, fields: Sequence[str],
            joins: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """Numbers the runs of consecutive rows that join their predecessor.

    ``joins(previous, current)`` gets two structs of ``fields``. Borders inside a chunk
    are counted locally; the border between two chunks is judged on the carried last
    row of the one and first row of the other.
    """
    rank, cur = F.struct(*order), F.struct(*fields)
    brk = lambda prev, this: F.when(F.coalesce(joins(prev, this), F.lit(False)), 0).otherwise(1).cast("bigint")
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        d = df.withColumns({"__cur": cur, "__prev": F.lag(cur).over(w)})
        d = d.withColumn("__brk", F.when(F.col("__prev").isNull(), F.lit(1).cast("bigint")).otherwise(brk(F.col("__prev"), F.col("__cur"))))
        return d.withColumn(out, F.sum("__brk").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__cur", "__prev", "__brk")
    base = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    d = df.withColumn(_CHUNK, chunk).withColumns({"__cur": cur, "__prev": F.lag(cur).over(base)})
    d = d.withColumn("__brk", F.when(F.col("__prev").isNull(), F.lit(0).cast("bigint")).otherwise(brk(F.col("__prev"), F.col("__cur"))))
    edges = d.groupBy(*keys, _CHUNK).agg(F.min_by("__cur", rank).alias("__head"), F.max_by("__cur", rank).alias("__tail"), F.sum("__brk").alias("__n"))
    cw = Window.partitionBy(*keys).orderBy(_CHUNK)
    edges = edges.withColumn("__before", F.lag("__tail").over(cw))
    edges = edges.withColumn("__first", F.when(F.col("__before").isNull(), F.lit(1).cast("bigint")).otherwise(brk(F.col("__before"), F.col("__head"))))
    carry = edges.select(*keys, _CHUNK, (F.coalesce(F.sum(F.col("__first") + F.col("__n")).over(cw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
                                         + F.col("__first")).alias("__offset"))
    local = d.withColumn("__seen", F.sum("__brk").over(base.rowsBetween(Window.unboundedPreceding, 0)))
    return _join_carry(local, carry, keys).withColumn(out, F.col("__offset") + F.col("__seen")).drop(
        "__cur", "__prev", "__brk", "__seen", "__offset", _CHUNK)


def halo(df: DataFrame, position: str, reach: int, width: int) -> DataFrame:
    """Copies each row into every chunk whose widened span holds it.

    Windows of at most ``reach`` positions to either side can then run inside
    ``__chunk`` alone; keep the rows with ``__owner`` afterwards. ``position`` is an
    integer column, ``width >= reach`` keeps the copies to at most three per row.
    """
    if width < reach:
        raise ValueError("chunk width must be at least the window reach")
    lo = F.floor((F.col(position) - reach) / F.lit(width))
    hi = F.floor((F.col(position) + reach) / F.lit(width))
    return (df.withColumn(_CHUNK, F.explode(F.sequence(lo, hi)))
              .withColumn("__owner", F.col(_CHUNK) == F.floor(F.col(position) / F.lit(width))))


def owned(df: DataFrame) -> DataFrame:
    return df.where("__owner").drop("__owner", _CHUNK)


def attach(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Group aggregates joined back on every row.

    Replaces an unordered window: the aggregate is combined map-side and the join
    of a hot key is split by adaptive execution, where a window would be one task.
    """
    g = df.groupBy(*[F.col(k).alias(f"__g_{k}") for k in keys]).agg(*aggs)
    return df.join(g, null_safe(keys, "__g_"), "left").drop(*[f"__g_{k}" for k in keys])
