"""Data contracts: coercions, violation counts and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: integers beyond 2^53 cannot be trusted to have come through a double.
EXACT_INT_LIMIT = 2 ** 53


class ContractError(ValueError):
    """A data contract does not hold."""


def exact_int(c: Column) -> Column:
    """Bigint of a finite whole number below 2^53 in size; null otherwise."""
    d = c.try_cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float(EXACT_INT_LIMIT)) & (d == F.floor(d))
    return F.when(ok, d.cast("bigint"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, counted in one pass; a null condition counts as broken."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])


def check_schema(df: DataFrame, expected: Sequence[tuple[str, type]]) -> None:
    """Column order and type class, from the schema alone."""
    got = [(f.name, type(f.dataType)) for f in df.schema.fields]
    if got != list(expected):
        raise ContractError(f"schema is {got}, expected {list(expected)}")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown_keys(df: DataFrame, key: str, authority: DataFrame, authority_key: str) -> DataFrame:
    """Keys outside the authority with their row counts; reduced to distinct keys before the join."""
    seen = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return seen.join(authority.select(F.col(authority_key).alias(key)).distinct(), key, "left_anti")


def with_reason(df: DataFrame, reasons: Sequence[tuple[str, Column]], out: str = "reason") -> DataFrame:
    """First matching reject reason per row, null for good rows. Rows are kept."""
    col = F.lit(None).cast("string")
    for name, cond in reversed(list(reasons)):
        col = F.when(cond, F.lit(name)).otherwise(col)
    return df.withColumn(out, col)


def reason_histogram(df: DataFrame, mass: str | None = None, out: str = "reason", accepted: str = "ACCEPTED") -> DataFrame:
    total = F.sum(mass) if mass else F.count(F.lit(1))
    return df.groupBy(F.coalesce(F.col(out), F.lit(accepted)).alias(out)).agg(total.alias("n"))


def first_numeric_column(df: DataFrame, candidates: Sequence[str], cardinality: int) -> DataFrame:
    """First candidate that is wholly numeric with the expected number of values, from one aggregate."""
    present = [c for c in candidates if c in df.columns]
    stats = df.agg(F.count(F.lit(1)).alias("rows"), *[x for c in present for x in (
        F.count(exact_int(F.col(c))).alias(f"{c}__num"), F.count_distinct(exact_int(F.col(c))).alias(f"{c}__card"))])
    pick = F.lit(None).cast("string")
    for c in reversed(present):
        good = (F.col(f"{c}__num") == F.col("rows")) & (F.col(f"{c}__card") == cardinality)
        pick = F.when(good, F.lit(c)).otherwise(pick)
    return stats.select(pick.alias("column"), "rows")


def gates(facts: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row of named booleans, their conjunction and a status."""
    g = facts.select(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()])
    every = F.lit(True)
    for n in rules:
        every = every & F.col(n)
    return g.withColumn("qualified", every).withColumn("status", F.when(every, "QUALIFIED").otherwise("REJECTED"))


def enforce(gate_row: DataFrame) -> None:
    """Raises when any gate is false: the only action of a gated job besides its writes."""
    row = gate_row.first()
    if row is None or not row["qualified"]:
        failed = [] if row is None else [k for k, v in row.asDict().items() if v is False and k != "qualified"]
        raise ContractError(f"gates failed: {failed}")


INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
