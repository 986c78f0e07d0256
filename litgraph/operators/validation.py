"""Row-level checks: each gives the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(rows: DataFrame, key: str, required: list[str], any_of: list[str] = ()) -> DataFrame:
    """A row for each required column that is null, and one where all of ``any_of`` are."""
    broken = [F.when(F.col(c).isNull(), F.lit(c)) for c in required]
    if any_of:
        broken.append(F.when(F.coalesce(*[F.col(c).cast("string") for c in any_of]).isNull(), F.lit("|".join(any_of))))
    return rows.select(F.col(key).alias("id"), F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def outside(rows: DataFrame, key: str, column: str, lo: float, hi: float) -> DataFrame:
    return rows.where(~F.col(column).between(lo, hi)).select(F.col(key).alias("id"), F.lit(f"{column} outside").alias("rule"))


def not_in(rows: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).select(F.col(key).alias("id"), F.col(column).alias("value"))


def without(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows with no partner."""
    return rows.join(others.select(*on).distinct(), on, "left_anti")


def cardinality(rows: DataFrame, key: str, column: str, lo: int, hi: int) -> DataFrame:
    """Keys with fewer or more distinct values than allowed."""
    return rows.groupBy(F.col(key).alias("id")).agg(F.countDistinct(column).alias("n")).where(~F.col("n").between(lo, hi))


def repeated(rows: DataFrame, on: list[str]) -> DataFrame:
    return rows.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")
