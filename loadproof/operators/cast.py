"""Strict casts with rejects, and domain checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_cast(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): values cast by declared type; a row with a value that doesn't cast is rejected with the columns named."""
    tried = {c: F.col(c).try_cast(t) for c, t in types.items()}
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & v.isNull(), F.concat(F.lit(f"{c}: not a "), F.lit(types[c]))) for c, v in tried.items()]))
    marked = df.withColumn("_bad", bad)
    return marked.where(F.size("_bad") == 0).drop("_bad").withColumns(tried), marked.where(F.size("_bad") > 0).withColumn("reason", F.array_join("_bad", ", ")).drop("_bad")


def not_null(col: str) -> Column:
    return F.when(F.col(col).isNull(), f"{col} is null")


def in_domain(col: str, values: Sequence[str]) -> Column:
    return F.when(F.col(col).isNotNull() & ~F.col(col).isin(*values), f"{col} not in domain")


def fits(col: str, length: int) -> Column:
    return F.when(F.length(F.rtrim(F.col(col))) > length, f"{col} longer than {length}")


def in_precision(col: str, precision: int, scale: int) -> Column:
    return F.when(F.col(col).isNotNull() & F.col(col).try_cast(f"decimal({precision},{scale})").isNull(), f"{col} exceeds decimal({precision},{scale})")


def domain_violations(df: DataFrame, key: Sequence[str], rules: Sequence[Column]) -> DataFrame:
    """One row for each rule that a row breaks: its key and the problem."""
    return df.select(*key, F.explode(F.array_compact(F.array(*rules))).alias("problem"))
