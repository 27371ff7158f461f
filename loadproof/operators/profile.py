"""Column statistics, partition counts, largest tables, emptiness probes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of which one task of an exact profile keeps the distinct values.
TASK_ROWS = 250_000


def profile(df: DataFrame, name: str, fraction: float | None = None, exact: bool = False) -> DataFrame:
    """(table, column, n, nulls, low, high, distinct_values) for each column, in one aggregation.

    fraction: of the rows to sample. exact: distinct values counted rather than estimated; rows are dealt evenly first, as a
    split of a file that packs well holds any number of them, and a task keeps all distinct values of its rows.
    """
    rows = df.sample(fraction, seed=1) if fraction else df
    distinct = F.countDistinct if exact else F.approx_count_distinct
    cols = rows.columns
    if exact and cols:
        rows = rows.repartition(rows.count() // TASK_ROWS + 1, F.xxhash64(*[F.col(f"`{c}`") for c in cols]))
    one = rows.agg(
        F.count("*").alias("n"),
        *[x for i, c in enumerate(cols) for x in (F.count(F.when(F.col(c).isNull(), 1)).alias(f"u{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}"), distinct(c).alias(f"d{i}"))],
    )
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"u{i}").alias("nulls"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(cols)]))
    return one.select(F.lit(name).alias("table"), "n", stacked.alias("s")).select("table", "s.column", "n", "s.nulls", "s.low", "s.high", "s.distinct_values")


def profile_all(tables: Mapping[str, DataFrame], spark, fraction: float | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Statistics of all tables; a table that fails is recorded with its reason and the others go on."""
    done, failed = [], []
    for name, df in tables.items():
        try:
            one = profile(df, name, fraction)
            one.schema  # noqa: B018 - analysis fails here for a broken table
            done.append(one)
        except Exception as error:  # noqa: BLE001
            failed.append((name, str(error).splitlines()[0]))
    schema = "table string, column string, n long, nulls long, low string, high string, distinct_values long"
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], schema), failed


def partition_counts(df: DataFrame, part: str, declared: DataFrame) -> DataFrame:
    """Rows of each declared partition, 0 included, and whether it is populated."""
    counts = df.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n"))
    return declared.select("part").join(counts, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("populated"))


def largest(counts: DataFrame, k: int) -> DataFrame:
    """The k largest tables; ties by name."""
    return counts.orderBy(F.desc("n"), "table").limit(k)


def name_order(named: DataFrame, col: str) -> DataFrame:
    """The rows of a catalog's size with their place by name, `order`, from 1; what lists them first has no say. One task orders them."""
    return named.withColumn("order", F.row_number().over(Window.orderBy(col)).cast("long"))


def empty_probe(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, is_empty); each probe ends at its first row."""
    return reduce(DataFrame.unionByName, (df.limit(1).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), (F.col("n") == 0).alias("is_empty")) for name, df in tables.items()))


def ranges(col: str, bounds: Sequence[tuple[str, object]], rest: str):
    """A range ladder: the first bound that the value is below names its partition."""
    out = None
    for name, top in bounds:
        out = F.when(F.col(col) < F.lit(top), name) if out is None else out.when(F.col(col) < F.lit(top), name)
    return out.otherwise(rest)
