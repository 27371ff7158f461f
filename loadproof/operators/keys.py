"""Key checks: null parts and duplicates of primary and unique keys, repair, high-water marks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadproof.functions.text import complete_key, render_key


def unique_violations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count; incomplete keys are exempt."""
    return df.where(complete_key(cols)).groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def pk_violations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(problem, key, n): `duplicate` values of a primary key and values with a `null` part."""
    groups = df.groupBy(*cols).agg(F.count("*").alias("n"))
    whole = complete_key(cols)
    return groups.where(~whole | (F.col("n") > 1)).select(F.when(whole, "duplicate").otherwise("null").alias("problem"), render_key(cols).alias("key"), "n")


def dedup_repair(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the first row of each key by all columns in order, and the rest with its rank."""
    order = Window.partitionBy(*cols).orderBy(*[F.col(c).asc_nulls_first() for c in df.columns])
    ranked = df.withColumn("dup_rank", F.row_number().over(order))
    return ranked.where("dup_rank = 1").drop("dup_rank"), ranked.where("dup_rank > 1")


def serial_check(df: DataFrame, col: str, current: DataFrame) -> DataFrame:
    """Whether a serial's current value (one row, column `current`) has reached the largest value loaded."""
    both = df.agg(F.max(col).cast("long").alias("max_value"), F.lit(None).cast("long").alias("current")).unionByName(current.select(F.lit(None).cast("long").alias("max_value"), F.col("current").cast("long")))
    return both.agg(F.max("max_value").alias("max_value"), F.max("current").alias("current")).withColumn("ok", F.coalesce(F.col("current") >= F.col("max_value"), F.col("max_value").isNull()))


def all_key_violations(df: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """(name, key, n): values of several candidate keys of a table that occur more than once, all in one scan by grouping sets.

    keys: columns by the key's name. Incomplete keys are exempt. Each row is expanded to one for each key, which is counted before the shuffle.
    """
    names, cols = list(keys), sorted({c for k in keys.values() for c in k})
    sets = [[F.col(f"`{c}`") for c in keys[name]] for name in names]
    # a column that a set lacks is null in its rows, so the sets are told apart by the number of those that are missing
    out = df.groupingSets(sets, *[F.col(f"`{c}`") for c in cols]).agg(F.count("*").alias("n"), F.grouping_id(*[F.col(f"`{c}`") for c in cols]).alias("_set"))
    missing = lambda name: sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in keys[name])
    if len({missing(n) for n in names}) < len(names):
        raise ValueError("two keys have the same columns")
    label = text = None
    for name in names:
        hit = (F.col("_set") == missing(name)) & complete_key(keys[name])
        label = F.when(hit, name) if label is None else label.when(hit, name)
        text = F.when(hit, render_key(keys[name])) if text is None else text.when(hit, render_key(keys[name]))
    return out.where("n > 1").select(label.alias("name"), text.alias("key"), "n").where("name IS NOT NULL")
