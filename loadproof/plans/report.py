"""Summaries: inventories, the verdict, paired runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory_counts(items: DataFrame, kinds: Sequence[str], by: str = "table") -> DataFrame:
    """Items (by, kind) counted for each kind, one column a kind; kinds given, so no extra pass finds them."""
    return items.groupBy(by).agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds])


def verdict(tables: DataFrame, records: DataFrame) -> DataFrame:
    """Each table `done`, `pending` or `skipped`, with a note for stale statistics.

    records: (table, kind) with kinds pending_key, withheld_fk, violated_fk, failed_index, stale_stats, skipped.
    """
    has = lambda *kinds: F.coalesce(F.bool_or(F.col("kind").isin(*kinds)), F.lit(False))
    marks = tables.select("table").distinct().join(records, "table", "left").groupBy("table").agg(
        has("skipped").alias("skipped"), has("pending_key", "withheld_fk", "violated_fk", "failed_index").alias("pending"), has("stale_stats").alias("stale_stats")
    )
    return marks.select("table", F.when(F.col("skipped"), "skipped").when(F.col("pending"), "pending").otherwise("done").alias("state"), "stale_stats")


def roll_up(verdicts: DataFrame) -> DataFrame:
    """One row: tables by state, and COMPLETE only if nothing is pending and no statistics are stale."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    stale = F.count(F.when(F.col("stale_stats"), 1))
    return verdicts.agg(n("done").alias("done"), n("pending").alias("pending"), n("skipped").alias("skipped"), stale.alias("stale"), F.when((n("pending") == 0) & (stale == 0), "COMPLETE").otherwise("PARTIAL").alias("verdict"))


def paired_ratio(pairs: DataFrame, by: str, guard: float) -> DataFrame:
    """For each degree the median, least and largest of the pairs' own ratios tool / other, and whether the guard holds."""
    r = pairs.where(F.col("other") > 0).withColumn("r", F.col("tool") / F.col("other")).groupBy(by).agg(F.count("*").alias("pairs"), F.percentile("r", F.lit(0.5)).alias("m"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    return r.select(by, "pairs", F.round("m", 6).alias("median_ratio"), F.round("lo", 6).alias("min_ratio"), F.round("hi", 6).alias("max_ratio"), F.round(F.col("hi") - F.col("lo"), 6).alias("spread"), (F.col("m") <= guard).alias("ok"))
