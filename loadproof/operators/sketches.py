"""Statistics that merge: each published version keeps its own, and a new load adds its own alone.

A column's record holds exact counts and bounds and two sketches, of distinct values (HLL) and of quantiles (KLL). Records of
versions merge to those of all their rows, without reading a row again. The estimate of distinct values has a relative standard error of
1.04 / sqrt(2 ** LG_K), 0.8 %; a quantile's rank is within 1.7 % at KLL_K = 200, with 99 % confidence.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LG_K, KLL_K = 14, 200
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LG_K / 2), 0.017

STATISTICS = "table string, version string, column string, n long, nulls long, low string, high string, hll binary, kll binary"


def version_statistics(df: DataFrame, table: str, version: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A record for each column, in one aggregation of the version's own rows; only numbers have quantiles."""
    fields = [f for f in df.schema if cols is None or f.name in cols]
    parts = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        hashed = c if isinstance(f.dataType, T.IntegerType | T.LongType | T.StringType | T.BinaryType) else c.cast("string")
        number = isinstance(f.dataType, T.NumericType)
        kll = F.kll_sketch_agg_double(c.cast("double"), F.lit(KLL_K)) if number else F.max(F.lit(None).cast("binary"))
        parts += [F.count_if(c.isNull()).alias(f"u{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}"), F.hll_sketch_agg(hashed, F.lit(LG_K)).alias(f"s{i}"), kll.alias(f"k{i}")]
    one = df.agg(F.count("*").alias("n"), *parts)
    each = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"u{i}").alias("nulls"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"), F.col(f"s{i}").alias("hll"), F.col(f"k{i}").alias("kll")) for i, f in enumerate(fields)]))
    return one.select("n", each.alias("c")).select(F.lit(table).alias("table"), F.lit(version).alias("version"), "c.column", "n", "c.nulls", "c.low", "c.high", "c.hll", "c.kll")


def write_statistics(statistics: DataFrame, path: str) -> None:
    """Adds a version's records; writing a version again replaces its own."""
    statistics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATISTICS).parquet(path)


def merged(statistics: DataFrame, types: dict[str, str], quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """(table, column, n, nulls, low, high, distinct_estimate, quantiles) over all versions given.

    types: of the columns, as bounds are kept as texts and must compare by value. Columns without quantiles have null.
    """
    typed = lambda c, pick: reduce(F.coalesce, [pick(F.when(F.col("column").isin([n for n, k in types.items() if k == kind]), F.col(c).cast(kind))).cast("string") for kind in sorted(set(types.values()))])
    out = statistics.groupBy("table", "column").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), typed("low", F.min).alias("low"), typed("high", F.max).alias("high"),
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct_estimate"), F.kll_merge_agg_double("kll").alias("kll"),
    )
    at = F.when(F.kll_sketch_get_n_double("kll") > 0, F.kll_sketch_get_quantile_double("kll", F.array(*[F.lit(float(q)) for q in quantiles])))
    return out.withColumn("quantiles", at).drop("kll")
