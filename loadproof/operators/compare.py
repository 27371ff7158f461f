"""Comparing a copy with its source: counts, order-free checksums, fingerprints, differences."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadproof.functions.text import canonical


def table_counts(tables: Mapping[str, DataFrame], total: str | None = "TOTAL") -> DataFrame:
    """(table, n) for each table and, by rollup, their total."""
    each = reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()))
    if not total:
        return each
    return each.rollup("table").agg(F.sum("n").alias("n")).select(F.coalesce("table", F.lit(total)).alias("table"), "n")


def content_checksum(df: DataFrame, text: Callable[[DataFrame], Column] = canonical) -> DataFrame:
    """(n, checksum): two sums over all rows of 60 bits each of a row's digest, so order is nothing and repeated rows count."""
    part = lambda at: F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(20,0)")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").cast("string")
    rows = df.select(F.md5(text(df)).alias("d")).select(part(1).alias("a"), part(17).alias("b"))
    return rows.agg(F.count("*").alias("n"), F.concat_ws("-", total("a"), total("b")).alias("checksum"))


def checksums(tables: Mapping[str, DataFrame], text: Callable[[DataFrame], Column] = canonical) -> DataFrame:
    return reduce(DataFrame.unionByName, (content_checksum(df, text).select(F.lit(name).alias("table"), "n", "checksum") for name, df in tables.items()))


def count_agreement(counts: DataFrame, hashed: DataFrame) -> DataFrame:
    """Counts asked for separately (table, n) against counts of hashed rows; a table on one side alone disagrees.

    With counts that the dump's maker states, a table whose file was cut short disagrees.
    """
    joined = counts.select("table", F.col("n").alias("counted")).join(hashed.select("table", F.col("n").alias("hashed")), "table", "full_outer")
    return joined.select("table", "counted", "hashed", F.col("counted").eqNullSafe(F.col("hashed")).alias("agree"))


def schema_fingerprint(tables: Mapping[str, DataFrame], spark) -> DataFrame:
    """(tag, table, item, detail): tables and their columns with place and type; of as many rows as there are columns."""
    rows = [("#ATTR", name, f.name, f"{i} {f.dataType.simpleString()}") for name, df in tables.items() for i, f in enumerate(df.schema)] + [("#CLASS", name, "", "") for name in tables]
    return spark.createDataFrame(rows, "tag string, table string, item string, detail string")


def fingerprint(catalog: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], users: DataFrame) -> DataFrame:
    """One frame of tagged rows (tag, owner, table, detail) from catalog frames, for user tables alone."""

    def one(tag: str) -> DataFrame:
        kept = catalog[tag].join(users.select("owner", "table"), ["owner", "table"])
        return kept.select(F.lit(f"#{tag}").alias("tag"), "owner", "table", F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in keys[tag]]).alias("detail"))

    return reduce(DataFrame.unionByName, (one(tag) for tag in catalog))


def diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one side that the other lacks, or has with other values: keys, side, and the values of both sides."""
    values = [c for c in a.columns if c not in keys]
    left, right = a.select(*keys, F.struct(F.lit(1).alias("_"), *values).alias("a")), b.select(*keys, F.struct(F.lit(1).alias("_"), *values).alias("b"))
    side = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return left.join(right, list(keys), "full_outer").select(*keys, side.alias("side"), *[F.col(f"a.{v}").alias(f"{v}_a") for v in values], *[F.col(f"b.{v}").alias(f"{v}_b") for v in values]).where("side IS NOT NULL")


def data_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, each as often as it has them more."""
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b")))


def compare(source: Mapping[str, DataFrame], target: Mapping[str, DataFrame], text: Callable[[DataFrame], Column] = canonical) -> DataFrame:
    """For each table counts and checksums of source and target, how many columns differ in name, place or type, and whether all is the same."""
    s, t = checksums(source, text), checksums(target, text)
    joined = s.toDF("table", "n_source", "sum_source").join(t.toDF("table", "n_target", "sum_target"), "table", "full_outer")
    spark = s.sparkSession
    # as many rows as there are columns
    other = diff(schema_fingerprint(source, spark), schema_fingerprint(target, spark), ["tag", "table", "item"]).groupBy("table").agg(F.count("*").alias("n_other"))
    out = joined.join(F.broadcast(other), "table", "left").withColumn("schema_diffs", F.coalesce("n_other", F.lit(0))).drop("n_other")
    same = F.col("n_source").eqNullSafe(F.col("n_target")) & F.col("sum_source").eqNullSafe(F.col("sum_target")) & (F.col("schema_diffs") == 0)
    return out.withColumn("same", same)


def auth_fingerprint(users: DataFrame, grants: DataFrame, tables: DataFrame) -> DataFrame:
    """Users and the grants on the given tables, as tagged rows."""
    own = grants.join(tables.select("table"), "table", "left_semi")
    return users.select(F.lit("#USER").alias("tag"), "user", F.lit("").alias("detail")).unionByName(own.select(F.lit("#GRANT").alias("tag"), "user", F.concat_ws(" ", "table", "privilege").alias("detail"))).distinct()
