"""Catalog frames: classes, references, indexes and the rest, from files or a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The catalog's frames and their columns.
FRAMES = {
    "classes": "owner string, table string, class_type string, is_system boolean",
    "references": "owner string, table string, constraint string, parent_owner string, parent string",
    "supers": "owner string, table string, super_owner string, super string",
    "partitions": "owner string, table string, partition string",
    "serials": "name string, owner string, table string",
    "object_attributes": "owner string, table string, column string, domain string",
    "indexes": "owner string, table string, index string, is_primary_key boolean, is_foreign_key boolean, is_unique boolean",
    "index_keys": "owner string, table string, index string, column string, key_order int",
}
PARTITION = "__p__"


def read_catalog(spark: SparkSession, path: str, jdbc: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Every frame, from Parquet below path, or by JDBC with the options given and path as a name prefix."""
    if jdbc is not None:
        return {name: spark.read.format("jdbc").options(**jdbc, dbtable=f"{path}{name}").load() for name in FRAMES}
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in FRAMES.items()}


def user_tables(classes: DataFrame) -> DataFrame:
    """Classes that are no system classes, no views, and no partitions of others."""
    return classes.where(~F.col("is_system") & (F.col("class_type") == "CLASS") & ~F.col("table").contains(PARTITION))


def identity(df: DataFrame) -> list[str]:
    """What tells a table: owner and name, or the name alone in a frame of one owner."""
    return [c for c in ("owner", "table") if c in df.columns]


def unsupported(attributes: DataFrame) -> DataFrame:
    """(owner, table, detail): tables with object columns and what these are, `column -> domain` in order."""
    return attributes.groupBy(*identity(attributes)).agg(F.array_join(F.array_sort(F.collect_set(F.concat("column", F.lit(" -> "), "domain"))), ", ").alias("detail"))


def gate_tables(tables: DataFrame, attributes: DataFrame, skip: bool, layout: str = "PER_CLASS") -> tuple[DataFrame, DataFrame]:
    """(kept, skipped). Without skip, or with all tables in one file, a table with object columns refuses the run."""
    found = unsupported(attributes)
    if not skip or layout == "SINGLE":
        bad = found.orderBy(*identity(found)).limit(20).collect()
        if bad:
            raise ValueError("unsupported columns: " + "; ".join(f"{r['table']} ({r['detail']})" for r in bad))
    key = [c for c in identity(tables) if c in found.columns]
    return tables.join(found.select(*key), key, "left_anti"), tables.join(found, key)
