"""Referential checks by anti-joins: every orphan is listed, in one distributed job for each edge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadproof.functions.text import complete_key, render_key
from loadproof.model import Edge
from loadproof.sources.scratch import stored


def _anti(child: DataFrame, parent: DataFrame, edge: Edge, how: str = "left_anti") -> DataFrame:
    # the child's key columns must be complete before the join: rows with nulls are no orphans and would pile up in one task
    examined = child.where(complete_key(edge.child_columns))
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(edge.parent_columns)])
    on = reduce(and_, (F.col(c) == F.col(f"_p{i}") for i, c in enumerate(edge.child_columns)))
    return examined.join(keys, on, how)


def orphan_rows(child: DataFrame, parent: DataFrame, edge: Edge) -> DataFrame:
    """The child rows whose complete key has no parent, all columns."""
    return _anti(child, parent, edge)


def fk_orphans(child: DataFrame, parent: DataFrame, edge: Edge) -> DataFrame:
    """(edge, child, parent, child_key, fk_values), one row for each orphan."""
    return orphan_rows(child, parent, edge).select(
        F.lit(edge.name).alias("edge"), F.lit(edge.child).alias("child"), F.lit(edge.parent).alias("parent"), render_key(edge.child_key).alias("child_key"), render_key(edge.child_columns).alias("fk_values")
    )


def check_edges(tables: Mapping[str, DataFrame], edges: Sequence[Edge]) -> DataFrame:
    """Orphans of all edges in one frame; cycles and self references need no order, as all data is loaded."""
    return reduce(DataFrame.unionByName, (fk_orphans(tables[e.child], tables[e.parent], e) for e in edges))


def edge_results(orphans: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge with its orphans, 0 included, and whether it is violated."""
    counts = orphans.groupBy("edge").agg(F.count("*").alias("n"))
    return edges.join(counts, "edge", "left").select(*edges.columns, F.coalesce("n", F.lit(0)).alias("orphans"), (F.coalesce("n", F.lit(0)) > 0).alias("violated"))


def first_offender(orphans: DataFrame, key: str) -> DataFrame:
    """For each edge its distinct offending values and the one that a check that stops would name."""
    return orphans.groupBy("edge").agg(F.countDistinct("fk_values").alias("distinct_values"), F.min(key).alias("first_key"), F.min_by("fk_values", F.struct(key, "fk_values")).alias("first_value"))


#: Parents' keys that may be sent to all: at most so many, and so many bytes.
SENT_KEYS, SENT_BYTES = 4_000_000, 128 << 20


def fk_check_multi(child: DataFrame, parents: Mapping[str, DataFrame], edges: Sequence[Edge]) -> DataFrame:
    """(edge, rows_checked, orphans) of several edges of one child.

    Parents whose keys are measured to be small are sent to all and looked up in one scan of the child,
    which then needs no shuffle. For each other parent the child's keys are counted first, so what is shuffled
    is a row for each distinct key. Keys compare as the columns' types do, an int with a decimal by value.
    """
    keys = {e.name: parents[e.parent].select(*[F.col(p).alias(f"_{i}") for i, p in enumerate(e.parent_columns)]).where(complete_key([f"_{i}" for i in range(len(e.parent_columns))])) for e in edges}
    bytes_ = lambda df: F.coalesce(F.sum(F.octet_length(F.concat_ws("", *df.columns)) + 16), F.lit(0))
    sizes = reduce(DataFrame.unionByName, (k.agg(F.count("*").alias("n"), bytes_(k).alias("b")).select(F.lit(name).alias("edge"), "n", "b") for name, k in keys.items()))
    small = {r["edge"] for r in sizes.where((F.col("n") <= SENT_KEYS) & (F.col("b") <= SENT_BYTES)).collect()}  # one row for each edge
    parts = []
    if sent := [e for e in edges if e.name in small]:
        rows, sums = child.select(*sorted({c for e in sent for c in e.child_columns})), []
        for n, e in enumerate(sent):
            known = keys[e.name].distinct().toDF(*[f"_{n}_{i}" for i in range(len(e.parent_columns))]).withColumn(f"_hit{n}", F.lit(1))
            rows = rows.join(F.broadcast(known), reduce(and_, (F.col(c) == F.col(f"_{n}_{i}") for i, c in enumerate(e.child_columns))), "left")
            whole = complete_key(e.child_columns)
            sums.append(F.struct(F.lit(e.name).alias("edge"), F.count(F.when(whole, 1)).alias("rows_checked"), F.count(F.when(whole & F.col(f"_hit{n}").isNull(), 1)).alias("orphans")))
        parts.append(rows.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    for e in edges:
        if e.name not in small:
            counted = child.where(complete_key(e.child_columns)).groupBy(*e.child_columns).agg(F.count("*").alias("_n"))
            known = keys[e.name].distinct().withColumn("_hit", F.lit(1))
            on = reduce(and_, (F.col(c) == F.col(f"_{i}") for i, c in enumerate(e.child_columns)))
            n = lambda c: F.coalesce(F.sum(c), F.lit(0))
            parts.append(counted.join(known, on, "left").agg(n("_n").alias("rows_checked"), n(F.when(F.col("_hit").isNull(), F.col("_n"))).alias("orphans")).select(F.lit(e.name).alias("edge"), "rows_checked", "orphans"))
    return reduce(DataFrame.unionByName, parts)


def repair_drop_orphans(child: DataFrame, parent: DataFrame, edge: Edge) -> DataFrame:
    """The child without its orphans: rows with a parent, and rows whose key is incomplete."""
    return _anti(child, parent, edge, "left_semi").unionByName(child.where(~complete_key(edge.child_columns)))


#: Keys that the sketch of frequent keys follows, and the share of all rows from which a key counts as hot.
FOLLOWED, HOT_SHARE = 1000, 0.001


def hot_keys(child: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The complete keys that a thousandth of the rows or more may have, at most FOLLOWED, by a sketch of one pass.

    The sketch never undercounts by more than its own error, so a key of that share is in it; a few others may be too, which does no harm.
    """
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cols)])
    whole = child.where(complete_key(cols)).select(F.to_json(key).alias("key"), key.alias("k"))
    # keys travel as JSON, since the sketch takes texts
    counts = whole.agg(F.expr(f"approx_top_k(key, {FOLLOWED}, {FOLLOWED * 10})").alias("top"), F.count("*").alias("n"))
    top = counts.select(F.explode("top").alias("t"), "n").where(F.col("t.count") >= F.col("n") * HOT_SHARE)
    schema = child.select(key.alias("k")).schema["k"].dataType
    return top.select(F.from_json("t.item", schema).alias("k")).select(*[F.col(f"k.k{i}").alias(f"_k{i}") for i in range(len(cols))])


def orphans_with_hot_keys(child: DataFrame, parent: DataFrame, edge: Edge) -> DataFrame:
    """orphan_rows for children some of whose keys have very many rows.

    Hot keys are looked up once each among the parents, and what is known of them is sent to all, so that their rows never
    move; all other rows meet the parents by a shuffle, in which no key has more than a thousandth of the rows.
    """
    n = range(len(edge.child_columns))
    hot = stored(hot_keys(child, edge.child_columns).distinct())
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(edge.parent_columns)])
    absent = stored(hot.join(keys, reduce(and_, (F.col(f"_k{i}") == F.col(f"_p{i}") for i in n)), "left_anti"))
    examined = child.where(complete_key(edge.child_columns))
    same = reduce(and_, (F.col(c) == F.col(f"_k{i}") for i, c in enumerate(edge.child_columns)))
    of_hot = examined.join(F.broadcast(absent), same, "left_semi")
    rest = examined.join(F.broadcast(hot), same, "left_anti")
    return of_hot.unionByName(rest.join(keys, reduce(and_, (F.col(c) == F.col(f"_p{i}") for i, c in enumerate(edge.child_columns))), "left_anti"))


def bucketed_orphans(spark: SparkSession, child_table: str, parent_table: str, edge: Edge) -> DataFrame:
    """orphan_rows of two saved tables in as many buckets of the edge's columns; their buckets meet without a shuffle.

    Both tables are those of sinks.write_bucketed; the join is told to merge them as they are sorted, since a broadcast would read the parent whole in
    every executor.
    """
    parent = spark.table(parent_table).hint("merge")
    return _anti(spark.table(child_table), parent, edge)
