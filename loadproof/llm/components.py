"""Connected components of a table of links, by contraction, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadproof.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of any ordered type to (node, label): the smallest node that links reach.

    Only nodes with a link come out; self links, repeated links and either direction are fine; no
    links give no rows. In a round every node takes its least neighbour's least neighbour as its
    label, the links are rewritten to labels, and those within one label go, so that each round works on
    fewer links; what a round yields is written to the shared folder.
    """
    left = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    total = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("label"))
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")))
        top = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("to"))
        top = stored(top)
        of = lambda side, top=top: top.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to"))
        new = left.join(of("a"), "a").join(of("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        left = stored(new.where("a < b").distinct())
        total = stored(total.join(top.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    return total
