"""What follows from failed checks: cascades, fail-fast, decisions for each edge, what is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def withhold_children(edges: DataFrame, failed_keys: DataFrame) -> DataFrame:
    """(child, fk, parent, reason): every edge to a parent that lost a primary or unique key, once."""
    lost = failed_keys.groupBy(F.col("table").alias("parent")).agg(F.min("name").alias("lost_key"))
    reason = F.concat(F.lit("parent key withheld by rebuild ("), "lost_key", F.lit(")"))
    hit = edges.join(lost, "parent").groupBy("child", "fk").agg(F.min(F.struct("parent", reason.alias("reason"))).alias("x"))
    return hit.select("child", "fk", "x.parent", "x.reason")


def failfast(results: DataFrame, run: str = "run_id", order: str = "ord") -> DataFrame:
    """Adds stopped: an earlier edge of the run was violated, in statement order."""
    before = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return results.withColumn("stopped", F.coalesce(F.max(F.col("violated").cast("int")).over(before) == 1, F.lit(False)))


def decide_edges(edges: DataFrame, policy: str = "failfast") -> DataFrame:
    """Adds outcome and reason to edges (run_id, ord, ddl, withheld_reason, present, orphans), first rule that applies.

    Withheld by cascade; not attempted; defined before; no statement; violated; defined. A withheld
    edge, one that is already there, and one without statement never stop later ones.
    """
    if policy not in ("failfast", "continue"):
        raise ValueError(f"unknown policy {policy}")
    tried = F.col("withheld_reason").isNull() & ~F.col("present") & F.col("ddl").isNotNull()
    marked = failfast(edges.withColumn("violated", tried & (F.col("orphans") > 0)))
    stopped = F.col("stopped") if policy == "failfast" else F.lit(False)
    rules = (
        (F.col("withheld_reason").isNotNull(), "withheld", F.col("withheld_reason")),
        (F.col("ddl").isNull(), "no_statement", F.lit("no repair DDL exists")),
        (stopped, "not_attempted", F.lit("not attempted (fail-fast stopped at an earlier rejected edge)")),
        (F.col("present"), "defined", F.lit("present from an earlier run")),
        (F.col("orphans") > 0, "violated", F.concat(F.col("orphans").cast("string"), F.lit(" orphan rows"))),
    )
    outcome, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for when, name, why in rules[1:]:
        outcome, reason = outcome.when(when, name), reason.when(when, why)
    return marked.withColumns({"outcome": outcome.otherwise("defined"), "reason": reason.otherwise("")}).drop("stopped", "violated")


def match_ddl(constraints: DataFrame, statements: DataFrame, reason: str = "no statement in the dump") -> DataFrame:
    """Constraints with the first statement of the same table and name, or the reason why there is none."""
    first = statements.groupBy("table", "name").agg(F.min_by("ddl", F.struct("ord", "ddl")).alias("ddl"))
    return constraints.join(first, ["table", "name"], "left").withColumn("reason", F.when(F.col("ddl").isNull(), reason).otherwise(""))


def missing_constraints(expected: DataFrame, actual: DataFrame, excused: DataFrame) -> DataFrame:
    """Expected constraints that are neither there nor excused, by (table, name)."""
    key = ["table", "name"]
    return expected.join(actual.select(*key), key, "left_anti").join(excused.select(*key), key, "left_anti")


def remaining(expected: DataFrame, done: DataFrame, key: tuple[str, ...] = ("table", "name")) -> DataFrame:
    """What an interrupted run has still to do: what it recorded is not done again."""
    return expected.join(done.select(*key).distinct(), list(key), "left_anti")
