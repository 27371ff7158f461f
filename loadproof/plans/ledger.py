"""The run ledger: one appended record for each (run, phase, section), readable over many runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phases in order, the sections that a phase requires, and the newest format known.
PHASES = ("discovered", "defined", "stripped", "loaded", "rebuilt", "fk_defined", "stats_updated", "done")
REQUIRES = {
    "graph": ("stripped", "loaded", "rebuilt", "fk_defined", "stats_updated", "done"),
    "strip": ("stripped", "loaded", "rebuilt", "fk_defined", "stats_updated", "done"),
    "load": ("loaded", "rebuilt", "fk_defined", "stats_updated", "done"),
    "rebuild": ("rebuilt", "fk_defined", "stats_updated", "done"),
    "validate": ("fk_defined", "stats_updated", "done"),
    "fkdefine": ("fk_defined", "stats_updated", "done"),
    "stats": ("stats_updated", "done"),
}
FORMAT = 3
SCHEMA = "run_id string, attempt long, seq long, phase string, section string, ok boolean, detail string, format int"


def append_ledger(records: DataFrame, path: str) -> None:
    """Adds records; call it after the phase's own data is durable. Earlier attempts are kept."""
    records.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def latest(records: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of each key; ties go to the record that is last by all columns."""
    window = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order], *[F.desc(c) for c in records.columns if c not in order])
    return records.withColumn("_r", F.row_number().over(window)).where("_r = 1").drop("_r")


def resume_decision(runs: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds decision and why to runs (run_id, readable, restart, format, phase, same_target, unresolved), first rule that applies.

    sections: (run_id, section) of what each run recorded. The target's identity is looked at before
    a finished run is taken as clean.
    """
    need = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(p).alias("phase")) for s, ps in REQUIRES.items() for p in ps])).alias("x")
    wanted = runs.sparkSession.range(1).select(need).select("x.section", "x.phase")
    lacking = runs.join(F.broadcast(wanted), "phase").join(sections.select("run_id", "section"), ["run_id", "section"], "left_anti").groupBy("run_id").agg(F.min("section").alias("lacks"))
    rules = (
        (~F.col("readable"), "refuse", "record unreadable"),
        (F.col("restart"), "fresh", "restart asked for"),
        (F.col("format") > FORMAT, "fresh", "newer format"),
        (F.col("phase").isNull(), "refuse", "no phase recorded"),
        (~F.col("same_target"), "fresh", "other target"),
        ((F.col("phase") == "done") & (F.col("unresolved") == 0), "done_clean", ""),
        (F.col("phase") == "done", "done_partial", "unresolved items"),
        (F.col("phase") == "discovered", "fresh", "nothing was defined"),
        (F.col("lacks").isNotNull(), "fresh", "section missing"),
    )
    decision = why = None
    for when, name, reason in rules:
        decision = F.when(when, name) if decision is None else decision.when(when, name)
        why = F.when(when, reason) if why is None else why.when(when, reason)
    return runs.join(lacking, "run_id", "left").withColumns({"decision": decision.otherwise(F.concat(F.lit("resume_after_"), "phase")), "why": why.otherwise("")}).drop("lacks")


def verify_target(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(run_id, table, problem) of recorded tables (run_id, table, phase) against actual ones (run_id, table, rows, constraints).

    Every recorded table exists; none has constraints once stripped; none has rows at `defined`.
    """
    both = recorded.join(actual, ["run_id", "table"], "left")
    problem = (
        F.when(F.col("rows").isNull(), "missing")
        .when((F.col("phase") == "stripped") & (F.col("constraints") > 0), "constraints present")
        .when((F.col("phase") == "defined") & (F.col("rows") > 0), "not empty")
    )
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("run_id", "table", "problem")


def unresolved(records: DataFrame) -> DataFrame:
    """(run_id, unresolved): pending keys, failed copies, withheld or violated edges and failed statistics."""
    return records.groupBy("run_id").agg(F.count(F.when(~F.col("ok"), 1)).alias("unresolved"))
