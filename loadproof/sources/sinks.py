"""Publishing tables: all-or-nothing loads, partitions, clustered copies, exception records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loadproof.functions.text import human_bytes  # noqa: F401 - part of the sinks' reports
from loadproof.sources.scratch import create_once, remove


class LoadRejected(ValueError):
    """A row didn't decode; nothing of the table was published."""


class LoadConflict(RuntimeError):
    """Another load of the table was published since this one began; nothing of this one is."""


def load_table(good: DataFrame, rejects: DataFrame, target: str, partition_by: Sequence[str] = (), file_col: str | None = None, base: int | None = None) -> int:
    """Publishes a table, all or nothing, in place of what was published before; returns its rows.

    The rows are written beside the published version first. Only if that is done and no row was rejected
    is one record added that names the new version; until then, and after any failure, readers see the old version
    whole. read_table reads what is published; retire deletes older versions. See published_number for base.
    """
    spark, base = good.sparkSession, published_number(good.sparkSession, target) if base is None else base
    path = _written(good, target, partition_by)
    first = rejects.select(*([file_col] if file_col else []), "reason").limit(1).collect()
    return _publish(spark, target, path, base, ", ".join(map(str, first[0])) if first else None, good.schema)


def load_decoded(decoded: DataFrame, target: str, partition_by: Sequence[str] = (), file_col: str | None = None, base: int | None = None) -> int:
    """load_table of decoded rows (source, row, reason) in one pass: refused rows are counted as the good ones are written."""
    spark, base = decoded.sparkSession, published_number(decoded.sparkSession, target) if base is None else base
    seen = Observation()
    said = F.concat_ws(", ", *([F.col(f"source.`{file_col}`")] if file_col else []), "reason")
    noted = decoded.observe(seen, F.min(F.when(F.col("reason").isNotNull(), said)).alias("first"))
    good = noted.where("reason IS NULL").select("row.*")
    path = _written(good, target, partition_by)
    return _publish(spark, target, path, base, seen.get["first"], good.schema)


def _written(good: DataFrame, target: str, partition_by: Sequence[str]) -> str:
    path = f"{target}/v-{uuid.uuid4().hex}"
    (good.write.partitionBy(*partition_by) if partition_by else good.write).parquet(path)
    return path


def _publish(spark: SparkSession, target: str, path: str, base: int, refused: str | None, schema) -> int:
    if refused is not None:
        remove(spark, path)
        raise LoadRejected(f"{target}: {refused}")
    n = spark.read.schema(schema).parquet(path).count()
    record = json.dumps({"seq": base + 1, "version": path.rpartition("/")[2], "n": n})
    if not create_once(spark, f"{target}/published/{base + 1:010d}.json", record):
        remove(spark, path)
        raise LoadConflict(f"{target}: version {base + 1} was published by another load")
    return n


_RECORD = "seq long, version string, n long"


def published_number(spark: SparkSession, target: str) -> int:
    """The number of the published version, 0 if there is none.

    A load takes it as its base, when it begins or as the caller read it earlier, and becomes number base + 1 only if no other
    load has done so: of two that began on one version, one is published and the other raises LoadConflict.
    """
    return max((r["seq"] for r in _published(spark, target)), default=0)


def _published(spark: SparkSession, target: str) -> list:
    """The records of published versions, one for each load."""
    try:
        return spark.read.schema(_RECORD).json(f"{target}/published").orderBy("seq", "version").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def published_version(spark: SparkSession, target: str) -> str:
    """The name of the published version, a folder of the table's."""
    if not (records := _published(spark, target)):
        raise ValueError(f"{target}: nothing is published")
    return records[-1]["version"]


def read_table(spark: SparkSession, target: str) -> DataFrame:
    """The published version of a table that load_table wrote."""
    return spark.read.parquet(f"{target}/{published_version(spark, target)}")


def beside(target: str, version: str) -> str:
    """The folder of what is kept about a version beside it, such as its hash trees."""
    return f"{target}/of-{version}"


def retire(spark: SparkSession, target: str) -> None:
    """Deletes all but the published version, and what is kept beside them; for when no reader is at an older one."""
    for record in _published(spark, target)[:-1]:
        remove(spark, f"{target}/{record['version']}")
        remove(spark, beside(target, record["version"]))


def partition_column(kind: str, col: str, spec: Mapping | Sequence | int) -> Column:
    """The partition of a row: `range` takes [(name, bound)] and a last (name, None), `list` {value: name}, `hash` a number."""
    if kind == "hash":
        return F.concat(F.lit("p"), F.pmod(F.xxhash64(col), F.lit(spec)).cast("string"))
    if kind == "list":
        out = None
        for value, name in spec.items():
            out = F.when(F.col(col).eqNullSafe(F.lit(value)), name) if out is None else out.when(F.col(col).eqNullSafe(F.lit(value)), name)
        return out
    if kind != "range":
        raise ValueError(f"unknown partitioning {kind}")
    out = None
    for name, top in spec:
        hit = F.lit(True) if top is None else F.col(col) < F.lit(top)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def write_clustered(df: DataFrame, cols: Sequence[str], target: str, files: int | None = None) -> None:
    """A copy in ranges of the columns, sorted, so that later lookups skip files and row groups by their least and largest values."""
    dealt = df.repartitionByRange(files, *cols) if files else df.repartitionByRange(*cols)
    dealt.sortWithinPartitions(*cols).write.mode("overwrite").parquet(target)


def write_bucketed(df: DataFrame, cols: Sequence[str], buckets: int, name: str) -> None:
    """A saved table in buckets of a join key; joins of such tables on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *cols).sortBy(*cols).saveAsTable(name)


def write_exceptions(orphans: DataFrame, repairs: DataFrame, path: str, run_id: str) -> None:
    """Orphan and repair records of a run; writing a run again replaces its records and no other's."""
    rows = orphans.select(F.lit("orphan").alias("record"), "edge", F.col("child_key").alias("subject"), F.col("fk_values").alias("detail")).unionByName(
        repairs.select(F.lit("repair").alias("record"), F.col("name").alias("edge"), F.col("table").alias("subject"), F.col("ddl").alias("detail"))
    )
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_exceptions(spark: SparkSession, path: str) -> DataFrame:
    """The records of all runs; run ids are the texts that were given, as `007`."""
    return spark.read.schema("record string, edge string, subject string, detail string, run_id string").parquet(path)


#: Bits of a column's rank that a Z-order key keeps.
RANK_BITS = 6


def z_key(df: DataFrame, cols: Sequence[str], bits: int = RANK_BITS) -> Column:
    """One number that interleaves the bits of several columns' ranks, so that rows near in all of them are near in it.

    A rank is the place among 2 ** bits quantiles of the column, which a sketch gives in one pass over all rows; so skewed values
    share the ranks evenly, and dates and numbers alike can take part. Null ranks first.
    """
    number = lambda c: F.unix_micros(F.col(f"`{c}`").cast("timestamp")) if dict(df.dtypes)[c].startswith(("date", "timestamp")) else F.col(f"`{c}`").cast("double")
    steps = F.array(*[F.lit(i / 2**bits) for i in range(1, 2**bits)])
    known = df.agg(*[F.kll_sketch_agg_double(number(c).cast("double")).alias(f"k{i}") for i, c in enumerate(cols)])
    cuts = known.select(*[F.when(F.kll_sketch_get_n_double(f"k{i}") > 0, F.kll_sketch_get_quantile_double(f"k{i}", steps)).alias(f"q{i}") for i in range(len(cols))]).first()
    out = F.lit(0).cast("long")
    for i, c in enumerate(cols):
        bounds, value = F.array(*[F.lit(x) for x in cuts[i] or []]).cast("array<double>"), number(c).cast("double")
        rank = F.size(F.filter(bounds, lambda x: x <= value)).cast("long")  # noqa: B023 - built at once
        for bit in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(cols) + i))
    return out


def write_zordered(df: DataFrame, cols: Sequence[str], target: str, files: int, bits: int = RANK_BITS) -> None:
    """A copy clustered by several columns at once: a lookup by any of them skips most files by their least and largest values."""
    keyed = df.withColumn("_z", z_key(df, cols, bits))
    keyed.repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z").write.mode("overwrite").parquet(target)


def footer_statistics(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """(n, and for each column <c>_n, <c>_low and <c>_high) of a Parquet table from its files' footers; no data page is read.

    Parquet keeps such bounds of numbers and dates; another column's would have to be read, so it is refused. The frame belongs to a session of its own, in
    which the reader pushes aggregates down; the caller's settings stay as they are.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    table = own.read.parquet(path)
    kinds = dict(table.dtypes)
    if other := [c for c in cols if kinds[c] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "date")]:
        raise ValueError(f"no exact bounds in footers for {', '.join(other)}")
    return table.agg(F.count("*").alias("n"), *[f(F.col(f"`{c}`")).alias(f"{c}_{name}") for c in cols for f, name in ((F.count, "n"), (F.min, "low"), (F.max, "high"))])
