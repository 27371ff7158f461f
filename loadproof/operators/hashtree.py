"""Hash trees of tables: two copies compare roots, then only the branches that differ.

A row belongs to the bucket that the digest of its key names. A leaf holds its bucket's count and order-free sum of row digests; a node
above holds the digest of its FAN children's, in order. A tree is built in one pass beside a published version and is
small, whatever the table's size; comparing two copies then reads no rows but those of unequal buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadproof.functions.text import canonical
from loadproof.sources.scratch import remove, stored
from loadproof.sources.sinks import beside, published_version

#: Children of a node; leaves number a power of it.
FAN = 16
#: Unequal nodes of a level whose numbers may be sent to the next level's scan; more are joined.
SENT = 10_000
#: The most nodes that a level of one file may have.
ONE_FILE = 65_536


def bucket_of(df: DataFrame, keys: Sequence[str], depth: int) -> Column:
    """The bucket of a row, below FAN ** depth: 60 bits of the digest of its key."""
    whole = F.md5(canonical(df.select(*[F.col(f"`{k}`") for k in keys])))
    return F.pmod(F.conv(F.substring(whole, 1, 15), 16, 10).cast("long"), F.lit(FAN**depth))


def build_tree(df: DataFrame, keys: Sequence[str], depth: int, path: str) -> None:
    """Writes the tree of a table, a folder for each level: level 0 has the root, level `depth` the FAN ** depth buckets, empty ones left out."""
    part = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)")
    rows = df.select(bucket_of(df, keys, depth).alias("node"), F.md5(canonical(df)).alias("h"))
    sums = F.concat_ws("-", F.count("*").cast("string"), *[F.sum(part(at)).cast("string") for at in (1, 17)])
    level = rows.groupBy("node").agg(F.count("*").alias("n"), F.md5(sums).alias("digest"))
    for k in range(depth, -1, -1):
        # in order, so that scans skip what lies outside; a level of few nodes, by its place in the tree, is one file
        ordered = level.repartition(1).sortWithinPartitions("node") if FAN**k <= ONE_FILE else level.orderBy("node")
        ordered.write.parquet(f"{path}/level={k}")
        level = df.sparkSession.read.schema("node long, n long, digest string").parquet(f"{path}/level={k}")
        # at most FAN rows meet in a node
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["digest"])), ",")
        level = level.groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(F.sum("n").alias("n"), F.md5(children).alias("digest"))


def read_tree(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema("node long, n long, digest string").parquet(f"{path}/level={level}")


def unequal_buckets(spark: SparkSession, a: str, b: str, depth: int) -> DataFrame:
    """(bucket, n_a, n_b) of the buckets in which two trees of one depth differ; 0 where a side has no row.

    From the root down: of each level only the children of unequal nodes are looked at, so equal copies cost one row each.
    """
    wanted: DataFrame | None = None
    for level in range(depth + 1):
        left, right = (read_tree(spark, p, level) for p in (a, b))
        if wanted is not None:
            numbers = [r[0] for r in wanted.limit(SENT + 1).collect()]
            if len(numbers) <= SENT:  # told to the scan, which skips what lies outside
                low, high = (min(numbers) * FAN, (max(numbers) + 1) * FAN) if numbers else (0, 0)
                within = F.floor(F.col("node") / FAN).isin(numbers) & (F.col("node") >= low) & (F.col("node") < high)
                left, right = left.where(within), right.where(within)
            else:
                up = wanted.select(F.col("node").alias("up"))
                left, right = (t.join(up, F.floor(t["node"] / FAN) == up["up"], "left_semi") for t in (left, right))
        both = left.join(right.select("node", F.col("n").alias("n_b"), F.col("digest").alias("other")), "node", "full_outer")
        wanted = stored(both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("node", F.coalesce("n", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")))
        if wanted.isEmpty():
            break
    return wanted.select(F.col("node").alias("bucket"), "n_a", "n_b") if level == depth else wanted.select(F.col("node").alias("bucket"), "n_a", "n_b").where("false")


def published_tree(spark: SparkSession, target: str, keys: Sequence[str], depth: int) -> str:
    """The tree of a published table, built when it is first asked for; its root is written last, so a tree with a root is whole."""
    version = published_version(spark, target)
    path = f"{beside(target, version)}/tree-{depth}-{'-'.join(keys)}"
    try:
        read_tree(spark, path, 0)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        remove(spark, path)  # what a build that failed has left
        build_tree(spark.read.parquet(f"{target}/{version}"), keys, depth, path)
    return path


def compare_published(spark: SparkSession, a: str, b: str, keys: Sequence[str], depth: int) -> DataFrame:
    """unequal_buckets of two published tables, each of whose versions is read once for all comparisons to come."""
    return unequal_buckets(spark, published_tree(spark, a, keys, depth), published_tree(spark, b, keys, depth), depth)


def unequal_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], depth: int, buckets: DataFrame) -> DataFrame:
    """Rows of unequal buckets that one copy has more often than the other, with `side`; rows of equal buckets are never shuffled."""
    few = F.broadcast(buckets.select(F.col("bucket").alias("_bucket")))
    own = lambda df: df.join(few, bucket_of(df, keys, depth) == F.col("_bucket"), "left_semi")
    left, right = own(a), own(b)
    return left.exceptAll(right).withColumn("side", F.lit("only_a")).unionByName(right.exceptAll(left).withColumn("side", F.lit("only_b")))
