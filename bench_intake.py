"""Times the intake jobs at the row counts that a bulk reload is judged by, on rows that Spark derives from $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loadproof.model import Edge
from loadproof.operators import compare, keys, refs
from loadproof.sources import dump, sinks
from loadproof.sources.scratch import new_path, until_exit


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")

    def rows(n: int):
        """n rows, the given ones repeated under keys of their own."""
        copies = F.explode(F.sequence(F.lit(0), F.lit(-(-n // lines.count()) - 1))).alias("copy")
        many = lines.select("*", copies).withColumn("l_orderkey", F.col("l_orderkey") * 100 + F.col("copy")).withColumn("fk", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(30_000))).drop("copy").limit(n)
        many.write.parquet(path := new_path(spark))
        until_exit(spark, path)
        return spark.read.parquet(path)

    took: dict[str, float] = {}

    def timed(name: str, job) -> None:
        for _ in range(2):  # the second run counts: code is compiled by then
            began = time.time()
            job()
            took[name] = round(time.time() - began, 2)

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    child, parent = rows(3_000_000), spark.range(30_000).select(F.col("id").alias("p"))
    edge = Edge("e", "lineitem", ("fk",), "parent", ("p",), ("l_orderkey",))
    timed("fk_3m_by_30k", lambda: noop(refs.fk_orphans(child, parent, edge)))
    timed("fk_3m_by_30k_hot_keys", lambda: noop(refs.orphans_with_hot_keys(child, parent, edge)))
    timed("key_3m", lambda: noop(keys.unique_violations(child, ["l_orderkey", "l_linenumber"])))
    large = rows(3_930_000)
    timed("checksum_3_93m", lambda: noop(compare.content_checksum(large)))
    part = rows(393_000).drop("fk")
    dump.dump_lines(part, "dba", "lineitem").write.text(files := new_path(spark))
    until_exit(spark, files)
    kinds = dict(part.dtypes)

    def load() -> None:
        until_exit(spark, target := new_path(spark))
        assert sinks.load_decoded(dump.decode(dump.scan_objects(spark, files).select("file", "line"), kinds), target, file_col="file") == 393_000

    timed("scan_393k", lambda: noop(dump.scan_objects(spark, files)))
    timed("scan_decode_load_393k", load)
    print(json.dumps({"metric": "intake_seconds", "unit": "sec", "jobs": took, "cpus": cpus}))


if __name__ == "__main__":
    main()
