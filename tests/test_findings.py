"""What a reviewer found in the intake queries: on tables written otherwise, and at size."""

import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loadproof import catalogue
from loadproof.functions.text import sql_row
from loadproof.operators import profile
from loadproof.sources import blocks, dump

SMALL = "/root/testdata/sf0.001"


def test_floating_text_is_that_of_sql(spark):
    numbers = ["0.0", "-0.0", "900.1", "9999999.99", "10000000.0", "-12345678.9", "123456789012345.6", "1e15", "1e16", "-1.5e22", "0.001", "0.0001", "0.00025", "-0.00001", "1.25e-7", "1e-100", "1e300", "NaN", "Infinity", "-Infinity"]
    got = [r[0].split(":", 1)[1] for r in spark.createDataFrame([(float(x),) for x in numbers], "x double").coalesce(1).select(sql_row(spark.createDataFrame([], "x double"))).collect()]
    assert got == [duckdb.sql(f"SELECT CAST(CAST('{x}' AS DOUBLE) AS VARCHAR)").fetchall()[0][0] for x in numbers]


@pytest.mark.parametrize("name", ["content_checksum", "roundtrip_compare"])
def test_checksums_of_tables_written_otherwise(spark, tmp_path, name):
    """A column more, columns in another order, amounts of ten million, a zero with a sign, times as instants."""
    for t in catalogue.TABLES:
        if t not in ("customer", "orders"):
            os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet")
    key = F.col("c_custkey")
    customer = read("customer").withColumn("c_acctbal", F.when(key % 3 == 0, F.col("c_acctbal") * 1e5).when(key % 3 == 1, F.lit(-0.0)).otherwise(F.col("c_acctbal")))
    customer.select("c_nationkey", "c_custkey", "c_name", "c_mktsegment", "c_acctbal", F.lit(1).alias("copy")).write.parquet(str(tmp_path / "customer.parquet"))
    read("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 0.25 SECOND")).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet{'/*.parquet' if t in ('customer', 'orders') else ''}'")
    assert con.sql("DESCRIBE orders").fetchall()[4][1] == "TIMESTAMP"
    want = con.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_decoding_holds_few_lines_at_once():
    """Lines of collections are decoded in pieces of bounded bytes; a line longer than a piece is whole."""
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n if n else None for n in (400_000, 700_000, 0, 3_000_000, 5, 100)])], names=["line"])
    sizes = [p.column(0).to_pylist() for p in blocks._slices(batch, 0)]
    assert [x for s in sizes for x in s] == batch.column(0).to_pylist()
    assert max(sum(len(x or "") for x in s[1:]) for s in sizes) <= blocks.DECODED_BYTES
    assert list(blocks._slices(batch.slice(0, 0), 0)) == []


def test_bare_rows_and_others_decode_alike(spark, tmp_path):
    """Rows of bare tokens are split in Arrow; quoted, odd, short and blank ones one by one. Only the line is asked for."""
    lines = ["1 a", "2 NULL", "3 'NULL'", "4  b", "5\tc", " 6 d", "7 é", "8 'x y'", "9 {1,2}", "10", "11 a b", "12 a|~b", "   ", "13 'it''s", "no end'"]
    (tmp_path / "f").write_text("before\n%class [dba].[t] ([k] [v])\n" + "\n".join(lines) + "\n")
    scanned = dump.scan_objects(spark, str(tmp_path / "f"), ["line"])
    assert scanned.columns == ["line"]
    whole = dump.scan_objects(spark, str(tmp_path / "f"))
    assert {(r.owner, r.cls, tuple(r.cols)) for r in whole.collect()} == {("dba", "t", ("k", "v"))}
    assert sorted(r.line for r in scanned.collect()) == sorted(r.line for r in whole.collect())
    good, bad = dump.decode_rows(scanned, {"k": "int", "v": "string"})
    assert sorted(map(tuple, good.collect()), key=lambda r: r[0]) == [(1, "a"), (2, None), (3, "NULL"), (4, "b"), (5, "c"), (6, "d"), (7, "é"), (8, "x y"), (9, "{1,2}"), (12, "a|~b"), (13, "it's\nno end")]
    assert sorted(map(tuple, bad.collect())) == [("10", "1 values for 2 columns"), ("11 a b", "3 values for 2 columns")]


def test_exact_profiles_deal_rows_evenly(spark, monkeypatch):
    """One file of few bytes and many rows isn't one task's: with ten rows a task, a hundred in one partition are dealt over ten."""
    monkeypatch.setattr(profile, "TASK_ROWS", 10, raising=False)
    rows = spark.range(0, 100, 1, 1).select("id", (F.col("id") % 7).cast("string").alias("word"), F.when(F.col("id") > 3, 5).alias("few"))
    got = profile.profile(rows, "t", exact=True)
    assert "RepartitionByExpression [xxhash64" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [("t", "few", 100, 4, "5", "5", 1), ("t", "id", 100, 0, "0", "99", 100), ("t", "word", 100, 0, "0", "6", 7)]
    assert [r["n"] for r in profile.profile(rows.where("false"), "t", exact=True).collect()] == [0, 0, 0]
