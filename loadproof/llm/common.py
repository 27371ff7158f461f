"""What the training-data operators share: reading a table, shared scratch tables, folds."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadproof.sources.scratch import shared_dir, stored  # noqa: F401 - shared by the operators

#: Rows in one Arrow batch; whole texts can be long, so batches are kept small.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as written; nothing is filtered or cut."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds what one Arrow batch holds in a Python worker, unless the user has set a lower bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def fold(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; null ids fall in no fold."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def py_fold(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def filter_texts(docs: DataFrame, text_col: str, start: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows whose text passes, with all columns as they are; start() makes a task's own test of a list of texts."""
    small_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_col)
    schema = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = start()
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(at).to_pylist()), pa.bool_()))

    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema).toDF(*names)
