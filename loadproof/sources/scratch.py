"""The folder that driver and executors share, for cutting lineage and publishing tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's own folder, from spark.checkpoint.dir; a folder of ours only where one machine is all there is."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", folder := tempfile.mkdtemp(prefix="spark-loadproof-", dir="/tmp"))
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loadproof-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def until_exit(spark: SparkSession, path: str) -> None:
    """Has a table that only this application reads deleted when the application ends."""
    files, target = _files(spark, path)
    files.deleteOnExit(target)


def remove(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    files.delete(target, True)


def rename_parts(spark: SparkSession, source: str, name_of: Callable[[str], str]) -> None:
    """Renames each part file below a folder that Spark wrote to the path that name_of gives for its own; for few, large files."""
    files, top = _files(spark, source)
    found, parts = files.listFiles(top, True), []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().startswith("part-"):
            parts.append(path)
    for part in parts:
        _, target = _files(spark, name_of(part.toString()))
        files.mkdirs(target.getParent())
        if not files.rename(part, target):
            raise OSError(f"{part.toString()} can't be renamed to {target.toString()}")


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless one of that name exists; of several callers one gets True.

    The text is written under another name first, so that no reader sees it in part, and then given its name: by a rename, which
    Hadoop's file systems refuse if the name is taken, or by a link where the file system is a local one, whose rename would replace.
    """
    files, target = _files(spark, path)
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{target.getParent()}/.{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if files.getScheme() != "file":
        if done := files.rename(draft, target):
            return done
        files.delete(draft, False)
        return False
    local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
    try:
        jvm.java.nio.file.Files.createLink(local(target), local(draft))
        return True
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    finally:
        files.delete(draft, False)


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage: written to the shared folder and read again; the copy goes when the application ends."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark))
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the copy behind a frame that stored gave, once nothing lazily evaluated reads it any more; a loop's rounds would else add up."""
    remove(df.sparkSession, df.stored_at)
