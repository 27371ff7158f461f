"""Relational dumps as tables: rosters of files, repair statements, lines of a table; rows are in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadproof.sources.blocks import decode, decode_rows, scan_objects  # noqa: F401 - a dump's rows

#: File-name endings and the roles they mean, longest first.
ROLES = (
    ("_schema_class", "schema_class"),
    ("_schema_info", "schema_info"),
    ("_schema_pk", "schema_pk"),
    ("_schema_uk", "schema_uk"),
    ("_schema_fk", "schema_fk"),
    ("_schema", "schema"),
    ("_indexes", "indexes"),
    ("_trigger", "trigger"),
    ("_objects", "objects"),
)
#: Roles that can name a dump's prefix, strongest first.
ANCHORS = ("schema_info", "schema_class", "schema", "indexes", "trigger", "objects")


def scan_roster(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file below path: dump (directory), base, role, prefix, owner, cls, length, modified.

    The prefix of a dump is the stem of its strongest anchor, the least stem if several tie; an
    objects file counts as one only without a dot. Only names and sizes are read, never contents; files
    of no bytes are not listed (an empty table has a header line).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    named = files.select("length", "modified", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dump"), F.regexp_extract("path", r"([^/]*)$", 1).alias("base"), "path")
    role = stem = None
    for ending, name in ROLES:
        hit, cut = F.col("base").endswith(ending), F.expr(f"left(base, greatest(length(base) - {len(ending)}, 0))")
        role = F.when(hit, name) if role is None else role.when(hit, name)
        stem = F.when(hit, cut) if stem is None else stem.when(hit, cut)
    known = named.withColumns({"role": role.otherwise("other"), "stem": stem})
    rank = F.array_position(F.array(*[F.lit(a) for a in ANCHORS]), F.col("role"))
    anchor = known.where((rank > 0) & ((F.col("role") != "objects") | ~F.col("stem").contains("."))).groupBy("dump").agg(F.min_by("stem", F.struct(rank, "stem")).alias("prefix"))
    out = known.join(anchor, "dump", "left")
    own = (F.col("role") == "objects") & F.col("stem").startswith(F.concat("prefix", F.lit("_"))) & F.col("stem").contains(".")
    name = F.when(own, F.substr("stem", F.length("prefix") + 2))
    cls = F.lower(F.substring_index(name, ".", -1))
    return out.select("dump", "path", "base", "role", "prefix", F.lower(F.substr(name, F.lit(1), F.length(name) - F.length(cls) - 1)).alias("owner"), cls.alias("cls"), "length", "modified", "stem")


def roster_status(roster: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(dump, layout, status, detail): what is wrong with each dump, first rule that applies.

    listed: (dump, base) of files that the `_schema_info` files name.
    """
    if listed is None:
        listed = roster.where("false").select("dump", "base")
    absent = listed.join(roster.select("dump", "base"), ["dump", "base"], "left_anti").groupBy("dump").agg(F.min("base").alias("absent"))
    foreign = F.min(F.when((F.col("role") != "other") & ~F.col("base").startswith(F.concat("prefix", F.lit("_"))), F.col("base")))
    has = lambda *roles: F.bool_or(F.col("role").isin(*roles))
    facts = roster.groupBy("dump").agg(
        F.min("prefix").alias("prefix"), has("schema", "schema_class").alias("schema"), has("objects").alias("objects"), foreign.alias("foreign"), F.bool_or(F.col("cls").isNotNull()).alias("per_class")
    )
    rules = (
        (F.col("prefix").isNull(), "no dump", F.lit("")),
        (~F.col("schema"), "no schema", F.col("prefix")),
        (F.col("absent").isNotNull(), "listed file missing", F.col("absent")),
        (F.col("foreign").isNotNull(), "foreign prefix", F.col("foreign")),
        (~F.col("objects"), "no objects", F.col("prefix")),
    )
    status = detail = None
    for when, name, what in rules:
        status = F.when(when, name) if status is None else status.when(when, name)
        detail = F.when(when, what) if detail is None else detail.when(when, what)
    return facts.join(absent, "dump", "left").select("dump", F.when(F.col("per_class"), "PER_CLASS").otherwise("SINGLE").alias("layout"), status.otherwise("ok").alias("status"), detail.otherwise("").alias("detail"))


def listed_files(spark: SparkSession, roster: DataFrame) -> DataFrame:
    """(dump, base) of the files that the roster's `_schema_info` files name, one a line."""
    paths = [r[0] for r in roster.where("role = 'schema_info'").select("path").collect()]  # one for each dump
    if not paths:
        return roster.where("false").select("dump", "base")
    lines = spark.read.text(paths).select(F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1).alias("dump"), F.trim("value").alias("base"))
    return lines.where("base <> ''")


def scan_statements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, ord, table, name, kind, ddl): constraints that schema texts add, cut at semicolons.

    The table is the last bracketed name before ` ADD `; a semicolon inside a literal cuts too, and
    what is lost so shows when constraints are matched to statements.
    """
    raw = spark.read.option("lineSep", ";").text(paths).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("ord"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("ddl"))
    before = F.regexp_extract("ddl", r"(?i)^((?:[^\[ ]++|\[[^\]]*+\]| (?!ADD ))*+) ADD ", 1)
    table = F.lower(F.regexp_extract(before, r"\[([^\]]*)\][^\[\]]*$", 1))
    found = F.regexp_extract_all("ddl", F.lit(r"(?i)CONSTRAINT \[([^\]]*)\] (?:PRIMARY KEY|UNIQUE|FOREIGN KEY)"), F.lit(1))
    kinds = F.regexp_extract_all("ddl", F.lit(r"(?i)CONSTRAINT \[[^\]]*\] (PRIMARY KEY|UNIQUE|FOREIGN KEY)"), F.lit(1))
    each = raw.where(before != "").select("file", "ord", table.alias("table"), F.explode(F.arrays_zip(found.alias("name"), kinds.alias("kind"))).alias("c"), "ddl")
    return each.select("file", "ord", "table", F.lower("c.name").alias("name"), F.upper("c.kind").alias("kind"), "ddl")


def size_profile(roster: DataFrame) -> DataFrame:
    """(dump, cls, bytes, largest, share) of object files: which tables dominate and which may be sent to all."""
    own = roster.where("role = 'objects'").groupBy("dump", "cls").agg(F.sum("length").alias("bytes"), F.max("length").alias("largest"))
    return own.withColumn("share", F.col("largest") / F.sum("bytes").over(Window.partitionBy("dump")))


def dump_lines(df: DataFrame, owner: str, cls: str) -> DataFrame:
    """The rows of a table as lines of an objects file, each partition led by its header.

    Texts and times are quoted, numbers bare, binary is X'..', arrays of any depth are collections. Line breaks in texts stay as they are.
    """

    def text(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            out = F.concat(F.lit("{"), F.array_join(F.transform(c, lambda x: text(x, kind.elementType)), ","), F.lit("}"))
        elif isinstance(kind, T.BinaryType):
            out = F.concat(F.lit("X'"), F.hex(c), F.lit("'"))
        elif isinstance(kind, T.NumericType):
            out = c.cast("string")
        else:
            out = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(out, F.lit("NULL"))

    header = f"%class [{owner}].[{cls}] ({' '.join(f'[{c}]' for c in df.columns)})"
    line = F.concat_ws(" ", *[text(F.col(f"`{f.name}`"), f.dataType) for f in df.schema])
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return df.select(F.concat(F.when(first, header + "\n").otherwise(""), line).alias("value"))


def load_set(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """Files (cls, ..) less those of skipped tables (table), whatever their case."""
    return files.join(skipped.select(F.lower("table").alias("_skip")).distinct(), F.lower("cls") == F.col("_skip"), "left_anti")


def tables_without_file(tables: DataFrame, files: DataFrame) -> DataFrame:
    """Tables (table, ..) for which there is no file (cls); an empty table has one too."""
    return tables.join(files.select(F.lower("cls").alias("_cls")).distinct(), F.lower("table") == F.col("_cls"), "left_anti")
