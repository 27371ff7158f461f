"""Queries of whole dumps, of published versions and their statistics, of file layouts and of large key checks, with their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadproof.functions.text import human_bytes, utc_text
from loadproof.model import Edge
from loadproof.operators import graph, hashtree, keys, profile, refs, sketches
from loadproof.registry import query, read
from loadproof.sources import dump, sinks
from loadproof.sources.scratch import new_path, rename_parts, until_exit


def _dumped(spark: SparkSession, df: DataFrame, cls: str) -> str:
    dump.dump_lines(df, "dba", cls).write.text(files := new_path(spark))
    until_exit(spark, files)
    return files


@query("SELECT * FROM documents")
def documents_through_dump(spark, d):
    """Texts with line breaks, quotes and braces, written as dump text, scanned, decoded, loaded and read back."""
    docs = read(spark, d, "documents")
    rows = dump.scan_objects(spark, _dumped(spark, docs, "documents"), ["file", "cls", "line"]).where("cls = 'documents'")
    sinks.load_decoded(dump.decode(rows.select("file", "line"), dict(docs.dtypes)), target := new_path(spark), file_col="file")
    until_exit(spark, target)
    return sinks.read_table(spark, target)


@query("""SELECT vec_id, [embedding, embedding[1:2]] nested, list_sort(list_distinct(list_transform(embedding, lambda x: CAST(floor(x * 4) AS INTEGER)))) kinds FROM embeddings""")
def nested_collections_through_dump(spark, d):
    """Vectors as sequences of sequences, and as sets of integers, through dump text."""
    rows = read(spark, d, "embeddings").select("vec_id", F.array("embedding", F.slice("embedding", 1, 2)).alias("nested"), F.transform("embedding", lambda x: F.floor(x * 4).cast("int")).alias("kinds"))
    scanned = dump.scan_objects(spark, _dumped(spark, rows, "embeddings"), ["line"])
    good, _ = dump.decode_rows(scanned, {"vec_id": "bigint", "nested": "sequence<sequence<float>>", "kinds": "set<int>"})
    return good


@query("""SELECT conv_id, turn, concat_ws('; ', CASE WHEN turn % 3 = 1 THEN 'members: not a sequence<int>' END, CASE WHEN conv_id % 7 = 0 THEN 'amount: not a decimal(7,2)' END) reason FROM conversations WHERE turn % 3 = 1 OR conv_id % 7 = 0""")
def collection_rejects(spark, d):
    """Members that are no integers, of every third turn in a way of their own, and amounts with a digit too many: refused, not coerced."""
    turn, conv = F.col("turn"), F.col("conv_id")
    bad = F.when(conv % 3 == 0, "{1,'x',3}").when(conv % 3 == 1, "{1 2}").otherwise("{99999999999,{1}}")
    members = F.when(turn % 3 == 1, bad).otherwise("{1,NULL,'3'}")
    line = F.concat_ws(" ", conv.cast("string"), turn.cast("string"), members, F.when(conv % 7 == 0, "12345.678").otherwise("12345.670"))
    text = F.concat(F.lit("%class [c] ([conv_id] [turn] [members] [amount])\n"), line)
    read(spark, d, "conversations").select(text.alias("value")).write.text(files := new_path(spark))
    until_exit(spark, files)
    _, refused = dump.decode_rows(dump.scan_objects(spark, files), {"conv_id": "bigint", "turn": "bigint", "members": "sequence<int>", "amount": "decimal(7,2)"})
    place = lambda i: F.split("line", " ")[i].cast("bigint")
    return refused.select(place(0).alias("conv_id"), place(1).alias("turn"), "reason")


#: Customers by nation stand for tables; nations are dealt to three dumps, one whole, one without a listed file, one with a file of another's prefix.
_DUMPS = """f AS (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'whole' WHEN 1 THEN 'short' ELSE 'mixed' END dump, 'c' || c_nationkey cls, c_nationkey = 2 odd, sum(strlen(c_custkey || ' ''' || c_name || '''') + 1) AS bytes FROM customer GROUP BY c_nationkey)"""


def _roster(spark: SparkSession, d: str) -> DataFrame:
    """The dumps written, their files named as a dump's are, and scanned."""
    written, at = new_path(spark), new_path(spark)
    for path in (written, at):
        until_exit(spark, path)
    nation = F.col("c_nationkey")
    own = F.when(nation % 3 == 0, "whole").when(nation % 3 == 1, "short").otherwise("mixed")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(" '"), "c_name", F.lit("'"))
    base = F.concat(F.when(nation == 2, "odd").otherwise("demo"), F.lit("_dba.c"), nation, F.lit("_objects"))
    rows = read(spark, d, "customer").select(line.alias("value"), own.alias("dump"), base.alias("base")).repartition("dump", "base")
    lists = {"whole": ["demo_schema"], "short": ["demo_schema", "demo_lost_objects"], "mixed": ["demo_schema"]}
    few = [("CREATE CLASS [dba].[c0];", k, "demo_schema") for k in lists] + [(x, k, "demo_schema_info") for k, names in lists.items() for x in names]
    rows.union(spark.createDataFrame(few, "value string, dump string, base string").repartition(1)).write.partitionBy("dump", "base").text(written)
    rename_parts(spark, written, lambda part: re.sub(r".*/dump=([^/]*)/base=([^/]*)/[^/]*$", rf"{at}/\1/\2", part))
    return dump.scan_roster(spark, at)


def _short():
    return F.regexp_extract("dump", r"([^/]*)$", 1)


@query(f"""WITH {_DUMPS} SELECT dump, CASE WHEN odd THEN 'odd' ELSE 'demo' END || '_dba.' || cls || '_objects' base, 'objects' AS role, 'demo' prefix, CASE WHEN NOT odd THEN 'dba' END AS "owner", CASE WHEN NOT odd THEN cls END cls FROM f
UNION ALL SELECT d, 'demo_' || r, r, 'demo', NULL, NULL FROM (VALUES ('whole'), ('short'), ('mixed')) x(d), (VALUES ('schema'), ('schema_info')) y(r)""")
def dump_roster(spark, d):
    return _roster(spark, d).select(_short().alias("dump"), "base", "role", "prefix", "owner", "cls")


@query(f"""WITH {_DUMPS} SELECT d dump, CASE WHEN EXISTS (SELECT 1 FROM f WHERE dump = d AND NOT odd) THEN 'PER_CLASS' ELSE 'SINGLE' END layout,
CASE WHEN d = 'short' THEN 'listed file missing' WHEN EXISTS (SELECT 1 FROM f WHERE dump = d AND odd) THEN 'foreign prefix' WHEN NOT EXISTS (SELECT 1 FROM f WHERE dump = d) THEN 'no objects' ELSE 'ok' END status,
CASE WHEN d = 'short' THEN 'demo_lost_objects' WHEN EXISTS (SELECT 1 FROM f WHERE dump = d AND odd) THEN 'odd_dba.c2_objects' WHEN NOT EXISTS (SELECT 1 FROM f WHERE dump = d) THEN 'demo' ELSE '' END detail FROM (VALUES ('whole'), ('short'), ('mixed')) x(d)""")
def dump_roster_status(spark, d):
    roster = _roster(spark, d)
    return dump.roster_status(roster, dump.listed_files(spark, roster)).withColumn("dump", _short())


@query(f"""WITH {_DUMPS} SELECT cls, CAST(bytes AS BIGINT) AS bytes, round(bytes / sum(bytes) OVER (), 9) share FROM f WHERE dump = 'whole'""")
def dump_size_profile(spark, d):
    """Bytes of each table's file in a whole dump and their share, by the files' length alone."""
    sizes = dump.size_profile(_roster(spark, d).where(F.col("dump").endswith("/whole")))
    return sizes.select("cls", "bytes", F.round("share", 9).alias("share"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') utc, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN format('{:,.1f}', b / 1024.0) || ' KiB' ELSE format('{:,.1f}', b / 1048576.0) || ' MiB' END size_text
FROM (SELECT *, CAST(o_custkey * 512 AS BIGINT) b FROM orders)""")
def utc_and_sizes_as_text(spark, d):
    orders = read(spark, d, "orders")
    return orders.select("o_orderkey", utc_text(F.col("o_orderdate").cast("timestamp")).alias("utc"), human_bytes(F.col("o_custkey") * 512).alias("size_text"))


@query("""SELECT p_brand "table", count(*) n, row_number() OVER (ORDER BY p_brand) AS "order" FROM part GROUP BY p_brand""")
def tables_in_name_order(spark, d):
    """Brands stand for tables: an order by name that does not depend on how they are listed."""
    return profile.name_order(read(spark, d, "part").groupBy(F.col("p_brand").alias("table")).agg(F.count("*").alias("n")), "table")


#: Depth of the hash trees: 256 buckets, enough for the tables given.
_DEPTH = 2
_CHANGED = "l_orderkey % 97 = 3 AND l_linenumber = 1"


@query(f"""WITH l AS (SELECT *, md5(strlen(CAST(l_orderkey AS VARCHAR)) || ':' || l_orderkey) h FROM lineitem), b AS (SELECT *, CAST('0x' || substr(h, 1, 15) AS BIGINT) % {hashtree.FAN**_DEPTH} bucket FROM l),
w AS (SELECT DISTINCT bucket FROM b WHERE {_CHANGED} OR l_orderkey % 101 = 7)
SELECT bucket, count(*) n_a, count(*) FILTER (l_orderkey % 101 <> 7) n_b FROM b WHERE bucket IN (SELECT bucket FROM w) GROUP BY bucket""")
def hash_tree_difference(spark, d):
    """Two versions of a table, one with changed values and lost orders: the buckets that differ, found from the root down, without a row of either."""
    lines, paths = read(spark, d, "lineitem"), [new_path(spark), new_path(spark)]
    changed = F.when(F.expr(_CHANGED), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    for version, path in zip((lines, lines.where("l_orderkey % 101 <> 7").withColumn("l_quantity", changed)), paths, strict=True):
        hashtree.build_tree(version, ["l_orderkey"], _DEPTH, path)
        until_exit(spark, path)
    return hashtree.unequal_buckets(spark, *paths, _DEPTH)


_STATED = ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag"]


@query(" UNION ALL ".join(f"""SELECT 'lineitem' "table", '{c}' "column", count(*) n, count(*) FILTER ({c} IS NULL) nulls, CAST(min({c}) AS VARCHAR) low, CAST(max({c}) AS VARCHAR) high, true distinct_ok, true median_ok FROM lineitem""" for c in _STATED))
def merged_version_statistics(spark, d):
    """Each year's lines are a version with statistics of its own; merged, counts and bounds are exact and estimates within their stated errors (four standard errors for distinct values)."""
    lines = read(spark, d, "lineitem")
    path = new_path(spark)
    until_exit(spark, path)
    # one version for each remainder of the order: as three loads would give
    for k in range(3):
        sketches.write_statistics(sketches.version_statistics(lines.where(F.col("l_orderkey") % 3 == k), "lineitem", f"v{k}", _STATED), path)
    kinds = {c: dict(lines.dtypes)[c] for c in _STATED}
    found = sketches.merged(sketches.read_statistics(spark, path), kinds)
    # exact values for the comparison alone
    exact = lines.agg(*[F.countDistinct(c).alias(f"d_{c}") for c in _STATED])
    near = {c: F.abs(F.col("distinct_estimate") - F.col(f"d_{c}")) <= F.greatest(F.lit(1), 4 * sketches.DISTINCT_ERROR * F.col(f"d_{c}")) for c in _STATED}
    numbers = [c for c in _STATED if kinds[c] != "string"]
    middle = found.where(F.col("column").isin(numbers)).groupBy().pivot("column", numbers).agg(F.first(F.col("quantiles")[0]))
    ranks = lines.join(F.broadcast(middle.toDF(*[f"m_{c}" for c in numbers]))).agg(F.count("*").alias("rows"), *[x for c in numbers for x in (F.count_if(F.col(c) < F.col(f"m_{c}")).alias(f"b_{c}"), F.count_if(F.col(c) <= F.col(f"m_{c}")).alias(f"a_{c}"))])
    within = {c: (F.col(f"b_{c}") <= F.col("rows") * (0.5 + sketches.RANK_ERROR)) & (F.col(f"a_{c}") >= F.col("rows") * (0.5 - sketches.RANK_ERROR)) for c in numbers}
    pick = lambda of, rest: F.coalesce(*[F.when(F.col("column") == c, x) for c, x in of.items()], rest)
    return found.join(F.broadcast(exact)).join(F.broadcast(ranks)).select("table", "column", "n", "nulls", "low", "high", pick(near, F.lit(False)).alias("distinct_ok"), pick(within, F.col("quantiles").isNull()).alias("median_ok"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey BETWEEN 3 AND 5")
def zordered_lookup(spark, d):
    """Lines clustered by part and supplier at once, looked up by the second alone."""
    sinks.write_zordered(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], path := new_path(spark), files=32)
    until_exit(spark, path)
    return spark.read.parquet(path).where("l_suppkey BETWEEN 3 AND 5")


_BOUNDS = {"lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_nationkey"], "part": ["p_partkey", "p_size"]}


def _footer_sql(t: str, c: str) -> str:
    return f"SELECT '{t}' \"table\", '{c}' \"column\", count(*) n, count({c}) present, CAST(min({c}) AS BIGINT) low, CAST(max({c}) AS BIGINT) high FROM {t}"


@query(" UNION ALL ".join(_footer_sql(t, c) for t, cols in _BOUNDS.items() for c in cols))
def footer_bounds(spark, d):
    """Counts and bounds of key columns from the files' footers alone."""
    out = None
    for t, cols in _BOUNDS.items():
        one = sinks.footer_statistics(spark, f"{d}/{t}.parquet", cols)
        each = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("column"), F.col("n"), F.col(f"{c}_n").alias("present"), F.col(f"{c}_low").cast("long").alias("low"), F.col(f"{c}_high").cast("long").alias("high")) for c in cols]))
        # a few numbers of one row a table, brought to the caller's session
        rows = one.select(each.alias("x")).select("x.*")
        here = spark.createDataFrame(rows.collect(), rows.schema)
        out = here if out is None else out.unionByName(here)
    return out


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey child, 'r' || n_regionkey parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
w AS (SELECT DISTINCT parent node, 0 AS depth FROM e WHERE parent NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node) SELECT node, max(depth) AS depth FROM w GROUP BY node""")
def hierarchy_depths(spark, d):
    """Regions, nations, customers and suppliers, their depths by one recursive query."""
    pair = lambda t, a, c, b, p: read(spark, d, t).select(F.concat(F.lit(a), c).alias("child"), F.concat(F.lit(b), p).alias("parent"))
    edges = pair("nation", "n", "n_nationkey", "r", "n_regionkey").union(pair("customer", "c", "c_custkey", "n", "c_nationkey")).union(pair("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    return graph.hierarchy_depths(edges)


_LINE_ORDER = Edge("lineitem_orders", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",), ("l_orderkey", "l_linenumber"))
_LOST = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey = l_orderkey)"


@query(_LOST)
def orphans_of_bucketed_tables(spark, d):
    """Both tables saved in buckets of the key, as a load would leave them, then checked without a shuffle."""
    names = [f"loadproof_{uuid.uuid4().hex}" for _ in range(2)]
    sinks.write_bucketed(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], 16, names[0])
    sinks.write_bucketed(read(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey"), ["o_orderkey"], 16, names[1])
    return refs.bucketed_orphans(spark, *names, _LINE_ORDER)


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 5 WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN -1 ELSE user_id END k FROM events)
SELECT event_id, k FROM e WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey = k)""")
def orphans_with_hot_keys(spark, d):
    """Events a third of which name one customer, and a sixth one that is none."""
    i = F.col("event_id")
    events = read(spark, d, "events").select("event_id", F.when(i % 3 == 0, 5).when((i % 3 == 1) & (i % 2 == 0), -1).otherwise(F.col("user_id")).cast("long").alias("k"))
    return refs.orphans_with_hot_keys(events, read(spark, d, "customer").where("c_mktsegment <> 'BUILDING'"), Edge("events_customer", "events", ("k",), "customer", ("c_custkey",), ("event_id",)))


@query("""SELECT 'pk' AS name, 'l_orderkey=' || l_orderkey || ', l_linenumber=' || l_linenumber "key", count(*) n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'by_part', 'l_partkey=' || l_partkey || ', l_suppkey=' || l_suppkey, count(*) FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1
UNION ALL SELECT 'by_day', 'l_orderkey=' || l_orderkey || ', l_shipdate=' || l_shipdate, count(*) FROM lineitem GROUP BY l_orderkey, l_shipdate HAVING count(*) > 1""")
def all_keys_in_one_scan(spark, d):
    return keys.all_key_violations(read(spark, d, "lineitem"), {"pk": ["l_orderkey", "l_linenumber"], "by_part": ["l_partkey", "l_suppkey"], "by_day": ["l_orderkey", "l_shipdate"]})


@query("SELECT o_orderkey, 'refused' AS second_load FROM orders WHERE o_orderstatus = 'F'")
def publish_of_two_loads(spark, d):
    """Two loads begin on one version: the first is published, the second is told and leaves nothing."""
    orders, none = read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), spark.createDataFrame([], "reason string")
    target = new_path(spark)
    until_exit(spark, target)
    base = sinks.published_number(spark, target)
    sinks.load_table(orders.where("o_orderstatus = 'F'"), none, target, base=base)
    try:
        sinks.load_table(orders.where("o_orderstatus = 'O'"), none, target, base=base)
        second = "published"
    except sinks.LoadConflict:
        second = "refused"
    return sinks.read_table(spark, target).select("o_orderkey", F.lit(second).alias("second_load"))
