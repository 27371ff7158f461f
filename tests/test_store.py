"""Row blocks cut by quote parity, literals by declared types, publishing, hash trees, sketches, layouts, large key checks."""

import random
import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loadproof.catalogue import QUERIES
from loadproof.functions.text import canonical
from loadproof.model import Edge
from loadproof.operators import graph, hashtree, keys, refs, sketches
from loadproof.sources import blocks, catalog, dump, sinks

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_rows_over_lines_and_splits(spark, tmp_path, split):
    """Whatever the splits, rows are those that one reader of the whole file finds."""
    rng = random.Random(split)
    parts, want = [], []
    for cls in ("a", "b", "c"):
        parts.append(f"%id [dba].[{cls}] 1\n%class [dba].[{cls}] ([id] [t])\n")
        for i in range(40):
            text = rng.choice(["plain", "it''s", "a\nb", "\n", "%class [x] ([y])", "line\n%class [no] ([n])\n% don''t\n\nend", "x" * 150, "''\n''", "{\n}"])
            parts.append(f"{i} '{text}'" + rng.choice(["\n", "\n\n", "\r\n"]))
            want.append((cls, i, text.replace("''", "'")))
    (tmp_path / "x_objects").write_bytes("".join(parts).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = dump.scan_objects(spark, str(tmp_path))
        got = dump.decode(rows, {"id": "int", "t": "string"}).select("source.cls", "row.*", "reason").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert not [r for r in got if r.reason]
    assert sorted((r.cls, r.id, r.t) for r in got) == sorted(want)


def test_groups_of_files_and_lost_quotes(spark, tmp_path, monkeypatch):
    for k in range(5):
        (tmp_path / f"f{k}_objects").write_text(f"%class [t] ([id] [t])\n{k} 'a\nb'\n")
    monkeypatch.setattr(blocks, "SENT_SPLITS", 2)
    rows = dump.scan_objects(spark, str(tmp_path))
    assert sorted(r.line for r in rows.collect()) == [f"{k} 'a\nb'" for k in range(5)]
    # a quote that is never closed: its row is refused, rows beyond the bound are read again
    (tmp_path / "lost").mkdir()
    (tmp_path / "lost" / "x_objects").write_text("%class [t] ([id] [t])\n1 'open\n" + "".join(f"{i} 'x'\n" for i in range(2, 400)))
    monkeypatch.setattr(blocks, "OPEN_BYTES", 500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    good, bad = dump.decode_rows(dump.scan_objects(spark, str(tmp_path / "lost")), {"id": "int", "t": "string"})
    ids, refused = {r.id for r in good.collect()}, bad.count()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert set(range(120, 400)) <= ids and refused >= 1
    assert dump.scan_objects(spark, str(tmp_path / "lost")).count() >= 1
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x_objects").write_text("1 2\n")
    assert dump.scan_objects(spark, str(tmp_path / "none")).count() == 0  # no header


def decoded(spark, lines, types):
    rows = dump.decode(spark.createDataFrame([(x,) for x in lines], "line string"), types).collect()
    return [tuple(r.row) if r.reason is None else r.reason for r in rows]


def test_literals_by_type(spark):
    types = {"q": "sequence<int>"}
    assert decoded(spark, ["{1,NULL,'3'}", "{}", "NULL", "{ 1 , 2 }"], types) == [([1, None, 3],), ([],), (None,), ([1, 2],)]
    wrong = ["{1,'x',3}", "{99999999999}", "{{1},{2}}", "{1 2}", "{1,}", "{,1}", "7", "'{1}'", "{1}{2}", "{1} {2}"]
    assert decoded(spark, wrong, types)[:8] == ["q: not a sequence<int>"] * 8
    assert decoded(spark, wrong, types)[8:] == ["2 values for 1 columns"] * 2
    nested = {"q": "sequence<sequence<int>>", "s": "set<string>", "m": "multiset<sequence<int>>"}
    assert decoded(spark, ["{{1,2},{},NULL} {'b','a','b'} {{2},{1},{2}}"], nested) == [([[1, 2], [], None], ["a", "b"], [[1], [2], [2]])]
    assert decoded(spark, ["{{1,'x'}} {} {}", "{1} {} {}", "{{{1}}} {} {}"], nested) == ["q: not a sequence<sequence<int>>"] * 3
    assert decoded(spark, ["12345.67", "12345.670", "12345.678", "123456.7", "1e3", "x"], {"d": "decimal(7,2)"})[2:4] == ["d: not a decimal(7,2)"] * 2
    assert decoded(spark, ["X'0aFF'", "B'1010101010101010'", "B'1'", "NULL", "'00'", "X'0g'"], {"b": "bit"}) == [(b"\x0a\xff",), (b"\xaa\xaa",), (b"\x80",), (None,), "b: not a bit", "b: not a bit"]
    assert decoded(spark, ["DATE'2020-02-29' N'x''y' TIMESTAMP'2020-02-29 23:59:59'"], {"d": "date", "n": "string", "t": "timestamp"})[0][1] == "x'y"
    assert decoded(spark, ["1 'a", "{1", "1}", "", "1 2 3"], {"a": "int", "b": "int"}) == ["an open quote or bracket"] * 3 + ["0 values for 2 columns", "3 values for 2 columns"]
    long = "x''" * 400_000
    assert decoded(spark, [f"'{long}' {{'{long}'}}"], {"t": "string", "s": "sequence<string>"}) == [(long.replace("''", "'"), [long.replace("''", "'")])]
    assert decoded(spark, ["{" * 100_000, "{1," * 50_000], types) == ["an open quote or bracket"] * 2


def test_lines_are_parsed_once(spark):
    rows = dump.decode(spark.createDataFrame([("1 2 3 4",)], "line string"), {c: "int" for c in "abcd"})
    assert logical(rows).count("MapInArrow") == 1 and "regexp" not in logical(rows)


def test_dump_keeps_all_types(spark, tmp_path):
    df = spark.sql("""SELECT 1 i, 'it''s\n%class\n\\{x}' t, X'00ff' b, array(array(1, NULL), array()) n, array('a,b', 'c}''d') s, DATE'2020-02-29' d, TIMESTAMP'2020-02-29 23:59:59.999' ts, -0.0D z, true yes, CAST(NULL AS STRING) e""")
    types = dict(df.dtypes) | {"b": "bit"}
    dump.dump_lines(df, "o", "t").write.text(str(tmp_path / "t"))
    good, bad = dump.decode_rows(dump.scan_objects(spark, str(tmp_path / "t")), types)
    assert bad.count() == 0 and good.collect() == df.collect()


def test_one_pass_load(spark, tmp_path):
    rows = spark.createDataFrame([("f", "1"), ("f", "x")], "file string, line string")
    with pytest.raises(sinks.LoadRejected, match="f, k: not a int"):
        sinks.load_decoded(dump.decode(rows, {"k": "int"}), str(tmp_path / "t"), file_col="file")
    with pytest.raises(ValueError, match="nothing is published"):
        sinks.read_table(spark, str(tmp_path / "t"))
    assert sinks.load_decoded(dump.decode(rows.limit(1), {"k": "int"}), str(tmp_path / "t")) == 1
    assert sinks.read_table(spark, str(tmp_path / "t")).collect()[0].k == 1


def test_one_of_two_loads_is_published(spark, tmp_path):
    target, none = str(tmp_path / "t"), spark.createDataFrame([], "reason string")

    def load(k):
        try:
            return sinks.load_table(spark.range(k, k + 1), none, target, base=0)
        except sinks.LoadConflict:
            return "told"

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(load, range(4)))
    assert sorted(map(str, got)) == ["1", "told", "told", "told"]
    assert sinks.read_table(spark, target).first()[0] == got.index(1)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 1  # the others left nothing
    assert load(9) == "told" and sinks.load_table(spark.range(5), none, target) == 5 and sinks.published_number(spark, target) == 2


def test_exceptions_keep_run_ids(spark, tmp_path):
    orphans = spark.createDataFrame([("e", "k", "v")], "edge string, child_key string, fk_values string")
    repairs = spark.createDataFrame([], "table string, name string, ddl string")
    for run in ("007", "7", "2020-01-01"):
        sinks.write_exceptions(orphans, repairs, str(tmp_path / "x"), run)
    assert sorted(r.run_id for r in sinks.read_exceptions(spark, str(tmp_path / "x")).collect()) == ["007", "2020-01-01", "7"]


def test_canonical_tells_all_apart(spark):
    one = lambda sql, zone="UTC": (spark.conf.set("spark.sql.session.timeZone", zone), spark.sql(f"SELECT {sql} AS c"))[1]
    text = lambda df: df.select(canonical(df)).first()[0]
    apart = [
        ("array(TIMESTAMP'2020-01-01 00:00:00.000001')", "array(TIMESTAMP'2020-01-01 00:00:00.000002')"), ("array('a', 'b')", "array('a1:b')"), ("array(array())", "array(NULL)"), ("array('1:a')", "array('a')"),
        ("struct(1 AS a, NULL AS b)", "CAST(NULL AS STRUCT<a: INT, b: VOID>)"), ("map('a', 'b')", "map('a1', 'b')"), ("array(1, 23)", "array(12, 3)"), ("struct('a' AS x, 'bc' AS y)", "struct('ab' AS x, 'c' AS y)"),
    ]
    for a, b in apart:
        assert text(one(a)) != text(one(b)), (a, b)
    same = [("array(0.0D)", "array(-0.0D)"), ("struct(0.0D AS a)", "struct(-0.0D AS a)"), ("map('a', 1, 'b', 2)", "map('b', 2, 'a', 1)")]
    for a, b in same:
        assert text(one(a)) == text(one(b)), (a, b)
    try:  # an hour that New York has twice, and one that it lacks
        for kind in ("timestamp_micros", "array(timestamp_micros"):
            end = ")" if kind.startswith("array") else ""
            hours = [text(one(f"{kind}({x}){end}", "America/New_York")) for x in (1730611800000000, 1730615400000000)]
            assert hours[0] != hours[1]
        gap = [text(one(f"TIMESTAMP_NTZ'2024-03-10 0{h}:30:00'", "America/New_York")) for h in (2, 3)]
        assert gap[0] != gap[1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hash_tree(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 7 % 13).alias("v"))
    other = df.where("k <> 17").withColumn("v", F.when(F.col("k") == 1000, -1).otherwise(F.col("v"))).union(spark.sql("SELECT 5000L, 1L"))
    for name, t in (("a", df), ("same", df.orderBy(F.desc("v")).repartition(3)), ("b", other), ("empty", df.where("false"))):
        hashtree.build_tree(t, ["k"], 3, str(tmp_path / name))
    at = lambda x: str(tmp_path / x)
    assert hashtree.unequal_buckets(spark, at("a"), at("same"), 3).count() == 0
    assert hashtree.read_tree(spark, at("a"), 0).count() == 1 and hashtree.read_tree(spark, at("a"), 0).first().n == 3000
    found = hashtree.unequal_buckets(spark, at("a"), at("b"), 3)
    assert found.count() == 3
    rows = hashtree.unequal_rows(df, other, ["k"], 3, found)
    assert sorted((r.k, r.v, r.side) for r in rows.collect()) == [(17, 17 * 7 % 13, "only_a"), (1000, -1, "only_b"), (1000, 1000 * 7 % 13, "only_a"), (5000, 1, "only_b")]
    assert hashtree.unequal_buckets(spark, at("empty"), at("empty"), 3).count() == 0
    assert {r.n_b for r in hashtree.unequal_buckets(spark, at("a"), at("empty"), 3).collect()} == {0}
    kept, hashtree.SENT = hashtree.SENT, 1  # more unequal nodes than may be sent
    assert hashtree.unequal_buckets(spark, at("a"), at("b"), 3).count() == 3
    hashtree.SENT = kept
    assert "lineitem" not in plan(hashtree.unequal_buckets(spark, at("a"), at("b"), 3))


def test_trees_of_published_versions(spark, tmp_path):
    none, a, b = spark.createDataFrame([], "reason string"), str(tmp_path / "a"), str(tmp_path / "b")
    for target in (a, b):
        sinks.load_table(spark.range(500), none, target)
    assert hashtree.compare_published(spark, a, b, ["id"], 2).count() == 0
    sinks.load_table(spark.range(501), none, b)
    tree = hashtree.published_tree(spark, a, ["id"], 2)
    built = (tmp_path / "a").joinpath(*tree.split("/")[-2:], "level=0").stat().st_mtime_ns
    found = hashtree.compare_published(spark, a, b, ["id"], 2)
    assert found.count() == 1 and found.select(F.col("n_b") - F.col("n_a")).first()[0] == 1
    assert (tmp_path / "a").joinpath(*tree.split("/")[-2:], "level=0").stat().st_mtime_ns == built  # not built again
    sinks.retire(spark, b)
    assert len([p for p in (tmp_path / "b").iterdir() if p.name.startswith("of-")]) == 1
    assert hashtree.compare_published(spark, a, b, ["id"], 2).count() == 1


def test_sketches_merge(spark, tmp_path):
    df = spark.range(200_000).select((F.col("id") % 50_000).alias("k"), (F.col("id") * F.col("id") % 100_003).cast("double").alias("x"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("s"), F.col("id") % 1000)).alias("s"))
    for k in range(4):
        sketches.write_statistics(sketches.version_statistics(df.where(F.col("k") % 4 == k), "t", f"v{k}"), str(tmp_path / "s"))
    sketches.write_statistics(sketches.version_statistics(df.where(F.col("k") % 4 == 1), "t", "v1"), str(tmp_path / "s"))  # again, in place of its own
    qs = [0.01, 0.25, 0.5, 0.9]
    got = {r.column: r for r in sketches.merged(sketches.read_statistics(spark, str(tmp_path / "s")), dict(df.dtypes), qs).collect()}
    assert all(r.n == 200_000 for r in got.values()) and got["s"].nulls == 50_000
    assert (got["k"].low, got["k"].high) == ("0", "49999") and got["s"].quantiles is None
    for c in ("k", "x", "s"):
        exact = df.select(F.countDistinct(c)).first()[0]
        assert abs(got[c].distinct_estimate - exact) <= 4 * sketches.DISTINCT_ERROR * exact
    for q, value in zip(qs, got["x"].quantiles, strict=True):
        assert abs(df.where(F.col("x") <= value).count() / 200_000 - q) <= sketches.RANK_ERROR
    empty = sketches.merged(sketches.version_statistics(df.where("false"), "t", "v"), dict(df.dtypes)).collect()
    assert {(r.n, r.distinct_estimate, r.quantiles) for r in empty} == {(0, 0, None)}


def files_read(path, col, low, high):
    """The share of files whose bounds a lookup can't exclude."""
    files = list(path.glob("*.parquet"))
    hit = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        i = meta.schema.names.index(col)
        bounds = [meta.row_group(g).column(i).statistics for g in range(meta.num_row_groups)]
        hit += any(s.min <= high and s.max >= low for s in bounds)
    return hit / len(files)


def test_z_order_skips_files_by_each_column(spark, tmp_path):
    df = spark.range(40_000).select((F.hash("id") % 5000).alias("a"), F.pow(F.pmod(F.hash("id", F.lit(1)), F.lit(100)), 2).cast("int").alias("b"), "id")
    sinks.write_zordered(df, ["a", "b"], str(tmp_path / "z"), 32)
    sinks.write_clustered(df, ["a", "b"], str(tmp_path / "c"), 32)
    for path, most_a, most_b in (("z", 0.5, 0.5), ("c", 0.1, 1)):
        assert files_read(tmp_path / path, "a", 100, 110) <= most_a and files_read(tmp_path / path, "b", 2500, 2600) <= most_b
    assert files_read(tmp_path / "c", "b", 2500, 2600) > 0.9  # clustering by one column tells nothing of the second
    z = spark.read.parquet(str(tmp_path / "z"))
    assert z.exceptAll(df).count() == df.exceptAll(z).count() == 0
    times = spark.sql("SELECT DATE'2020-01-01' + CAST(id AS INT) d, TIMESTAMP'2020-01-01' t, CAST(NULL AS INT) n FROM range(50)")
    sinks.write_zordered(times, ["d", "t", "n"], str(tmp_path / "t"), 4)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 50


def test_footers_alone(spark):
    df = sinks.footer_statistics(spark, f"{SF}/lineitem.parquet", ["l_orderkey", "l_linenumber"])
    shown = plan(df)
    assert "PushedAggregation: [COUNT(*), COUNT(l_orderkey), MIN(l_orderkey), MAX(l_orderkey)" in re.sub(r"\s+", " ", shown), shown
    assert "BatchScan" in shown
    with pytest.raises(ValueError, match="l_returnflag"):
        sinks.footer_statistics(spark, f"{SF}/lineitem.parquet", ["l_returnflag"])
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_bucketed_tables_meet_without_a_shuffle(spark):
    df = QUERIES["orphans_of_bucketed_tables"](spark, SF)
    df.collect()
    assert "Exchange" not in plan(df) and "SortMergeJoin" in plan(df)


def test_hot_keys_do_not_move(spark):
    child = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 10 == 1, -1).otherwise(F.col("id")).alias("k"), "id")
    parent = spark.range(0, 20_000, 3).select(F.col("id").alias("p")).union(spark.sql("SELECT 1L"))
    edge = Edge("e", "c", ("k",), "p", ("p",), ("id",))
    want = refs.orphan_rows(child, parent, edge)
    got = refs.orphans_with_hot_keys(child, parent, edge)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert {r[0] for r in refs.hot_keys(child, ["k"]).collect()} >= {1, -1}
    # what is dealt by key holds none of the hot keys' rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = refs.orphans_with_hot_keys(child, parent, edge)
    got.collect()
    shown = plan(got)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shown.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" in shown
    pair = Edge("e", "c", ("k", "id"), "p", ("p", "q"), ("id",))
    two = refs.orphans_with_hot_keys(child, parent.withColumn("q", F.col("p")), pair)
    assert two.count() == refs.orphan_rows(child, parent.withColumn("q", F.col("p")), pair).count()
    none = refs.orphans_with_hot_keys(child.where("false"), parent, edge)
    assert none.count() == 0


def test_all_keys_in_one_scan(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (1, None, "x"), (2, None, "z"), (None, 5, "z")], "a int, b int, c string")
    out = keys.all_key_violations(df, {"ab": ["a", "b"], "a": ["a"], "c": ["c"]})
    assert sorted(map(tuple, out.collect())) == [("a", "a=1", 3), ("ab", "a=1, b=1", 2), ("c", "c=x", 2), ("c", "c=z", 2)]
    lines = keys.all_key_violations(spark.read.parquet(f"{SF}/lineitem.parquet"), {"pk": ["l_orderkey", "l_linenumber"], "p": ["l_partkey"]})
    assert logical(lines).count("Relation") == 1
    with pytest.raises(ValueError, match="same columns"):
        keys.all_key_violations(df, {"x": ["a", "b"], "y": ["b", "a"]})


def test_recursive_depths(spark):
    pairs = [("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("x", "y"), ("y", "x"), ("e", "a"), ("f", "e"), ("e", "f"), ("g", "g")]
    got = graph.hierarchy_depths(spark.createDataFrame(pairs, "child string, parent string"))
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 1), ("f", 2)]
    assert graph.hierarchy_depths(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_catalog_by_jdbc(spark):
    """The frames of a database in memory, read by the same names as those of files."""
    url = {"url": "jdbc:derby:memory:catalog;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = {"classes": [("dba", "t", "CLASS", False), ("dba", "v", "VCLASS", False), ("dba", "s", "CLASS", True)], "index_keys": [("dba", "t", "pk", "b", 2), ("dba", "t", "pk", "a", 1)], "indexes": [("dba", "t", "pk", True, False, True)]}
    for name, schema in catalog.FRAMES.items():
        texts = ", ".join(f"{c.split()[0]} VARCHAR(100)" for c in schema.split(", ") if c.endswith("string"))
        spark.createDataFrame(rows.get(name, []), schema).write.format("jdbc").options(**url, dbtable=f"cat_{name}", createTableColumnTypes=texts).mode("overwrite").save()
    got = catalog.read_catalog(spark, "cat_", jdbc=url)
    assert {n: [f.name.lower() for f in df.schema] for n, df in got.items()} == {n: [c.split()[0] for c in s.split(", ")] for n, s in catalog.FRAMES.items()}
    assert [r["table"] for r in catalog.user_tables(got["classes"]).collect()] == ["t"]
    assert [tuple(r) for r in graph.index_columns(got["index_keys"]).collect()] == [("dba", "t", "pk", ["a", "b"])]


@pytest.mark.parametrize("shape", ["shallow", "cyclic", "deep"])
def test_levels_tried_before_cycles(spark, tmp_path, monkeypatch, shape):
    """The same levels as with cycles looked for first; rounds beyond those kept are folded and their copies deleted."""
    rng = random.Random(shape)
    if shape == "deep":
        pairs = [(f"n{i:02}", f"n{i - 1:02}", "fk") for i in range(1, 24)] + [("side", "n05", "fk"), ("n20", "n03", "inherits")]
        monkeypatch.setattr(graph, "KEPT_ROUNDS", 3)
    else:
        back = 0.5 if shape == "cyclic" else 0
        pairs = [(f"n{max(a, b)}", f"n{min(a, b)}", rng.choice(["fk", "inherits"])) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(25)) if a != b]
        pairs += [(b, a, "fk") for a, b, _ in pairs if rng.random() < back]
    edges = spark.createDataFrame(pairs, "child string, parent string, kind string")
    nodes = spark.createDataFrame([(x,) for x in {n for p in pairs for n in p[:2]} | {"alone"}], "node string")
    kept = {tuple(r) for r in graph.precedence(edges, graph.cyclic_nodes(edges), nodes).select("child", "parent").collect()}

    def level(node, path=()):
        if node in path:
            return None
        above = [level(p, (*path, node)) for c, p in kept if c == node]
        return None if None in above else max((x + 1 for x in above), default=0)

    want = {r.node: level(r.node) for r in nodes.collect()}
    assert {r.node: r.level for r in graph.dependency_levels(nodes, edges).collect()} == want
    assert want["alone"] == 0 and (shape != "deep" or want["n23"] == 23)
