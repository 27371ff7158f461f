"""Intake operators on small frames: nulls, cycles, policies, dumps, loads."""

import pytest
from pyspark.sql import functions as F

from loadproof.functions.text import human_bytes, render_key, split_qualified
from loadproof.model import Edge
from loadproof.operators import cast, compare, graph, keys, profile, refs
from loadproof.plans import ledger, policy, report
from loadproof.sources import blocks, catalog, dump, sinks


def values(df, *cols):
    rows = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(rows, key=lambda r: [(v is not None, v if v is not None else 0) for v in r])


def test_edges_pair_up():
    with pytest.raises(ValueError, match="pair"):
        Edge("e", "a", ("x", "y"), "b", ("x",))


def test_orphans_by_policy(spark):
    parent = spark.range(1, 11).toDF("id")
    c1 = spark.createDataFrame([(1, 1), (2, None), (21, 777), (22, 778)], "cid long, pid long")
    c2 = spark.createDataFrame([(1, 3), (16, 888)], "cid long, pid long")
    edges = [Edge("fk1", "c1", ("pid",), "p", ("id",), ("cid",)), Edge("fk2", "c2", ("pid",), "p", ("id",), ())]
    orphans = refs.check_edges({"c1": c1, "c2": c2, "p": parent}, edges)
    assert values(orphans, "edge", "child_key", "fk_values") == [("fk1", "cid=21", "pid=777"), ("fk1", "cid=22", "pid=778"), ("fk2", "(no pk)", "pid=888")]
    counted = refs.edge_results(orphans, spark.createDataFrame([("fk1",), ("fk2",), ("fk3",)], "edge string"))
    assert values(counted) == [("fk1", 2, True), ("fk2", 1, True), ("fk3", 0, False)]
    fixed = refs.repair_drop_orphans(c1, parent, edges[0])
    assert values(fixed, "cid") == [(1,), (2,)] and refs.fk_orphans(fixed, parent, edges[0]).isEmpty()
    todo = counted.select(F.lit("r").alias("run_id"), F.col("edge").alias("ord"), F.lit("ALTER").alias("ddl"), F.lit(None).cast("string").alias("withheld_reason"), F.lit(False).alias("present"), "orphans")
    assert values(policy.decide_edges(todo), "ord", "outcome") == [("fk1", "violated"), ("fk2", "not_attempted"), ("fk3", "not_attempted")]
    assert values(policy.decide_edges(todo, "continue"), "ord", "outcome") == [("fk1", "violated"), ("fk2", "violated"), ("fk3", "defined")]


def test_multi_edge_equals_single(spark):
    child = spark.createDataFrame([(1, 1, None), (2, 9, 2), (2, 9, 7), (3, None, 7)], "k long, a long, b long")
    parents = {"p": spark.range(1, 4).toDF("id"), "q": spark.range(1, 3).toDF("id")}
    edges = [Edge("ea", "c", ("a",), "p", ("id",)), Edge("eb", "c", ("b",), "q", ("id",))]
    assert values(refs.fk_check_multi(child, parents, edges)) == [("ea", 3, 2), ("eb", 3, 2)]


def test_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k long, v string")
    assert values(keys.pk_violations(df, ["k"])) == [("duplicate", "k=1", 2), ("null", "k=NULL", 1)]
    assert values(keys.unique_violations(df, ["k"])) == [(1, 2)]
    kept, removed = keys.dedup_repair(df.where("k IS NOT NULL"), ["k"])
    assert values(kept) == [(1, "a"), (2, "d")] and values(removed, "v") == [("b",)]
    assert keys.serial_check(df, "k", spark.createDataFrame([(1,)], "current long")).first()["ok"] is False
    assert keys.serial_check(df.where("false"), "k", spark.createDataFrame([(1,)], "current long")).first()["ok"] is True


def test_levels_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "fk"), ("b", "c", "fk"), ("b", "d", "fk"), ("c", "a", "fk"), ("d", "c", "fk"), ("s", "s", "fk"), ("z", "a", "fk")], "child string, parent string, kind string")
    assert values(graph.cyclic_nodes(edges)) == [("a",), ("b",), ("c",), ("d",), ("s",)]
    assert values(graph.cycles(edges)) == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("s", "s")]
    nodes = spark.createDataFrame([(x,) for x in "abcdsz"], "node string")
    kept = graph.precedence(edges, graph.cyclic_nodes(edges), nodes)
    levels = graph.level_sets(nodes, kept)
    assert values(levels) == [("a", 0), ("b", 0), ("c", 0), ("d", 0), ("s", 0), ("z", 1)]
    assert graph.check_levels(levels, kept).isEmpty()
    stuck = graph.level_sets(nodes, edges)
    assert {r["node"]: r["level"] for r in stuck.collect()} == dict.fromkeys("abcdsz")
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "child string, parent string")
    assert graph.ancestors(chain).count() == 45
    assert graph.level_sets(nodes.where("false"), edges).isEmpty()


def test_mapping_and_inheritance(spark):
    index_keys = spark.createDataFrame([("c", "fk1", "x", 4), ("c", "fk1", "y", 9), ("p", "pk1", "b", 1), ("p", "pk1", "a", 0), ("c", "fk2", "z", 0)], "table string, index string, column string, key_order int")
    indexes = spark.createDataFrame([("p", "pk1", True)], "table string, index string, is_primary_key boolean")
    references = spark.createDataFrame([("c", "fk1", "p"), ("c", "fk2", "p")], "table string, constraint string, parent string")
    got = {r["name"]: (r["child_columns"], r["parent_columns"], r["paired"]) for r in graph.resolve_edges(references, index_keys, indexes).collect()}
    assert got == {"fk1": (["x", "y"], ["a", "b"], True), "fk2": (["z"], ["a", "b"], False)}
    constraints = spark.createDataFrame([("top", "k"), ("low", "k"), ("low", "own"), ("other", "k")], "table string, name string")
    above = graph.ancestors(spark.createDataFrame([("low", "mid"), ("mid", "top")], "child string, parent string"))
    assert values(graph.owned_constraints(constraints, above), "table", "name") == [("low", "own"), ("other", "k"), ("top", "k")]


def test_checksum_is_of_rows_not_order(spark):
    a = spark.createDataFrame([(1, 0.5, None), (2, 1.5, "x"), (2, 1.5, "x")], "k long, v double, s string")
    assert compare.content_checksum(a).first() == compare.content_checksum(a.orderBy(F.desc("k")).repartition(3)).first()
    assert compare.content_checksum(a).first() != compare.content_checksum(a.dropDuplicates()).first()
    assert tuple(compare.content_checksum(a.where("false")).first()) == (0, "0-0")
    assert values(compare.data_diff(a, a.dropDuplicates()), "k", "side") == [(2, "only_a")]
    assert compare.compare({"a": a}, {"a": a}).first()["same"] is True


def test_casts_and_domains(spark):
    df = spark.createDataFrame([("1", "2020-01-01"), ("x", "2020-01-01"), (None, "no")], "a string, b string")
    good, bad = cast.strict_cast(df, {"a": "int", "b": "date"})
    assert good.count() == 1 and values(bad, "reason") == [("a: not a int",), ("b: not a date",)]
    rules = [cast.not_null("a"), cast.in_domain("a", ["1"]), cast.fits("b", 5), cast.in_precision("a", 1, 0)]
    assert cast.domain_violations(df, ["a"], rules).count() == 5


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([("r", 1, 1, "loaded", "load", True, "", 3)], ledger.SCHEMA)
    ledger.append_ledger(one, path)
    ledger.append_ledger(one.withColumns({"seq": F.lit(2).cast("long"), "phase": F.lit("rebuilt"), "ok": F.lit(False)}), path)
    got = ledger.read_ledger(spark, path)
    assert ledger.latest(got, ["run_id"], ["attempt", "seq"]).first()["phase"] == "rebuilt"
    assert values(ledger.unresolved(got)) == [("r", 1)]
    rows = [("a", False, False, 3, "loaded", True, 0), ("b", True, True, 3, "loaded", True, 0), ("c", True, False, 4, "loaded", True, 0), ("d", True, False, 3, None, True, 0), ("e", True, False, 3, "done", False, 0), ("f", True, False, 3, "done", True, 0), ("g", True, False, 3, "done", True, 2), ("h", True, False, 3, "loaded", True, 0), ("i", True, False, 3, "loaded", True, 0)]
    runs = spark.createDataFrame(rows, "run_id string, readable boolean, restart boolean, format int, phase string, same_target boolean, unresolved long")
    sections = spark.createDataFrame([("i", s) for s in ("graph", "strip", "load")], "run_id string, section string")
    got = {r["run_id"]: r["decision"] for r in ledger.resume_decision(runs, sections).collect()}
    assert got == {"a": "refuse", "b": "fresh", "c": "fresh", "d": "refuse", "e": "fresh", "f": "done_clean", "g": "done_partial", "h": "fresh", "i": "resume_after_loaded"}


def test_policy_and_report(spark):
    edges = spark.createDataFrame([("c", "fk1", "p"), ("d", "fk1", "q")], "child string, fk string, parent string")
    failed = spark.createDataFrame([("p", "u1"), ("p", "pk1")], "table string, name string")
    assert values(policy.withhold_children(edges, failed)) == [("c", "fk1", "p", "parent key withheld by rebuild (pk1)")]
    tables = spark.createDataFrame([("a",), ("b",), ("c",)], "table string")
    records = spark.createDataFrame([("a", "violated_fk"), ("b", "stale_stats")], "table string, kind string")
    states = report.verdict(tables, records)
    assert values(states) == [("a", "pending", False), ("b", "done", True), ("c", "done", False)]
    assert report.roll_up(states).first()["verdict"] == "PARTIAL"
    assert report.roll_up(report.verdict(tables, records.where("false"))).first()["verdict"] == "COMPLETE"
    pairs = spark.createDataFrame([(1, 2.0, 4.0), (1, 1.0, 4.0), (1, 3.0, 4.0)], "degree int, tool double, other double")
    assert report.paired_ratio(pairs, "degree", 1.5).first()["median_ratio"] == 0.5


def test_dump_files(spark, tmp_path):
    own = tmp_path / "demo"
    own.mkdir()
    body = "%id [dba].[region] 26\n%class [dba].[region] ([id] [name])\n1 'R 01'\n2 'it''s'\n3 NULL\n4 'NULL'\n%class [Orders] ([id] [tags])\n7 {'b','a','b'}\n8 {}\n9 NULL\n"
    (own / "demo_objects").write_text(body)
    (own / "demo_schema").write_text("ALTER CLASS [dba].[t] ADD ATTRIBUTE\n  CONSTRAINT [pk_t_id] PRIMARY KEY([id]);\nALTER CLASS [dba].[c] ADD CONSTRAINT [fk_c_t] FOREIGN KEY([t_id]) REFERENCES [dba].[t];\nCOMMIT WORK;\n")
    other = tmp_path / "broken"
    other.mkdir()
    (other / "x_objects").write_text("%id [a] 1\n")
    roster = dump.scan_roster(spark, str(tmp_path))
    assert values(dump.roster_status(roster), "status") == [("no schema",), ("ok",)]
    assert values(dump.size_profile(roster), "bytes") == [(10,), (len(body),)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")  # several splits of one file
    rows = dump.scan_objects(spark, str(own / "demo_objects"))
    got = values(rows, "owner", "cls", "line")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(x[2] for x in got if x[1] == "region") == ["1 'R 01'", "2 'it''s'", "3 NULL", "4 'NULL'"]
    region, bad = dump.decode_rows(rows.where("cls = 'region'"), {"id": "int", "name": "string"})
    assert sorted((r["id"], r["name"]) for r in region.collect()) == [(1, "R 01"), (2, "it's"), (3, None), (4, "NULL")] and bad.isEmpty()
    tags, bad = dump.decode_rows(rows.where("cls = 'orders'"), {"id": "int", "tags": "set<string>"})
    assert {r["id"]: r["tags"] for r in tags.collect()} == {7: ["a", "b"], 8: [], 9: None} and bad.isEmpty()
    good, bad = dump.decode_rows(rows.where("cls = 'region'"), {"id": "int", "name": "int"})
    assert values(bad, "reason")[0] == ("name: not a int",)
    with pytest.raises(sinks.LoadRejected):
        sinks.load_table(good, bad, str(tmp_path / "t"))
    assert not [x for x in (tmp_path / "t").rglob("*.parquet")]
    none = region.where("false").withColumn("reason", F.lit(""))
    assert sinks.load_table(region, none, str(tmp_path / "t")) == 4
    with pytest.raises(sinks.LoadRejected):
        sinks.load_table(region, bad, str(tmp_path / "t"))
    broken = region.withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        sinks.load_table(broken, none, str(tmp_path / "t"))
    assert sinks.read_table(spark, str(tmp_path / "t")).count() == 4  # neither failure touched what is published
    assert sinks.load_table(region.where("id < 3"), none, str(tmp_path / "t")) == 2
    sinks.retire(spark, str(tmp_path / "t"))
    assert sinks.read_table(spark, str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError, match="nothing is published"):
        sinks.read_table(spark, str(tmp_path / "u"))
    assert values(dump.scan_statements(spark, str(own / "demo_schema")), "table", "name", "kind") == [("c", "fk_c_t", "FOREIGN KEY"), ("t", "pk_t_id", "PRIMARY KEY")]


def test_typed_literals(spark):
    line = "1 X'00ff' 12345678901234567890123456789012345678 '2020-02-29' {3,1,2} {2,1,2}"
    rows = spark.createDataFrame([(line,), ("1 X'zz' 1 '2020-01-01' {} {}",), ("1 2",)], "line string")
    good, bad = dump.decode_rows(rows, {"i": "short", "b": "bit", "n": "decimal(38,0)", "d": "date", "q": "sequence<int>", "m": "multiset<int>"})
    (row,) = good.collect()
    assert bytes(row["b"]) == b"\x00\xff" and str(row["n"]) == "12345678901234567890123456789012345678" and row["q"] == [3, 1, 2] and row["m"] == [1, 2, 2]
    assert sorted(r["reason"] for r in bad.collect())[0].startswith("2 values for 6") and bad.count() == 2


def test_long_literals_and_statements(spark, tmp_path):
    long = "it''s {x} 漢🙂" * 100_000
    rows = spark.createDataFrame([(f"1 '{long}' {{'{long}','b'}}",), ("1 'open {}",), ("1 'a' {'b'",), ("1 'a' {1} x",)], "line string")
    good, bad = dump.decode_rows(rows, {"i": "int", "t": "string", "s": "sequence<string>"})
    (row,) = good.collect()
    assert row["t"] == long.replace("''", "'") == row["s"][0] and row["s"][1] == "b"
    assert sorted(r["reason"].split(";")[0] for r in bad.collect()) == ["4 values for 3 columns", "an open quote or bracket", "an open quote or bracket"]
    path = tmp_path / "schema"
    path.write_text("ALTER CLASS [dba].[t] " + "[ ADD X] " * 100_000 + "ADD CONSTRAINT [k] UNIQUE([a]);\nSELECT " + "x " * 500_000 + ";")
    assert values(dump.scan_statements(spark, str(path)), "table", "name", "kind") == [(" add x", "k", "UNIQUE")]


def test_objects_meet_their_headers_by_split(spark, tmp_path):
    """Many splits of one file, some without header; the plan deals no whole file to one task."""
    lines, want = [], []
    for h in range(40):
        lines.append(f"%class [o].[t{h}] ([a])")
        for i in range((h * 7) % 23):
            lines.append(f"{h * 100 + i}")
            want.append((f"t{h}", str(h * 100 + i)))
    (tmp_path / "x_objects").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (blocks.SENT_SPLITS, 1):
            kept, blocks.SENT_SPLITS = blocks.SENT_SPLITS, most
            rows = dump.scan_objects(spark, str(tmp_path / "x_objects"))
            blocks.SENT_SPLITS = kept
            assert sorted((r["cls"], r["line"]) for r in rows.collect()) == sorted(want)
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Join" not in plan  # lines stay where they are read
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checksums_tell_rows_apart(spark):
    one = lambda rows, schema: compare.content_checksum(spark.createDataFrame(rows, schema)).first()["checksum"]
    text, num = "a string, b string", "a double"
    pairs = [
        (text, [("a|b", "c")], [("a", "b|c")]),
        (text, [("1:a", "b")], [("1", "a1:b")]),
        (text, [(None, "x")], [("\\N", "x")]),
        (text, [(None, "x")], [("~", "x")]),
        (text, [("", "x")], [(None, "x")]),
        (num, [(1e-8,)], [(2e-8,)]),
        (num, [(float("nan"),)], [(None,)]),
        (num, [(1e300,)], [(1.0000000000000002e300,)]),
        ("a array<string>", [(["a", None],)], [(["a"],)]),
    ]
    for schema, x, y in pairs:
        assert one(x, schema) != one(y, schema)
    assert one([(0.0,)], num) == one([(-0.0,)], num)
    assert one([({"a": 1, "b": 2},)], "m map<string,int>") == one([({"b": 2, "a": 1},)], "m map<string,int>")


def test_multi_edge_compares_values_of_mixed_types(spark):
    child = spark.createDataFrame([(1, 1.0), (2, 7.0), (3, None)], "k long, d double").selectExpr("k", "cast(d as decimal(10,2)) d", "cast(k as string) s")
    parents = {"p": spark.createDataFrame([(1,), (1,), (None,), (2,), (3,)], "id int"), "q": spark.createDataFrame([("1",), ("2",)], "id string")}
    edges = [Edge("ed", "c", ("d",), "p", ("id",)), Edge("es", "c", ("s",), "q", ("id",))]
    for most in (refs.SENT_KEYS, 0):
        kept, refs.SENT_KEYS = refs.SENT_KEYS, most
        got = refs.fk_check_multi(child, parents, edges)
        refs.SENT_KEYS = kept
        assert values(got) == [("ed", 2, 1), ("es", 3, 1)]
        assert refs.fk_orphans(child, parents["p"], edges[0]).count() == 1


def test_graphs_equal_brute_force(spark):
    import random

    for seed in range(2):
        rng = random.Random(seed)
        n = 40
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range((30, 70)[seed])} | {(100 + i, 100 + (i + 1) % 40) for i in range(40)} | {(200 + i, 199 + i) for i in range(1, 30)} | {(300 + i, 301 + i) for i in range(30)}
        reach = {}
        for a in {x for e in edges for x in e}:
            seen, todo = set(), [a]
            while todo:
                for b in [y for x, y in edges if x == todo[-1] and y not in seen] or (todo.pop(), [])[1]:
                    seen.add(b)
                    todo.append(b)
            reach[a] = seen
        frame = spark.createDataFrame([(*e, "fk") for e in sorted(edges)], "child long, parent long, kind string")
        want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach if a in reach[a]}
        assert {r["node"]: r["cycle"] for r in graph.cycles(frame).collect()} == want
        assert {r["node"] for r in graph.cyclic_nodes(frame).collect()} == set(want)
        levels, blocked = {}, {a for a in reach if reach[a] & set(want) or a in want}

        def level(a, levels=levels, edges=edges):
            if a not in levels:
                levels[a] = max((1 + level(p) for c, p in edges if c == a), default=0)
            return levels[a]

        nodes = spark.createDataFrame([(a,) for a in reach], "node long")
        assert {r["node"]: r["level"] for r in graph.level_sets(nodes, frame).collect()} == {a: None if a in blocked else level(a) for a in reach}


def test_owners_are_told_apart(spark):
    node = "struct<owner:string,name:string>"
    edges = spark.createDataFrame([(("a", "t"), ("b", "t"), "fk"), (("b", "t"), ("a", "t"), "fk"), (("c", "t"), ("a", "t"), "fk")], f"child {node}, parent {node}, kind string")
    assert sorted((r["node"]["owner"], r["cycle"]["owner"]) for r in graph.cycles(edges).collect()) == [("a", "a"), ("b", "a")]
    constraints = spark.createDataFrame([("x", "t", "k"), ("y", "t", "k"), ("y", "u", "k")], "owner string, table string, name string")
    above = graph.ancestors(spark.createDataFrame([(("y", "u"), ("y", "t"))], "child struct<owner:string,table:string>, parent struct<owner:string,table:string>"))
    assert values(graph.owned_constraints(constraints, above), "owner", "table") == [("x", "t"), ("y", "t")]


def test_times_json_and_collections(spark):
    from loadproof.functions.text import instant, json_text, same_items, utc_text

    rows = spark.createDataFrame([("2024-01-01 09:00:00 Asia/Seoul", "2024-01-01 00:00:00.0+00:00"), ("2024-01-01 09:00:00.5 +09:00", "2023-12-31 19:00:00.5 -05:00"), ("2024-01-01 09:00:00", "no time")], "a string, b string")
    assert [r[0] for r in rows.select(instant(F.col("a")).eqNullSafe(instant(F.col("b")))).collect()] == [True, True, False]
    assert rows.limit(1).select(utc_text(instant(F.col("a")))).first()[0] == "2024-01-01T00:00:00Z"
    js = spark.createDataFrame([('{"a": {"b": [1, 2]}, "e": []}',), ("no json",), (None,)], "j string")
    assert [(r[0], r[1]) for r in js.select(json_text(F.col("j"), "$.a.b[1]"), json_text(F.col("j"), "$.e")).collect()] == [("2", "[]"), (None, None), (None, None)]
    c = spark.createDataFrame([([2, 1, 1], [1, 2, 2]), ([1, 2], [2, 1]), (None, None), ([], None)], "a array<int>, b array<int>")
    got = [tuple(r) for r in c.select(*[same_items(F.col("a"), F.col("b"), k) for k in ("set", "multiset", "sequence")]).collect()]
    assert got == [(True, False, False), (True, True, False), (True, True, True), (False, False, False)]


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from loadproof.sources import scratch

    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Elsewhere)
    kept = scratch.stored(spark.range(3))
    assert kept.count() == 3 and compare.schema_fingerprint({"t": kept}, spark).count() == 2


def test_sinks_and_catalog(spark, tmp_path):
    df = spark.range(45).withColumn("p", sinks.partition_column("range", "id", [("a", 10), ("b", 20), ("c", None)]))
    declared = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "part string")
    assert values(profile.partition_counts(df, "p", declared)) == [("a", 10, True), ("b", 10, True), ("c", 25, True), ("d", 0, False)]
    orphans = spark.createDataFrame([("e", "k=1", "f=2")], "edge string, child_key string, fk_values string")
    repairs = spark.createDataFrame([("t", "fk", "ALTER")], "table string, name string, ddl string")
    for run in ("r1", "r2", "r1"):
        sinks.write_exceptions(orphans, repairs, str(tmp_path / "x"), run)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 4
    classes = spark.createDataFrame([("dba", "a", "CLASS", False), ("dba", "a__p__p1", "CLASS", False), ("dba", "v", "VCLASS", False), ("dba", "s", "CLASS", True)], catalog.FRAMES["classes"])
    assert values(catalog.user_tables(classes), "table") == [("a",)]
    attributes = spark.createDataFrame([("dba", "a", "ref", "b")], catalog.FRAMES["object_attributes"])
    kept, skipped = catalog.gate_tables(classes, attributes, skip=True)
    assert skipped.first()["detail"] == "ref -> b" and kept.count() == 3
    with pytest.raises(ValueError, match="a \\(ref -> b\\)"):
        catalog.gate_tables(classes, attributes, skip=False)
    users, grants = spark.createDataFrame([("u",)], "user string"), spark.createDataFrame([("u", "a", "SELECT"), ("u", "z", "SELECT")], "user string, table string, privilege string")
    assert values(compare.auth_fingerprint(users, grants, classes)) == [("#GRANT", "u", "a SELECT"), ("#USER", "u", "")]


def test_helpers(spark):
    df = spark.createDataFrame([("Dba.T", 1536), ("t", 10)], "n string, b long")
    owner, cls = split_qualified(F.col("n"))
    assert values(df.select(F.coalesce(owner, F.lit("-")), cls)) == [("-", "t"), ("dba", "t")]
    assert values(df.select(human_bytes(F.col("b")))) == [("1.5 KiB",), ("10 B",)]
    assert df.select(render_key([])).first()[0] == "(no pk)"
    done, failed = profile.profile_all({"df": df, "bad": df}, spark)
    assert done.count() == 4 and not failed
