"""Dependency graphs as edge tables (child, parent, kind), for tables of any size.

A node may be a name, or a struct of owner and name, which orders and joins like any value.
kind: `inherits` edges are hard, all others soft. A node is cyclic if it lies in a cycle of two or
more nodes or has an edge to itself. Loops write each round to the shared folder, so that plans
stay short and a lost executor costs one round.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loadproof.sources.catalog import identity
from loadproof.sources.scratch import forget, stored


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path of one or more edges (child, parent); paths double each round.

    The result has a row for each pair, so it is for shallow hierarchies, which ask for these rows.
    """
    paths = stored(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct())
    n = paths.count()
    while True:
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        before, paths = paths, stored(paths.union(longer).distinct())
        forget(before)
        if (more := paths.count()) == n:
            return paths
        n = more


def _noted(df: DataFrame, flag: Column) -> tuple[DataFrame, int]:
    """The frame stored, and in how many of its rows the flag holds, counted as they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count_if(flag).alias("n")))
    return out, seen.get["n"]


def _lows(edges: DataFrame) -> DataFrame:
    """(node, f, b): for every node of the edges the least node that it reaches and the least that reaches it.

    Both ways at once, with one row for each node and direction (node, way, low, jump): low falls to the least
    low of the next nodes, of the node that jump points at and of the node low itself; jump, at first any next node,
    doubles its distance each round. Rounds grow with the logarithm of the length of rings and chains, rows never.
    """
    ways = edges.select(F.lit("f").alias("way"), F.col("child").alias("node"), F.col("parent").alias("next")).union(edges.select(F.lit("b"), "parent", "child"))
    ways = stored(ways)
    ends = ways.select("way", "node").union(ways.select("way", "next")).distinct()
    jump = ways.groupBy("way", "node").agg(F.max("next").alias("jump"))
    state = stored(ends.join(jump, ["way", "node"], "left").select("way", "node", F.col("node").alias("low"), F.coalesce("jump", "node").alias("jump")))
    changed = 1
    while changed:
        of = state.select("way", F.col("node").alias("at"), F.col("low").alias("at_low"), F.col("jump").alias("at_jump"))
        # who asks whom: next nodes and the two pointers
        asks = ways.select("way", "node", F.col("next").alias("at"), F.lit(0).alias("kind")).union(state.select("way", "node", "jump", F.lit(1))).union(state.where("low <> node").select("way", "node", "low", F.lit(0)))
        told = asks.join(of, ["way", "at"]).groupBy("way", "node").agg(F.min("at_low").alias("told"), F.max(F.when(F.col("kind") == 1, F.col("at_jump"))).alias("further"))
        new = state.join(told, ["way", "node"], "left").select("way", "node", F.col("low").alias("was"), F.least("low", "told").alias("low"), F.coalesce("further", "jump").alias("jump"))
        before, (state, changed) = state, _noted(new, F.col("was") != F.col("low"))
        forget(before)
    pick = lambda w: F.min(F.when(F.col("way") == w, F.col("low"))).alias(w)
    return state.groupBy("node").agg(pick("f"), pick("b"))


def _between(edges: DataFrame) -> DataFrame:
    """Edges both of whose ends have edges in and out; others lie in no cycle. Twice, as most graphs are shallow."""
    for _ in range(2):
        edges = edges.join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("child", "parent")
    return edges


def _components(edges: DataFrame) -> DataFrame:
    """(cycle, node) of nodes that reach each other, two or more, named by the least.

    A node whose least reached and least reaching node are one is in that node's component. The others go on, with
    the edges between nodes alike in both, as the two ends of an edge within a component are.
    """
    all_ = stored(edges.where("child <> parent").select("child", "parent").distinct())
    left, out = stored(_between(all_)), []
    forget(all_)
    while not left.isEmpty():
        lows = stored(_lows(left))
        out.append(lows.where("f = b").select(F.col("f").alias("cycle"), "node"))
        rest = lows.where("f <> b")
        ends = lambda side, rest=rest: rest.select(F.col("node").alias(side), F.struct("f", "b").alias(f"{side}_lows"))
        left = left.join(ends("child"), "child").join(ends("parent"), "parent").where("child_lows = parent_lows").select("child", "parent")
        left = stored(_between(left))
    if not out:
        return edges.select(F.col("child").alias("cycle"), F.col("child").alias("node")).where("false")
    found = reduce(DataFrame.union, out)
    return found.join(found.where("cycle <> node").select("cycle").distinct(), "cycle", "left_semi")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node) of every cyclic node."""
    return edges.where("child = parent").select(F.col("child").alias("node")).union(_components(edges).select("node")).distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle, node): nodes that reach each other, named by the least of them; self edges are cycles of one."""
    own = edges.where("child = parent").select(F.col("child").alias("cycle"), F.col("child").alias("node"))
    return _components(edges).union(own).groupBy("node").agg(F.min("cycle").alias("cycle")).select("cycle", "node")


def precedence(edges: DataFrame, cyclic: DataFrame, nodes: DataFrame) -> DataFrame:
    """(child, parent, hard): edges with both ends present; a soft one goes if both its ends are cyclic."""
    known = nodes.select("node")
    ends = edges.join(known.withColumnRenamed("node", "child"), "child", "left_semi").join(known.withColumnRenamed("node", "parent"), "parent", "left_semi")
    flag = lambda side: cyclic.select(F.col("node").alias(side), F.lit(True).alias(f"{side}_cyclic"))
    marked = ends.join(flag("child"), "child", "left").join(flag("parent"), "parent", "left")
    hard = F.col("kind") == "inherits"
    kept = marked.where(hard | F.col("child_cyclic").isNull() | F.col("parent_cyclic").isNull())
    return kept.groupBy("child", "parent").agg(F.bool_or(hard).alias("hard"))


#: Rounds of level_sets whose edges are kept until their nodes' levels are written.
KEPT_ROUNDS = 8


def level_sets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the longest path to a node without parents; null for nodes that a cycle keeps from any level.

    A round keeps the edges whose parent is some edge's child still: a node's level is how many rounds it is a child. One job and one
    copy of the remaining edges a round; every KEPT_ROUNDS rounds what they say of levels is folded and they are deleted. If a round takes nothing away, its nodes are
    on or below a cycle.
    """
    return _levels(nodes, edges)[0]


def _levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """level_sets, and whether every node has a level."""
    left, n = _noted(edges.select("child", "parent").distinct(), F.lit(True))
    kept, level, last = [], 0, None
    fold = lambda parts: reduce(DataFrame.union, parts).groupBy("node").agg(F.max("level").alias("level"))
    stuck, whole = left.where("false").select(F.col("child").alias("node")), True
    while n:
        level += 1
        kept.append((left, left.select(F.col("child").alias("node"), F.lit(level).alias("level"))))
        if len(kept) > KEPT_ROUNDS:
            older = kept[:-1]
            new = stored(fold([x for _, x in older] + ([last] if last is not None else [])))
            for frame in [f for f, _ in older] + ([last] if last is not None else []):
                forget(frame)
            last, kept = new, kept[-1:]
        left, more = _noted(left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent"), F.lit(True))
        if more == n:
            stuck, whole = left.select(F.col("child").alias("node")).distinct(), False
            break
        n = more
    own = nodes.select("node").distinct()
    parts = [x for _, x in kept] + ([last] if last is not None else [])
    if not parts:
        return own.select("node", F.lit(0).alias("level")), whole
    placed = own.join(fold(parts), "node", "left").join(stuck.withColumn("_stuck", F.lit(True)), "node", "left")
    return placed.select("node", F.when(F.col("_stuck").isNull(), F.coalesce("level", F.lit(0))).alias("level")), whole


def dependency_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """level_sets of edges (child, parent, kind) by precedence.

    Levels are tried with all edges first: if every node gets one there are no cycles, and none are looked for. Else
    cycles are looked for among the nodes without level alone, where all of them lie.
    """
    edges, nodes = stored(edges), stored(nodes.select("node").distinct())
    ends = lambda known: edges.join(known.withColumnRenamed("node", "child"), "child", "left_semi").join(known.withColumnRenamed("node", "parent"), "parent", "left_semi")
    tried, whole = _levels(nodes, ends(nodes))
    if whole:
        return tried
    without = stored(tried.where("level IS NULL").select("node"))
    return level_sets(nodes, precedence(edges, cyclic_nodes(stored(ends(without))), nodes))


def hierarchy_depths(edges: DataFrame) -> DataFrame:
    """(node, depth): the longest path down from a node without parents, by one recursive query; for shallow hierarchies.

    An edge back to a node of its own path isn't followed, so cycles end; nodes that no root reaches are left out. Rows of a level are
    those of its paths, of any number, so a graph with very many paths is for level_sets, and so is one deeper than
    spark.sql.cteRecursionLevelLimit, 100 levels unless set, which is refused.
    """
    spark, name = edges.sparkSession, f"edges_{uuid.uuid4().hex}"
    edges.select("child", "parent").where("child <> parent").distinct().createOrReplaceTempView(name)
    try:
        return spark.sql(
            f"""WITH RECURSIVE w (node, depth, path) AS (
              SELECT DISTINCT parent, 0, array(parent) FROM {name} e LEFT ANTI JOIN (SELECT child FROM {name}) c ON e.parent = c.child
              UNION ALL SELECT e.child, w.depth + 1, array_append(w.path, e.child) FROM w JOIN {name} e ON e.parent = w.node WHERE NOT array_contains(w.path, e.child))
            SELECT node, max(depth) AS depth FROM (SELECT * FROM w LIMIT ALL) GROUP BY node"""
        )
    finally:
        spark.catalog.dropTempView(name)


def check_levels(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose parent isn't on a lower level than the child, or with an end on no level."""
    of = lambda side: levels.select(F.col("node").alias(side), F.col("level").alias(f"{side}_level"))
    both = edges.select("child", "parent").join(of("child"), "child", "left").join(of("parent"), "parent", "left")
    problem = F.when(F.col("child_level").isNull() | F.col("parent_level").isNull(), "unplaced").when(F.col("parent_level") >= F.col("child_level"), "order")
    return both.withColumn("problem", problem).where("problem IS NOT NULL")


def ancestors(inherits: DataFrame) -> DataFrame:
    """(node, ancestor) for every class above, at any distance."""
    return closure(inherits).toDF("node", "ancestor")


def owned_constraints(constraints: DataFrame, above: DataFrame) -> DataFrame:
    """Constraints ([owner,] table, name) less those that a class above has under the same name; above has nodes as the tables are."""
    key = identity(constraints)
    at = F.struct(*key) if len(key) > 1 else F.col("table")
    rows = constraints.withColumn("_at", at)
    inherited = rows.select("_at", "name").join(above.select(F.col("node").alias("_at"), "ancestor"), "_at")
    owned = rows.select(F.col("_at").alias("ancestor"), "name").distinct()
    return rows.join(inherited.join(owned, ["ancestor", "name"]).select("_at", "name").distinct(), ["_at", "name"], "left_anti").drop("_at")


def index_columns(index_keys: DataFrame) -> DataFrame:
    """([owner,] table, index, columns) with the key columns of each index in order; gaps in key_order close up."""
    return index_keys.groupBy(*identity(index_keys), "index").agg(F.transform(F.array_sort(F.collect_list(F.struct("key_order", "column"))), lambda x: x["column"]).alias("columns"))


def key_positions(index_keys: DataFrame) -> DataFrame:
    """Each key column with its position within the index, from 1."""
    return index_keys.withColumn("position", F.row_number().over(Window.partitionBy(*identity(index_keys), "index").orderBy("key_order")))


def resolve_edges(references: DataFrame, index_keys: DataFrame, indexes: DataFrame) -> DataFrame:
    """(child, name, parent, child_columns, parent_columns) of references ([owner,] table, constraint, [parent_owner,] parent[, parent_index]).

    With owners in all three frames, tables of one name under two owners are two, and the result has child_owner and
    parent_owner too. The parent's columns are those of the index that the reference names, else of its primary key;
    a reference whose columns don't pair up comes out with paired = false.
    """
    owned = all("owner" in df.columns for df in (references, index_keys, indexes))
    one = lambda df: df if owned else df.withColumn("owner", F.lit("")).withColumn("parent_owner", F.lit(""))
    references, index_keys, indexes = one(references), one(index_keys), one(indexes)
    cols = index_columns(index_keys)
    pk = indexes.where("is_primary_key").groupBy(F.col("owner").alias("parent_owner"), F.col("table").alias("parent")).agg(F.min("index").alias("pk"))
    refs = references if "parent_index" in references.columns else references.withColumn("parent_index", F.lit(None).cast("string"))
    named = refs.join(pk, ["parent_owner", "parent"], "left").withColumn("parent_index", F.coalesce("parent_index", "pk"))
    child = cols.select("owner", "table", F.col("index").alias("constraint"), F.col("columns").alias("child_columns"))
    parent = cols.select(F.col("owner").alias("parent_owner"), F.col("table").alias("parent"), F.col("index").alias("parent_index"), F.col("columns").alias("parent_columns"))
    out = named.join(child, ["owner", "table", "constraint"], "left").join(parent, ["parent_owner", "parent", "parent_index"], "left")
    paired = F.coalesce(F.size("child_columns") == F.size("parent_columns"), F.lit(False))
    owners = [F.col("owner").alias("child_owner"), F.col("parent_owner")] if owned else []
    return out.select(*owners, F.col("table").alias("child"), F.col("constraint").alias("name"), "parent", "child_columns", "parent_columns", paired.alias("paired"))
