"""The import graph: edges, degrees, walks by hops and proximity.

Edges are (src, dst), distinct. A walk joins its frontier, a set of distinct nodes, with
the edges hop by hop and cuts the lineage after each. A hub's edges may be a third of all,
so edges of hot nodes are salted and the frontier row of such a node is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import resolve_path
from treeledger.functions.text import centrality
from treeledger.session import all_salts, cut_lineage, salted

#: A node with more than this share of all edges is salted; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.01
SALTS = 32


def internal(target: Column) -> Column:
    """Whether a target is a file: it has a path separator and no colon."""
    return target.rlike(r"[/\\]") & ~target.contains(":")


def import_edges(imports: DataFrame) -> DataFrame:
    """Distinct (src, dst) of resolved paths; null ends and external modules are left out."""
    rows = imports.where(F.col("source").isNotNull() & internal(F.col("target")))
    return rows.select(resolve_path(F.col("source")).alias("src"), resolve_path(F.col("target")).alias("dst")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, degree) of every node."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counted = ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return counted.withColumn("degree", F.col("n_out") + F.col("n_in"))


def most_connected(edges: DataFrame, limit: int = 10) -> DataFrame:
    """The nodes of highest degree; equal ones by name. A negative limit gives none."""
    return degrees(edges).orderBy(F.col("degree").desc(), "node").limit(max(0, limit))


def summary(edges: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Totals and adjacency of the most connected nodes.

    The first is one row (total_files, total_edges, shown_files, shown_edges, truncated); the
    second holds the edges (source, target) that start at one of the ``limit`` nodes of
    highest degree, sorted, as rows because a hub's list has no bound.
    """
    nodes = degrees(edges)
    top = most_connected(edges, limit).select(F.col("node").alias("src"))
    shown = edges.select("src", "dst").join(top, "src", "left_semi")
    all_nodes = nodes.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("n_out"), F.lit(0)).alias("total_edges"))
    one = F.lit(1).alias("one")  # both sides are one row each
    counted = all_nodes.select("*", one).join(shown.agg(F.count("*").alias("shown_edges")).select("*", one), "one")
    kept = F.least(F.lit(max(0, limit)).cast("bigint"), F.col("total_files"))
    totals = counted.select("total_files", "total_edges", kept.alias("shown_files"), "shown_edges", (F.col("total_files") > kept).alias("truncated"))
    return totals, shown.select(F.col("src").alias("source"), F.col("dst").alias("target")).orderBy("source", "target")


def node_centrality(edges: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(node, degree, centrality): the logarithm of the degree against the highest one.

    With ``among`` (node) only these nodes count, the highest degree is theirs too.
    """
    d = degrees(edges)
    d = d if among is None else d.join(among.select("node").distinct(), "node", "left_semi")
    most = d.agg(F.max("degree")).first()[0] or 0
    return d.select("node", "degree", centrality(F.col("degree"), F.lit(most)).alias("centrality"))


class Walk:
    """Edges prepared for hops from their ``src`` side: written once, those of hot nodes salted."""

    def __init__(self, edges: DataFrame):
        base = cut_lineage(edges.select("src", "dst"))
        counts = base.groupBy("src").agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n")).first()[0] or 0
        self.hot = [r["src"] for r in counts.where(F.col("n") > max(1000, int(total * HOT_SHARE))).collect()]  # at most 1 / HOT_SHARE names
        self.edges = base.select("src", "dst", salted(self._is_hot(), F.hash("dst"), SALTS).alias("salt")) if self.hot else base

    def _is_hot(self) -> Column:
        return F.coalesce(F.col("src").isin(self.hot), F.lit(False))

    def step(self, frontier: DataFrame) -> DataFrame:
        """Distinct nodes one hop behind the nodes of ``frontier`` (column node)."""
        spread = frontier.select(F.col("node").alias("src"))
        if self.hot:
            spread = spread.select("src", F.explode(all_salts(self._is_hot(), SALTS)).alias("salt"))
        return self.edges.join(spread, spread.columns, "left_semi").select(F.col("dst").alias("node")).distinct()


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): nodes reached from any start and the fewest hops; starts are not told.

    ``starts``: node. A depth under 1 counts as 1; without one the walk goes on until
    nothing new is found. Cycles and edges from a node to itself do no harm.
    """
    walk = Walk(edges)
    starts = cut_lineage(starts.select("node").where(F.col("node").isNotNull()).distinct())
    visited = starts.select("node", F.lit(0).alias("depth"))
    frontier, depth = starts, 0
    while max_depth is None or depth < max(1, max_depth):
        depth += 1
        found = cut_lineage(walk.step(frontier).join(visited.select("node"), "node", "left_anti"))
        if found.isEmpty():
            break
        visited = visited.unionByName(found.select("node", F.lit(depth).alias("depth")))
        frontier = found
    return visited.where("depth > 0")


def proximity(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(node, proximity) of nodes near the anchors (column node), the best over all anchors.

    1 for one hop in any direction, 0.5 for two, 0.25 for at most three along the edges or against them.
    Nodes further off have no row; an anchor has one when another hop leads to it.
    """
    both = Walk(undirected(edges))
    anchors = cut_lineage(anchors.select("node").where(F.col("node").isNotNull()).distinct())
    one = cut_lineage(both.step(anchors))
    two = both.step(one).join(anchors, "node", "left_anti")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    three = reach(edges, anchors, 3).select("node").unionByName(reach(back, anchors, 3).select("node"))
    scored = one.select("node", F.lit(1.0).alias("p")).unionByName(two.select("node", F.lit(0.5).alias("p"))).unionByName(three.select("node", F.lit(0.25).alias("p")))
    return scored.groupBy("node").agg(F.max("p").alias("proximity"))


def symbol_edges(imports: DataFrame, symbol: str | None = None, resolved: bool = False) -> DataFrame:
    """(symbol, source, target, import_type), distinct, of the names that edges import; letter case counts.

    Of ``resolved`` edges every target is a file, of others those that look like one.
    """
    rows = imports.where(F.col("source").isNotNull() & (F.col("target").isNotNull() if resolved else internal(F.col("target")))).select(
        F.explode("specifiers").alias("symbol"), resolve_path(F.col("source")).alias("source"), resolve_path(F.col("target")).alias("target"), "import_type"
    )
    rows = rows.where(F.col("symbol").isNotNull() if symbol is None else F.col("symbol") == symbol)
    return rows.distinct()


def neighbourhood(edges: DataFrame, path: str, direction: str = "both", depth: int | None = None) -> DataFrame:
    """(direction, node) around one path: direct neighbours, or with ``depth`` all within it."""
    start = edges.sparkSession.createDataFrame([(path,)], "node string")
    ways = {"dependencies": edges, "dependents": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}
    out = None
    for name, directed in ways.items():
        if direction in (name, "both"):
            found = reach(directed, start, depth or 1).select(F.lit(name).alias("direction"), "node")
            out = found if out is None else out.unionByName(found)
    return out


def related_files(edges: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """(path, relationship): files around one path, each with the first relationship that fits.

    In order: imports, imported-by, transitive-dependency (two hops either way), same-directory.
    """
    from treeledger.functions.paths import dirname

    start = edges.sparkSession.createDataFrame([(path,)], "node string")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out_two, in_two = reach(edges, start, 2), reach(back, start, 2)
    beside = files.where(dirname(F.col("path")) == dirname(F.lit(path))).select(F.col("path").alias("node"), F.lit(4).alias("rank"))
    ranked = (
        out_two.select("node", F.when(F.col("depth") == 1, 1).otherwise(3).alias("rank"))
        .unionByName(in_two.select("node", F.when(F.col("depth") == 1, 2).otherwise(3).alias("rank")))
        .unionByName(beside)
        .where(F.col("node") != path)
        .groupBy("node").agg(F.min("rank").alias("rank"))
    )
    names = F.element_at(F.array(*map(F.lit, ("imports", "imported-by", "transitive-dependency", "same-directory"))), F.col("rank"))
    return ranked.select(F.col("node").alias("path"), names.alias("relationship"))
