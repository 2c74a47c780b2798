"""Relevance of files: signals and their weighted sum."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import dirname, resolve_path
from treeledger.functions.text import file_type_relevance, recency
from treeledger.operators import graph

# Default weights and relationship scores.
WEIGHTS = {"relationship": 0.30, "dependencyProximity": 0.25, "recency": 0.15, "fileTypeRelevance": 0.10, "taskContextRelevance": 0.15, "centrality": 0.05}
RELATIONSHIP = {"imports": 1.0, "imported-by": 1.0, "transitive-dependency": 0.5, "same-directory": 0.25}
HALF_LIFE_MS = 4 * 3_600_000


def relationship_score(relationship: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for p in RELATIONSHIP.items() for x in p])
    return F.coalesce(F.element_at(pairs, relationship), F.lit(0.0))


def composite(signals: Column, weights: Mapping[str, float] | None = None) -> Column:
    """Weighted sum of a signals struct; ``weights`` replaces some defaults, null signals count 0."""
    total = F.lit(0.0)
    for name, weight in (WEIGHTS | dict(weights or {})).items():
        total = total + F.coalesce(signals.getField(name), F.lit(0.0)) * F.lit(float(weight))
    return total


def ranked(rows: DataFrame) -> DataFrame:
    """``ranked_files`` with ``composite``: the newest row of each resolved pair, all of them.

    A NaN score is none, so it becomes null; of equally new rows the one with the greatest score counts.
    """
    score = F.when(~F.isnan("score"), F.col("score"))
    row = F.struct("ranked_at", score.alias("score"), "signals")
    pairs = rows.where(F.col("query_file").isNotNull() & F.col("path").isNotNull()).select(resolve_path(F.col("query_file")).alias("query_file"), resolve_path(F.col("path")).alias("path"), row.alias("row"))
    newest = pairs.groupBy("query_file", "path").agg(F.max("row").alias("row"))
    return newest.select("query_file", "path", "row.score", F.round(composite(F.col("row.signals")), 9).alias("composite"))


def rank_related(edges: DataFrame, files: DataFrame, path: str, touched: DataFrame, now_ms: Column, half_life_ms: int = HALF_LIFE_MS, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(path, relationship, score, signals) of the files related to one, from all six signals.

    ``touched`` (file_path, status) are the files of a task: further anchors of proximity and
    the task context. Centrality is told against the candidates.
    """
    related = graph.related_files(edges, files, path)
    start = edges.sparkSession.createDataFrame([(path,)], "node string")
    near = graph.proximity(edges, start.unionByName(touched.select(F.col("file_path").alias("node")))).select(F.col("node").alias("path"), "proximity")
    central = graph.node_centrality(edges, related.select(F.col("path").alias("node"))).select(F.col("node").alias("path"), "centrality")
    joined = related.join(central, "path", "left").join(near, "path", "left").join(task_context(related, touched), "path", "left").join(files.select("path", "last_checked"), "path", "left")
    signals = F.struct(
        relationship_score(F.col("relationship")).alias("relationship"), F.coalesce("proximity", F.lit(0.0)).alias("dependencyProximity"),
        recency(now_ms - F.col("last_checked"), half_life_ms).alias("recency"), file_type_relevance(F.col("path")).alias("fileTypeRelevance"),
        F.col("task_context").alias("taskContextRelevance"), F.coalesce("centrality", F.lit(0.0)).alias("centrality"),
    )
    return joined.select("path", "relationship", composite(signals, weights).alias("score"), signals.alias("signals"))


def task_context(candidates: DataFrame, task_files: DataFrame) -> DataFrame:
    """(path, task_context) against all files that tasks touched.

    1 in the folder of a flagged file, 0.7 in that of an explored one, 0.4 when both
    folders have the same parent, else 0.1. ``task_files``: file_path, status. Empty
    ``task_files`` give 0.1 everywhere.
    """
    touched = task_files.where(F.col("file_path").isNotNull()).select(dirname(resolve_path(F.col("file_path"))).alias("folder"), "status")
    folders = touched.groupBy("folder").agg(F.max(F.when(F.col("status") == "flagged", 1.0).otherwise(0.7)).alias("own"))
    parents = folders.select(dirname(F.col("folder")).alias("parent")).distinct().withColumn("near", F.lit(0.4))
    placed = candidates.select("path", dirname(F.col("path")).alias("folder")).withColumn("parent", dirname(F.col("folder")))
    scored = placed.join(folders, "folder", "left").join(parents, "parent", "left")
    return scored.select("path", F.coalesce("own", "near", F.lit(0.1)).alias("task_context"))
