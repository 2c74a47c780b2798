"""Maps of projects: languages and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import ancestors, dirname, extname, project_of


def language_breakdown(files: DataFrame) -> DataFrame:
    """(project, extension, n_files); letter case of extensions counts."""
    ext = extname(F.col("path"))
    return files.groupBy(project_of(F.col("path")).alias("project"), F.when(ext == "", "(no extension)").otherwise(ext).alias("extension")).agg(F.count("*").alias("n_files"))


def folder_counts(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(folder, depth, n_own, n_files): files in a folder and below it.

    With ``max_depth``, folders below it are dropped with their files, which then count nowhere.
    """
    placed = files.select("path", dirname(F.col("path")).alias("own"))
    if max_depth is not None:
        placed = placed.where(F.size(F.split("own", "/")) <= max_depth)
    # Folders are counted before they are spread over their ancestors: fewer rows move.
    per = placed.groupBy("own").agg(F.count("*").alias("n"))
    spread = per.select("own", "n", F.explode(F.array_union(ancestors(F.concat("own", F.lit("/x"))), F.array("own"))).alias("folder")).where("folder <> '.'")
    return spread.groupBy("folder").agg(F.size(F.split(F.first("folder"), "/")).alias("depth"), F.sum(F.when(F.col("own") == F.col("folder"), F.col("n")).otherwise(0)).alias("n_own"), F.sum("n").alias("n_files"))
