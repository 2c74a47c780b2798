"""The N best items of every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions.paths import resolve_path
from treeledger.session import read_table

#: Subgroups into which each group is hashed for the first ranking.
SUBGROUPS = 64


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int, version: str | None = None, subgroups: int = SUBGROUPS) -> DataFrame:
    """(group, item, rank_no): the ``n`` items with the highest score, ranks from 1.

    Rows with a null group, item or score or a NaN score are dropped. Of several rows of one
    group and item the one with the greatest ``version`` counts (null versions come last,
    equal ones are settled by the higher score); without ``version`` the highest score.
    Equal scores are ranked by the item in ascending byte order, so the order is the same on
    every run. Small groups give fewer rows, empty tables none; other columns are ignored.

    Each group is hashed by item into ``subgroups``; a subgroup is ranked on its own and
    keeps ``n`` rows, and only those survivors meet in the second ranking, so at most
    ``n * subgroups`` rows of one group ever share a task.
    """
    newest = [F.col(version)] if version else []
    scored = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score)))
    spread = scored.select(
        F.col(group).alias("g"), F.col(item).alias("i"), F.struct(*newest, F.col(score).cast("double").alias("s")).alias("best"),
        F.pmod(F.xxhash64(F.col(item)), F.lit(subgroups)).cast("int").alias("sub"),
    )
    # Versions are reduced before they move, so an item of very many versions is no hot key.
    single = spread.groupBy("g", "sub", "i").agg(F.max("best").getField("s").alias("s"))
    order = [F.col("s").desc(), F.col("i").asc()]
    first = single.withColumn("r", F.row_number().over(Window.partitionBy("g", "sub").orderBy(*order))).where(F.col("r") <= n).drop("r")
    last = first.withColumn("rank_no", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank_no") <= n)
    return last.select(F.col("g").alias(group), F.col("i").alias(item), "rank_no")


def p2_found(spark, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "ranked_files").select(resolve_path(F.col("query_file")).alias("query_file"), resolve_path(F.col("path")).alias("path"), "score", "ranked_at")
    return top_n(rows, "query_file", "path", "score", 10, "ranked_at")
