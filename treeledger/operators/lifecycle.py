"""Garbage collection, invalidation and the generation of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.text import generation_mode, generation_of

DAY_MS = 86_400_000
#: Generation of today's summaries.
GENERATION = 3


def garbage(files: DataFrame, scan: DataFrame, edges: DataFrame, events: DataFrame, tasks: DataFrame, now_ms: int, file_days: float = 30, event_days: float = 90, task_days: float = 30) -> dict[str, DataFrame]:
    """Rows that a collection removes, by category.

    Deleted files are not in the scan; stale ones are still there but unchecked for
    ``file_days``; orphan edges (src) start at no remaining file; old events are past
    ``event_days``; old tasks are completed or archived and were not updated for ``task_days``.
    """
    before = lambda days: F.lit(int(now_ms - days * DAY_MS))
    deleted = files.join(scan.select("path"), "path", "left_anti")
    old = F.coalesce(F.col("last_checked") < before(file_days), F.lit(False))
    left = files.join(scan.select("path"), "path", "left_semi")
    orphans = edges.join(left.where(~old).select(F.col("path").alias("src")), "src", "left_anti")
    done = F.col("state").isin("completed", "archived") & (F.col("updated_at") < before(task_days))
    return {"deleted_files": deleted, "stale_files": left.where(old), "orphan_edges": orphans, "old_events": events.where(F.col("timestamp") < before(event_days)), "old_tasks": tasks.where(done)}


def garbage_counts(*tables: DataFrame, now_ms: int, **days: float) -> DataFrame:
    """(category, n): how many rows ``garbage`` tells of each category."""
    out = None
    for name, rows in garbage(*tables, now_ms=now_ms, **days).items():
        counted = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("category"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


def kept_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (source) whose source is a file."""
    return edges.join(files.select(F.col("path").alias("source")).distinct(), "source", "left_semi")


def orphan_sources(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose source is no file."""
    return edges.join(files.select(F.col("path").alias("src")).distinct(), "src", "left_anti")


def generation_action(tag: Column, mode: str, generation: int = GENERATION) -> Column:
    """What to do with stored summaries: ``block`` writes when the tag is newer, ``retag``, ``clear`` or ``keep``.

    Regular-expression summaries of earlier generations, and those of before there were tags,
    are still right, so they are only retagged. A malformed tag tells nothing, so all is cleared.
    """
    stored, stored_mode = generation_of(tag), generation_mode(tag)
    return (
        F.when(stored > generation, "block")
        .when((stored == generation) & (stored_mode == mode), "keep")
        .when((F.lit(mode) == "regex") & (tag.isNull() | ((stored_mode == "regex") & stored.between(1, generation - 1))), "retag")
        .otherwise("clear")
    )


def invalidate(files: DataFrame, paths: DataFrame | None, now_ms: Column) -> tuple[DataFrame, DataFrame]:
    """Files without the given paths (without any, when None) and one event for each removed row."""
    gone = files if paths is None else files.join(paths.select("path").distinct(), "path", "left_semi")
    left = files.where(F.lit(False)) if paths is None else files.join(paths.select("path").distinct(), "path", "left_anti")
    events = gone.select(now_ms.alias("timestamp"), F.lit("invalidation").alias("event_type"), F.col("path").alias("file_path"))
    return left, events
