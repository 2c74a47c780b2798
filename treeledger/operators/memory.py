"""Tasks, sessions and what they touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import resolve_path


def newest_tasks(tasks: DataFrame) -> DataFrame:
    """One row for each id, the one updated last."""
    row = F.struct("updated_at", "name", "state", "created_at", "session_id")
    return tasks.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(row).alias("row")).select("id", "row.name", "row.state", "row.created_at", "row.updated_at", "row.session_id")


def newest_task_files(task_files: DataFrame) -> DataFrame:
    """One row for each task and resolved path, the one explored last."""
    row = F.struct("explored_at", "status", "notes")
    rows = task_files.where(F.col("task_id").isNotNull() & F.col("file_path").isNotNull()).select("task_id", resolve_path(F.col("file_path")).alias("file_path"), row.alias("row"))
    return rows.groupBy("task_id", "file_path").agg(F.max("row").alias("row")).select("task_id", "file_path", "row.status", "row.notes", "row.explored_at")


def task_summary(tasks: DataFrame, task_files: DataFrame) -> DataFrame:
    """(task_id, name, n_files, n_flagged, first_at, last_at) of every task, also of those without files.

    Files are counted before the join, so one very large task is no hot key.
    """
    counts = newest_task_files(task_files).groupBy("task_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "flagged").alias("f"), F.min("explored_at").alias("first_at"), F.max("explored_at").alias("last_at")
    )
    joined = newest_tasks(tasks).select(F.col("id").alias("task_id"), "name").join(counts, "task_id", "left")
    return joined.select("task_id", "name", F.coalesce("n", F.lit(0)).alias("n_files"), F.coalesce("f", F.lit(0)).alias("n_flagged"), "first_at", "last_at")


def frontier(files: DataFrame, task_files: DataFrame, task_id: str | None = None) -> DataFrame:
    """Files that a task, or without an id any task, has not touched, whatever the status."""
    touched = newest_task_files(task_files)
    if task_id is not None:
        touched = touched.where(F.col("task_id") == task_id)
    return files.select("path").join(touched.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")


def activated(tasks: DataFrame, task_files: DataFrame) -> DataFrame:
    """Newest tasks after their files were marked: a created task with a file is active since its first one, others stay."""
    first = newest_task_files(task_files).groupBy(F.col("task_id").alias("id")).agg(F.min("explored_at").alias("marked_at"), F.lit(True).alias("marked"))
    begins = F.coalesce((F.col("state") == "created") & F.col("marked"), F.lit(False))
    joined = newest_tasks(tasks).join(first, "id", "left")
    return joined.select("id", "name", F.when(begins, "active").otherwise(F.col("state")).alias("state"), "created_at", F.when(begins, F.greatest("updated_at", "marked_at")).otherwise(F.col("updated_at")).alias("updated_at"), "session_id")


def delete_tasks(tasks: DataFrame, task_files: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks and task files without the ids of ``gone``."""
    return tasks.join(gone.select("id"), "id", "left_anti"), task_files.join(gone.select(F.col("id").alias("task_id")), "task_id", "left_anti")


def sessions(tasks: DataFrame) -> DataFrame:
    """(session_id, n_tasks, started_at, ended_at) of the sessions that tasks belong to."""
    named = newest_tasks(tasks).where(F.col("session_id").isNotNull())
    return named.groupBy("session_id").agg(F.count("*").alias("n_tasks"), F.min("created_at").alias("started_at"), F.max("updated_at").alias("ended_at"))


def checked_before(files: DataFrame, session: DataFrame) -> DataFrame:
    """Files last checked before the one session of ``session`` (started_at) began; no session, no files."""
    started = session.select("started_at").first()
    return files.where(F.lit(False) if started is None else F.col("last_checked") < F.lit(started[0]))
