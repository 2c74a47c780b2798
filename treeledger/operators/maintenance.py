"""Keeping the tables: upserts, deletions, edges, retention, as whole-table rewrites.

Parquet has no merge; every function returns the next state of its table, which
``sources.store`` commits as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.session import all_salts, salted


def upsert(base: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """``new`` replaces rows of the same key and adds the others. Null keys never match and are kept."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def guarded_upsert(base: DataFrame, new: DataFrame) -> DataFrame:
    """As ``upsert`` for hashes only: a summary stays while its hash is unchanged, else it is cleared."""
    kept = base.select("path", F.col("hash").alias("old_hash"), "summary")
    summary = F.when(F.col("old_hash") == F.col("hash"), F.col("summary"))
    fresh = new.select("path", "hash", "last_checked").join(kept, "path", "left").select("path", "hash", "last_checked", summary.alias("summary"))
    return upsert(base, fresh)


def delete_entries(files: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and edges without the paths of ``gone`` and without their outgoing edges; incoming ones stay."""
    return files.join(gone, "path", "left_anti"), edges.join(gone.select(F.col("path").alias("source")), "source", "left_anti")


def touch(files: DataFrame, seen: DataFrame, now_ms: Column) -> DataFrame:
    marked = files.join(seen.select("path", F.lit(True).alias("seen")), "path", "left")
    return marked.withColumn("last_checked", F.when(F.col("seen"), now_ms).otherwise(F.col("last_checked"))).drop("seen")


def clear_summaries(files: DataFrame) -> DataFrame:
    return files.withColumn("summary", F.lit(None).cast(files.schema["summary"].dataType))


def replace_edges(edges: DataFrame, refs: DataFrame, read: DataFrame) -> DataFrame:
    """Edges after the files of ``read`` (path) were read again; the last of equal references counts.

    ``refs``: source, target, specifiers, import_type, ordinal, external. External ones are
    dropped. A file that was read and has no reference left loses all its edges.
    """
    last = (
        refs.where(~F.coalesce("external", F.lit(False)))
        .groupBy("source", "target", "import_type")
        .agg(F.max_by("specifiers", "ordinal").alias("specifiers"))
        .select("source", "target", "specifiers", "import_type")
    )
    again = read.select(F.col("path").alias("source")).distinct()
    return edges.join(again, "source", "left_anti").select("source", "target", "specifiers", "import_type").unionByName(last)


def last_edges(edges: DataFrame) -> DataFrame:
    """One row for each (source, target, import_type): the one extracted last."""
    row = F.struct("indexed_at", "specifiers")
    return edges.groupBy("source", "target", "import_type").agg(F.max(row).alias("row")).select("source", "target", "import_type", "row.specifiers", "row.indexed_at")


def remove_node(edges: DataFrame, path: str) -> DataFrame:
    return edges.where((F.col("source") != path) & (F.col("target") != path))


def prune_edges(edges: DataFrame, files: DataFrame, salts: int = 32) -> DataFrame:
    """Edges whose both ends are files. Targets may be hot, so that side is salted by the source."""
    paths = files.select("path").distinct()
    spread = paths.select(F.col("path").alias("dst"), F.explode(all_salts(F.lit(True), salts)).alias("salt"))
    sourced = edges.join(paths.select(F.col("path").alias("src")), "src", "left_semi")
    return sourced.withColumn("salt", salted(F.lit(True), F.hash("src"), salts)).join(spread, ["dst", "salt"], "left_semi").select("src", "dst")


def retain_since(events: DataFrame, now_ms: Column, days: int) -> DataFrame:
    """Events not older than ``days``; exactly that old ones stay."""
    return events.where(F.col("timestamp") >= now_ms - F.lit(days * 86_400_000))


def sample_events(events: DataFrame, rate: float) -> DataFrame:
    """A repeatable sample by a hash of the id; the rate is clamped to 0..1. Events without an id are kept only at 1."""
    rate = min(1.0, max(0.0, rate))
    place = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint")
    return events if rate == 1 else events.where(place < F.lit(int(rate * (1 << 32))))


def to_jsonl(events: DataFrame) -> DataFrame:
    """(id, timestamp, line): one JSON line for each event, in which its id is left out; null fields are written."""
    line = F.to_json(F.struct("timestamp", "event_type", "file_path", "tokens_estimated", F.col("metadata_json").alias("metadata")), {"ignoreNullFields": "false"})
    return events.select("id", "timestamp", line.alias("line"))


def write_jsonl(events: DataFrame, folder: str) -> None:
    """Write the lines in the order of their times; the parts of the folder follow each other. No event gives an empty folder."""
    to_jsonl(events).orderBy("timestamp", "id").select("line").write.mode("overwrite").text(folder)
