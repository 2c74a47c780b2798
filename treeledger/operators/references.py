"""References to records that do not exist, or came only after the reference.

Keys of any type become integers by an order-preserving index: all referenced and existing
keys are sorted once over the cluster and numbered in that order. Existing keys then form
contiguous runs, broken only by keys that do not exist, so the parent table shrinks to a
list of runs. Each referenced number is matched as-of to the run that starts at or before
it; a number beyond that run's end is an orphan.

Windows are cut at fixed blocks of the number line, so no window grows with the data. A
key that holds many references is salted before references and keys are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions.paths import resolve_path
from treeledger.session import all_salts, cut_lineage, read_table, salted

#: Numbers in one block of the line; the most rows that one window holds.
BLOCK = 1 << 16
#: A key with more than this share of all references is salted; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.005
SALTS = 64


def key_index(parents: DataFrame, references: DataFrame) -> DataFrame:
    """(domain, key, live, known, first_at, n_refs, number), sorted by key, numbers ascending.

    ``parents``: domain, key, live (exists now), first_at. ``references``: domain, key.
    Rows without a key are left out. The result is written once, so that the numbers stay.
    """
    none = F.lit(None)
    rows = parents.where(F.col("key").isNotNull()).select(
        "domain", "key", F.col("live").cast("int").alias("live"), F.lit(1).alias("known"), "first_at", F.lit(0).cast("bigint").alias("n_refs")
    ).unionByName(
        references.where(F.col("key").isNotNull()).select(
            "domain", "key", F.lit(0).alias("live"), F.lit(0).alias("known"), none.cast("bigint").alias("first_at"), F.lit(1).cast("bigint").alias("n_refs")
        )
    )
    merged = rows.groupBy("domain", "key").agg(
        F.max("live").alias("live"), F.max("known").alias("known"), F.min("first_at").alias("first_at"), F.sum("n_refs").alias("n_refs")
    )
    ordered = merged.repartitionByRange("domain", "key").sortWithinPartitions("domain", "key")
    return cut_lineage(ordered.withColumn("number", F.monotonically_increasing_id()))


def contiguous_runs(numbers: DataFrame, number: str = "number", block: int = BLOCK) -> DataFrame:
    """(block, run_start, run_end): maximal runs of consecutive integers, cut at block ends.

    Repeated numbers count once; null numbers are left out; no rows give no run.
    """
    by_block = Window.partitionBy("block").orderBy(number)
    return (
        numbers.where(F.col(number).isNotNull())
        .select(F.col(number), F.floor(F.col(number) / F.lit(block)).alias("block"))
        .withColumn("island", F.col(number) - F.dense_rank().over(by_block))
        .groupBy("block", "island")
        .agg(F.min(number).alias("run_start"), F.max(number).alias("run_end"))
        .drop("island")
    )


def match_runs(references: DataFrame, runs: DataFrame, number: str = "number", block: int = BLOCK) -> DataFrame:
    """``references`` with ``orphan``: whether its number lies in no run.

    Each number is matched as-of to the preceding run start of its block. A null number is
    no reference and is left out; repeated ones keep all their rows. A column ``orphan`` is replaced.
    """
    extra = [c for c in references.columns if c not in (number, "orphan")]
    points = references.where(F.col(number).isNotNull()).select(
        F.floor(F.col(number) / F.lit(block)).alias("block"), F.col(number).alias("at"), F.lit(1).alias("is_ref"), F.lit(None).cast("bigint").alias("run_end"), F.struct(number, *extra).alias("row")
    )
    starts = runs.select("block", F.col("run_start").alias("at"), F.lit(0).alias("is_ref"), "run_end", F.lit(None).cast(points.schema["row"].dataType).alias("row"))
    so_far = Window.partitionBy("block").orderBy("at", "is_ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        starts.unionByName(points)
        .withColumn("end", F.last("run_end", ignorenulls=True).over(so_far))
        .where("is_ref = 1")
        .select("row.*", F.coalesce(F.col("at") > F.col("end"), F.lit(True)).alias("orphan"))
    )


def broken_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct (ref_table, ref_field, key_a, key_b, period_month, reason).

    ``references``: domain, key, ref_table, ref_field, key_a, key_b, ref_at (epoch ms).
    ``parents``: domain, key, live, first_at (epoch ms or null). Further columns are ignored.

    reason: ``missing`` (the key is in no parent row), ``deleted`` (only in rows that are
    not live), ``late`` (live, but its least first_at is after the reference). A null key is
    no reference. A reference without a time has a null month and is never late; a parent
    without a first_at makes none late. Repeated references of one month count once, late
    if any of them is.
    """
    month = F.date_format(F.timestamp_millis("ref_at"), "yyyy-MM")
    # One row for each reference and month before anything else moves.
    grouped = (
        references.where(F.col("key").isNotNull())
        .select("domain", "key", "ref_table", "ref_field", "key_a", "key_b", month.alias("period_month"), "ref_at")
        .groupBy("domain", "key", "ref_table", "ref_field", "key_a", "key_b", "period_month")
        .agg(F.min("ref_at").alias("ref_at"))
    )
    index = key_index(parents, references)
    total = index.agg(F.sum("n_refs")).first()[0] or 0
    hot = F.col("n_refs") > F.lit(max(1000, int(total * HOT_SHARE)))

    runs = contiguous_runs(index.where("live = 1"))
    keys = match_runs(index.where("n_refs > 0"), runs).withColumn("hot", hot)
    keys = keys.select("domain", "key", "orphan", "known", "first_at", F.explode(all_salts(F.col("hot"), SALTS)).alias("salt"))

    hot_keys = index.where(hot).select("domain", "key", F.lit(True).alias("hot"))  # at most 1 / HOT_SHARE rows
    spread = F.hash("key_a", "key_b", "period_month")
    keyed = grouped.join(F.broadcast(hot_keys), ["domain", "key"], "left").withColumn("salt", salted(F.col("hot").isNotNull(), spread, SALTS)).drop("hot")

    late = F.coalesce(F.col("first_at") > F.col("ref_at"), F.lit(False))
    reason = F.when(F.col("orphan") & (F.col("known") == 1), "deleted").when(F.col("orphan"), "missing").when(late, "late")
    return (
        keyed.join(keys, ["domain", "key", "salt"])
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("ref_table", "ref_field", "key_a", "key_b", "period_month", "reason")
    )


def catalogue_references(imports: DataFrame, task_files: DataFrame) -> DataFrame:
    """References of the catalogue: both ends of an import to files, exploring rows to tasks.

    A target with a colon or without a path separator is an external module, no reference.
    """
    edges = imports.select(
        resolve_path(F.col("source")).alias("key_a"),
        resolve_path(F.col("target")).alias("key_b"),
        F.col("target").isNotNull().__and__(~F.col("target").contains(":")).__and__(F.col("target").rlike(r"[/\\]")).alias("internal"),
        F.col("indexed_at").alias("ref_at"),
    )
    ends = F.array(
        F.struct(F.lit("source").alias("ref_field"), F.col("key_a").alias("key")),
        F.struct(F.lit("target").alias("ref_field"), F.when(F.col("internal"), F.col("key_b")).alias("key")),
    )
    files = edges.select(F.lit("file").alias("domain"), F.lit("imports").alias("ref_table"), "key_a", "key_b", "ref_at", F.explode(ends).alias("end")).select(
        "domain", "end.key", "ref_table", "end.ref_field", "key_a", "key_b", "ref_at"
    )
    tasks = task_files.select(
        F.lit("task").alias("domain"), F.col("task_id").alias("key"), F.lit("task_files").alias("ref_table"), F.lit("task_id").alias("ref_field"),
        F.col("task_id").alias("key_a"), resolve_path(F.col("file_path")).alias("key_b"), F.col("explored_at").alias("ref_at"),
    )
    return files.unionByName(tasks)


def catalogue_parents(files: DataFrame, file_snapshots: DataFrame, tasks: DataFrame) -> DataFrame:
    """Files with their first delivery, paths that were delivered once, and tasks."""
    taken = F.unix_millis(F.col("taken_at").cast("timestamp"))
    none = F.lit(None).cast("bigint")
    now = files.select(F.lit("file").alias("domain"), resolve_path(F.col("path")).alias("key"), F.lit(True).alias("live"), none.alias("first_at"))
    past = file_snapshots.select(F.lit("file").alias("domain"), resolve_path(F.col("path")).alias("key"), F.lit(False).alias("live"), taken.alias("first_at"))
    todo = tasks.select(F.lit("task").alias("domain"), F.col("id").alias("key"), F.lit(True).alias("live"), F.col("created_at").alias("first_at"))
    return now.unionByName(past).unionByName(todo)


def p1_found(spark, folder: str) -> DataFrame:
    t = {n: read_table(spark, folder, n) for n in ("imports", "task_files", "files", "file_snapshots", "tasks")}
    return broken_references(catalogue_references(t["imports"], t["task_files"]), catalogue_parents(t["files"], t["file_snapshots"], t["tasks"]))


def p1_rates(spark, folder: str) -> DataFrame:
    """Broken references per table, field, month and reason."""
    return p1_found(spark, folder).groupBy("ref_table", "ref_field", "period_month", "reason").agg(F.count("*").alias("n_broken"))
