"""What changed between full deliveries of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions.paths import normal_hash, project_of, resolve_path
from treeledger.session import read_table

#: Rows of one source and delivery are spread over so many keys when its index is looked up.
SALTS = 32


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """(source, snapshot_no, key, change_kind) between each delivery of a source and its one before.

    ``rows``: source, snapshot_no, key, hash, version; further columns are ignored. Within
    a delivery the row with the greatest version (nulls last, then the greatest hash)
    counts for its key; repeated rows change nothing. Rows without source, number or key
    are left out. Null hashes are equal to each other and differ from all others. The first
    delivery of a source gives no rows, an empty table none.

    Deliveries of a source are numbered without gaps; each key is then windowed over the
    numbers in which it occurs. A lagged hash shows a change; a gap in the numbers shows a
    removal after the row before and an addition at the row after.
    """
    kept = (
        rows.where(F.col("source").isNotNull() & F.col("snapshot_no").isNotNull() & F.col("key").isNotNull())
        .select("source", "snapshot_no", "key", F.struct("version", "hash").alias("best"))
        .groupBy("source", "snapshot_no", "key")
        .agg(F.max("best").getField("hash").alias("hash"))
        .withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS)))
    )
    # One row for each source and delivery: small beside the rows, and never broadcast unchecked.
    in_order = Window.partitionBy("source").orderBy("snapshot_no")
    deliveries = (
        rows.where(F.col("source").isNotNull() & F.col("snapshot_no").isNotNull() & F.col("key").isNotNull())
        .select("source", "snapshot_no")
        .distinct()
        .withColumn("number", F.row_number().over(in_order))
        .withColumn("next_no", F.lead("snapshot_no").over(in_order))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    by_key = Window.partitionBy("source", "key").orderBy("number")
    seen = (
        kept.join(deliveries, ["source", "snapshot_no", "salt"])
        .withColumn("before", F.lag("number").over(by_key))
        .withColumn("before_hash", F.lag("hash").over(by_key))
        .withColumn("after", F.lead("number").over(by_key))
    )
    fresh = F.col("before").isNull() & (F.col("number") > 1) | (F.col("before") < F.col("number") - 1)
    changed = (F.col("before") == F.col("number") - 1) & ~F.col("hash").eqNullSafe(F.col("before_hash"))
    gone = F.col("next_no").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("number") + 1))
    events = F.array_compact(
        F.array(
            F.when(fresh, F.struct(F.col("snapshot_no").alias("at"), F.lit("added").alias("kind"))),
            F.when(changed, F.struct(F.col("snapshot_no").alias("at"), F.lit("changed").alias("kind"))),
            F.when(gone, F.struct(F.col("next_no").alias("at"), F.lit("deleted").alias("kind"))),
        )
    )
    return seen.select("source", "key", F.explode(events).alias("e")).select("source", F.col("e.at").alias("snapshot_no"), "key", F.col("e.kind").alias("change_kind"))


def file_deliveries(file_snapshots: DataFrame) -> DataFrame:
    """``file_snapshots`` in the form ``snapshot_changes`` takes; the project is the source."""
    return (
        file_snapshots.select("snapshot_no", resolve_path(F.col("path")).alias("key"), normal_hash(F.col("hash")).alias("hash"), F.col("last_checked").alias("version"))
        .where("key <> ''")
        .withColumn("source", project_of(F.col("key")))
    )


def p5_found(spark, folder: str) -> DataFrame:
    changes = snapshot_changes(file_deliveries(read_table(spark, folder, "file_snapshots")))
    return changes.select("snapshot_no", F.col("key").alias("path"), "change_kind")


def p5_counts(spark, folder: str) -> DataFrame:
    """Changes per project, delivery and kind."""
    changes = snapshot_changes(file_deliveries(read_table(spark, folder, "file_snapshots")))
    return changes.groupBy(F.col("source").alias("project"), "snapshot_no", "change_kind").agg(F.count("*").alias("n_paths"))
