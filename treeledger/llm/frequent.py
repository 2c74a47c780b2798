"""Most frequent values of a column, by exact refinement of hash prefixes.

Values are hashed to 64 bits. A first pass counts short prefixes of the hash; a prefix's
count is an upper bound for every value below it, so prefixes that cannot reach the lower
bound are dropped with all their values. The retained ones are lengthened and counted
again, and after the longest prefix the full values that remain are counted. Memory is
bounded by the number of prefixes, never by the number of distinct values, and the counts
that come out are exact.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions.paths import resolve_path
from treeledger.session import cut_lineage, read_table

#: Bits of the hash that each round counts. A round's groups number at most 2**12 for each retained prefix.
PREFIX_BITS = (12, 24)


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("h"), 64 - bits)


#: Prefixes up to this number are broadcast; more of them, as when no value stands out, are joined by shuffling.
BROADCAST_PREFIXES = 10_000


def _retained(values: DataFrame, kept: DataFrame | None, bits: int) -> DataFrame:
    """Rows below the prefixes (field_name, prefix) kept so far."""
    if kept is None:
        return values
    below = F.broadcast(kept) if kept.count() <= BROADCAST_PREFIXES else kept
    return values.withColumn("prefix", _prefix(bits)).join(below, ["field_name", "prefix"], "left_semi").drop("prefix")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def frequent_values(values: DataFrame, min_share: float | None = None, k: int | None = None, prefix_bits: tuple[int, ...] = PREFIX_BITS) -> DataFrame:
    """(field_name, item_value, n_events, n_total): the frequent values of each field.

    ``values``: field_name, item_value, one row for each event. Null and empty values do not
    count; ``n_total`` counts the others. With ``min_share`` a value is frequent when it has
    at least that share of its field's events; with ``k`` when it is among the ``k`` most
    counted, equal counts in ascending order of the value. Both together must both hold.
    An empty table gives no rows; a field of few values may give fewer than ``k``.

    At most 1 / min_share prefixes (or, by ``k``, those whose count reaches the count of the
    k-th best value found so far) are kept in a round; only the totals and bounds of the
    fields reach the driver.
    """
    if min_share is None and k is None:
        raise ValueError("give min_share or k")
    rows = values.where(F.col("item_value").isNotNull() & (F.col("item_value") != "")).select("field_name", "item_value").withColumn("h", F.xxhash64("item_value"))
    kept, before, totals, floors = None, 0, {}, {}
    for bits in prefix_bits:
        counts = _retained(rows, kept, before).groupBy("field_name", _prefix(bits).alias("prefix")).agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not totals:
                totals = {r["field_name"]: r["n"] for r in counts.groupBy("field_name").agg(F.sum("n").alias("n")).collect()}
                floors = {f: math.ceil(min_share * n - 1e-9) if min_share else 1 for f, n in totals.items()}
                if k is not None:
                    floors = _kth_bounds(rows, counts, bits, k, floors)
            reach = _any([(F.col("field_name") == f) & (F.col("n") >= n) for f, n in floors.items()] or [F.lit(False)])
            kept = cut_lineage(counts.where(reach).select("field_name", "prefix"))
        finally:
            counts.unpersist()
        before = bits
    full = _retained(rows, kept, before).groupBy("field_name", "item_value").agg(F.count("*").alias("n_events"))
    full = full.where(_any([(F.col("field_name") == f) & (F.col("n_events") >= n) for f, n in floors.items()] or [F.lit(False)]))
    if k is not None:
        best = Window.partitionBy("field_name").orderBy(F.col("n_events").desc(), F.col("item_value"))
        full = full.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")
    total = F.lit(None).cast("bigint")
    for f, n in totals.items():
        total = F.when(F.col("field_name") == f, F.lit(n).cast("bigint")).otherwise(total)
    return full.withColumn("n_total", total)


def _kth_bounds(rows: DataFrame, counts: DataFrame, bits: int, k: int, floors: dict[str, int]) -> dict[str, int]:
    """Lower bound of the k-th best count: the k-th best of the values below the k largest prefixes."""
    best = Window.partitionBy("field_name").orderBy(F.col("n").desc(), F.col("prefix"))
    probes = cut_lineage(counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("field_name", "prefix"))
    found = _retained(rows, probes, bits).groupBy("field_name", "item_value").agg(F.count("*").alias("n"))
    place = Window.partitionBy("field_name").orderBy(F.col("n").desc())
    bounds = {r["field_name"]: r["n"] for r in found.withColumn("place", F.row_number().over(place)).where(F.col("place") == k).collect()}
    return {f: max(n, bounds.get(f, 1)) for f, n in floors.items()}


def telemetry_events(telemetry: DataFrame) -> DataFrame:
    """(file_path, event_type): one row for each event, in the form in which values are compared.

    Rows with the same id are one event; where they differ, the one that sorts last by
    (timestamp, file_path, event_type) counts. Rows without an id are one event each.
    """
    known = (
        telemetry.where(F.col("id").isNotNull())
        .select("id", F.struct("timestamp", "file_path", "event_type").alias("row"))
        .groupBy("id").agg(F.max("row").alias("row")).select("row.file_path", "row.event_type")
    )
    events = known.unionByName(telemetry.where(F.col("id").isNull()).select("file_path", "event_type"))
    kind = F.lower(F.regexp_replace("event_type", r"^\s+|\s+$", ""))
    return events.select(resolve_path(F.col("file_path")).alias("file_path"), kind.alias("event_type"))


def stacked(rows: DataFrame, *fields: str) -> DataFrame:
    """(field_name, item_value): the values of several fields as one column."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("item_value")) for f in fields])
    return rows.select(F.explode(pairs).alias("v")).select("v.field_name", "v.item_value")


def p3_found(spark, folder: str) -> DataFrame:
    return _telemetry(spark, folder, min_share=0.005).select("field_name", "item_value")


def p3_top(spark, folder: str) -> DataFrame:
    """The 20 most frequent values of each field with their counts."""
    return _telemetry(spark, folder, k=20).select("field_name", "item_value", "n_events", "n_total")


def _telemetry(spark, folder: str, **how) -> DataFrame:
    events = telemetry_events(read_table(spark, folder, "telemetry")).persist(StorageLevel.MEMORY_AND_DISK)  # read by every round; lost parts are made again
    try:
        return cut_lineage(frequent_values(stacked(events, "file_path", "event_type"), **how))  # few rows, after which nothing reads the events
    finally:
        events.unpersist()
