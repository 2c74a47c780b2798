"""Comparing a scan with the catalogue."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_since(text: str | None) -> int | None:
    """Epoch milliseconds of an ISO time, in UTC without a zone; None for nothing, ``last_check`` and what is no time."""
    try:
        at = datetime.fromisoformat(text.strip()) if text and text != "last_check" else None
    except ValueError:
        return None
    return None if at is None else int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def since_ms(text: Column) -> Column:
    """As ``parse_since`` for a column of times."""
    return F.when(text != "last_check", F.unix_millis(F.try_to_timestamp(text)))


def compare(scan: DataFrame, catalogue: DataFrame, since_ms: int | None = None) -> DataFrame:
    """(path, status) with status added, changed, deleted or unchanged.

    ``scan`` and ``catalogue``: path, hash, one row for each path; the catalogue also has
    last_checked. A null hash in the scan is an unreadable file and counts as changed. With
    ``since_ms``, changed and deleted paths are only told when last checked at or after it.
    """
    s = scan.select("path", F.col("hash").alias("now"), F.lit(True).alias("in_scan"))
    c = catalogue.select("path", F.col("hash").alias("then"), "last_checked", F.lit(True).alias("in_catalogue"))
    both = s.join(c, "path", "full")
    status = (
        F.when(F.col("in_catalogue").isNull(), "added")
        .when(F.col("in_scan").isNull(), "deleted")
        .when(F.col("now").isNull() | ~F.col("now").eqNullSafe(F.col("then")), "changed")
        .otherwise("unchanged")
    )
    out = both.withColumn("status", status)
    if since_ms:
        out = out.where(~F.col("status").isin("changed", "deleted") | (F.col("last_checked") >= since_ms))
    return out.select("path", "status")


def duplicate_contents(catalogue: DataFrame) -> DataFrame:
    """(hash, n_paths) of contents that several paths share."""
    return catalogue.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.count("*").alias("n_paths")).where("n_paths > 1")
