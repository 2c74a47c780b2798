"""Reports over the telemetry log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions.paths import resolve_path
from treeledger.session import cut_lineage

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
# The known event types.
KINDS = ("cache_hit", "cache_miss", "invalidation", "force_reread", "summary_served", "search_miss")
#: Event types whose tokens count as saved.
SAVING = ("cache_hit", "summary_served")
AGES = ("<1 day", "1-7 days", "7-30 days", ">30 days")


def distinct_events(telemetry: DataFrame) -> DataFrame:
    """One row for each id, the one that sorts last by time, path and type; cleaned type and path.

    Rows without an id are one event each. Empty paths become null.
    """
    row = F.struct("timestamp", "file_path", "event_type", "tokens_estimated", "metadata_json")
    known = telemetry.where(F.col("id").isNotNull()).select("id", row.alias("row")).groupBy("id").agg(F.max("row").alias("row")).select("id", "row.*")
    events = known.unionByName(telemetry.where(F.col("id").isNull()).select(*known.columns))
    kind = F.lower(F.regexp_replace("event_type", r"^\s+|\s+$", ""))
    return events.select("id", "timestamp", kind.alias("event_type"), F.nullif(resolve_path(F.col("file_path")), F.lit("")).alias("file_path"), "tokens_estimated", "metadata_json")


def since(events: DataFrame, since_ms: Column | int | None) -> DataFrame:
    """Events at or after a time; None and 0 keep all."""
    return events if since_ms is None or isinstance(since_ms, int) and since_ms == 0 else events.where(F.col("timestamp") >= since_ms)


def event_log(events: DataFrame, event_type: str | None = None, since_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """Events of a type from a time on, the latest first; what is None, '' or 0 does not count."""
    found = since(events, since_ms)
    found = found.where(F.col("event_type") == event_type) if event_type else found
    ordered = found.orderBy(F.col("timestamp").desc(), "id")
    return ordered.limit(limit) if limit else ordered


def events_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n_events"))


def totals(events: DataFrame) -> DataFrame:
    """One row: events, hits, misses, hit ratio (0 without either) and tokens saved."""
    saved = F.sum(F.when(F.col("event_type").isin(*SAVING), F.col("tokens_estimated")))
    counted = events.agg(F.count("*").alias("total_events"), F.count_if(F.col("event_type") == "cache_hit").alias("cache_hits"), F.count_if(F.col("event_type") == "cache_miss").alias("cache_misses"), F.coalesce(saved, F.lit(0)).alias("tokens_saved"))
    asked = F.col("cache_hits") + F.col("cache_misses")
    return counted.withColumn("hit_ratio", F.when(asked > 0, F.col("cache_hits") / asked).otherwise(0.0))


def files_by_use(events: DataFrame) -> DataFrame:
    """(file_path, n_events, tokens, last_at) over all event types."""
    named = events.where(F.col("file_path").isNotNull())
    return named.groupBy("file_path").agg(F.count("*").alias("n_events"), F.sum(F.coalesce("tokens_estimated", F.lit(0))).alias("tokens"), F.max("timestamp").alias("last_at"))


def top_files(events: DataFrame, limit: int = 10) -> DataFrame:
    """The files of most events; equal ones by the latest event, then the path."""
    return files_by_use(events).orderBy(F.col("n_events").desc(), F.col("last_at").desc(), "file_path").limit(limit)


def missed_query(events: DataFrame) -> Column:
    """The query of a search without a result, when its metadata holds a string; malformed JSON has none."""
    value = F.expr("try_variant_get(try_parse_json(metadata_json), '$.query', 'variant')")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.when(events["event_type"] == "search_miss", text)


def missed_queries(events: DataFrame) -> DataFrame:
    """(query, n_missed): searches without a result, only those with a string as query."""
    asked = events.where(F.col("event_type") == "search_miss").select(missed_query(events).alias("query")).where(F.col("query").isNotNull())
    return asked.groupBy("query").agg(F.count("*").alias("n_missed"))


def by_session(events: DataFrame) -> DataFrame:
    """Totals per session named in the metadata, with its first and last event."""
    named = events.withColumn("session", F.expr("try_variant_get(try_parse_json(metadata_json), '$.session', 'string')")).where(F.col("session").isNotNull())
    saved = F.sum(F.when(F.col("event_type").isin(*SAVING), F.col("tokens_estimated")))
    return named.groupBy("session").agg(F.count("*").alias("n_events"), F.coalesce(saved, F.lit(0)).alias("tokens_saved"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"))


def age_histogram(catalogue: DataFrame, now_ms: Column) -> DataFrame:
    """(age, n_files) with all four ages always present."""
    days = (now_ms - F.col("last_checked")) / F.lit(DAY_MS)
    age = F.when(days < 1, AGES[0]).when(days < 7, AGES[1]).when(days < 30, AGES[2]).otherwise(AGES[3])
    counts = catalogue.select(age.alias("age")).groupBy("age").agg(F.count("*").alias("n"))
    labels = catalogue.sparkSession.createDataFrame([(a,) for a in AGES], "age string")
    return labels.join(counts, "age", "left").select("age", F.coalesce("n", F.lit(0)).alias("n_files"))


def token_report(telemetry: DataFrame, since_ms: int | None = None) -> DataFrame:
    """The whole report as one row: totals, counts by type, top files and missed queries.

    Types outside of the known ones are counted together as ``other``, so the row stays
    small. The log is read once: its events are counted by type, file and query, and these
    counts, written once, feed all parts.
    """
    events = since(distinct_events(telemetry), since_ms)
    kind = F.when(F.col("event_type").isin(*KINDS), F.col("event_type")).otherwise("other")
    rows = events.select(kind.alias("event_type"), "file_path", missed_query(events).alias("query"), "tokens_estimated", "timestamp")
    counted = cut_lineage(rows.groupBy("event_type", "file_path", "query").agg(F.count("*").alias("n"), F.sum("tokens_estimated").alias("tokens"), F.max("timestamp").alias("last_at")))
    n = F.sum("n")
    hits, misses = (F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("n"))), F.lit(0)) for k in ("cache_hit", "cache_miss"))
    saved = F.sum(F.when(F.col("event_type").isin(*SAVING), F.col("tokens")))
    sums = counted.agg(F.coalesce(n, F.lit(0)).alias("total_events"), hits.alias("cache_hits"), misses.alias("cache_misses"), F.coalesce(saved, F.lit(0)).alias("tokens_saved"))
    asked = F.col("cache_hits") + F.col("cache_misses")
    out = sums.withColumn("hit_ratio", F.when(asked > 0, F.col("cache_hits") / asked).otherwise(0.0))
    kinds = counted.groupBy("event_type").agg(n.alias("n_events")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n_events")))).alias("events_by_type"))
    named = counted.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(n.alias("n_events"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.max("last_at").alias("last_at"))
    missed = counted.where(F.col("query").isNotNull()).groupBy("query").agg(n.alias("n_missed"))
    files = _best(named, [F.col("n_events").desc(), F.col("last_at").desc(), F.col("file_path")], "top_files", "file_path", "n_events", "tokens")
    queries = _best(missed, [F.col("n_missed").desc(), F.col("query")], "top_missed_queries", "query", "n_missed")
    for part in (kinds, files, queries):  # one row each, as are the totals
        out = out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns])


def _best(rows: DataFrame, order: list[Column], name: str, *fields: str) -> DataFrame:
    """One row with the ten first rows as an ordered list."""
    ten = rows.orderBy(*order).limit(10).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # ten rows, so one task will do
    listed = F.array_sort(F.collect_list(F.struct("place", *fields)))
    return ten.agg(F.transform(listed, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def report_rows(report: DataFrame) -> DataFrame:
    """(part, item, n, tokens, ratio): a report as rows, for tables and comparisons."""
    none, ratio = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    row = lambda part, item, n, tokens=none, ratio=ratio: F.struct(F.lit(part).alias("part"), item.alias("item"), n.alias("n"), tokens.alias("tokens"), ratio.alias("ratio"))
    sums = [row("totals", F.lit(c), F.col(c)) for c in ("total_events", "cache_hits", "cache_misses", "tokens_saved")]
    lists = (
        F.array(*sums, row("totals", F.lit("hit_ratio"), none, none, F.col("hit_ratio"))),
        F.transform(F.map_entries("events_by_type"), lambda e: row("kinds", e["key"], e["value"])),
        F.transform("top_files", lambda f: row("top_files", f["file_path"], f["n_events"], f["tokens"])),
        F.transform("top_missed_queries", lambda q: row("top_missed", q["query"], q["n_missed"])),
    )
    return report.select(F.explode(F.concat(*lists)).alias("r")).select("r.*")
