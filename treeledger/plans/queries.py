"""Queries of the catalogue operators: each reads its whole tables. Times are taken against the newest row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeledger.functions.paths import inside_root, last_dot, normal_hash, project_of, resolve_path
from treeledger.functions.text import file_type_relevance, recency, token_estimate
from treeledger.operators import catalogue as cat
from treeledger.operators import changes, extract, graph, lifecycle, maintenance, memory, outline, projects, ranking, report, search
from treeledger.session import read_table
from treeledger.streaming.events import stream_type_counts

DAY_MS = 86_400_000


def _files(s: SparkSession, d: str) -> DataFrame:
    return cat.newest_files(read_table(s, d, "files"))


def _newest(files: DataFrame, column: str = "last_checked") -> int:
    return files.agg(F.max(column)).first()[0] or 0


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.import_edges(read_table(s, d, "imports"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return report.distinct_events(read_table(s, d, "telemetry"))


def _last_delivery(s: SparkSession, d: str) -> DataFrame:
    """(path, hash) of the last delivered state of every path."""
    row = F.struct("snapshot_no", "last_checked", normal_hash(F.col("hash")).alias("hash"))
    rows = read_table(s, d, "file_snapshots").select(resolve_path(F.col("path")).alias("path"), row.alias("row")).where("path <> ''")
    return rows.groupBy("path").agg(F.max("row").getField("hash").alias("hash"))


def _sources(s: SparkSession, d: str) -> DataFrame:
    row = F.struct("mtime", "contents")
    rows = read_table(s, d, "source_files").select(resolve_path(F.col("path")).alias("path"), row.alias("row")).where("path <> ''")
    return rows.groupBy("path").agg(F.max("row").getField("contents").alias("contents"))


def scan_files(s, d):
    """Paths that a scan keeps, with two include and one exclude pattern."""
    files = _files(s, d)
    return files.where(cat.scannable(F.col("path"), ["*.ts", "*.js", "/src/"], ["/tests/"])).select("path", cat.indexable(F.col("path")).alias("indexable"))


def path_scope(s, d):
    return _files(s, d).where(cat.in_scope(F.col("path"), "./commons-hub-0/src/")).select("path", last_dot(F.col("path")).alias("extension"))


def stale_files(s, d):
    files = read_table(s, d, "files")
    return cat.stale(cat.newest_files(files), F.lit(_newest(files))).select("path", "last_checked")


def file_freshness(s, d):
    files = read_table(s, d, "files")
    return cat.freshness(cat.newest_files(files), _last_delivery(s, d), F.lit(_newest(files)))


def capped_exports(s, d):
    return cat.capped_exports(_files(s, d), 1)


def entry_points(s, d):
    return cat.entry_points(_files(s, d))


def change_detection(s, d):
    return changes.compare(_last_delivery(s, d), _files(s, d))


def changes_since(s, d):
    """As change_detection, changed and deleted paths only when checked in the last 20 days."""
    files = read_table(s, d, "files")
    return changes.compare(_last_delivery(s, d), cat.newest_files(files), _newest(files) - 20 * DAY_MS)


def duplicate_contents(s, d):
    texts = _sources(s, d).where(F.col("contents").isNotNull())
    return changes.duplicate_contents(texts.select("path", F.sha2("contents", 256).alias("hash")))


def source_tokens(s, d):
    """Hash, lines and estimated tokens of every source text."""
    from treeledger.functions.text import line_count

    t = F.col("contents")
    return _sources(s, d).where(t.isNotNull()).select("path", F.sha2(t, 256).alias("hash"), token_estimate(t).alias("tokens"), line_count(t).alias("lines"))


def upsert_files(s, d):
    """Catalogue after the last deliveries were written with their hashes only."""
    base = _files(s, d)
    new = _last_delivery(s, d).withColumn("last_checked", F.lit(0).cast("bigint"))
    done = maintenance.guarded_upsert(base, new)
    return done.select("path", "hash", "last_checked", F.col("summary").isNotNull().alias("has_summary"))


def touched_files(s, d):
    seen = _last_delivery(s, d)
    return maintenance.touch(_files(s, d), seen, F.lit(1).cast("bigint")).select("path", "last_checked")


def last_edges(s, d):
    e = read_table(s, d, "imports").where(F.col("source").isNotNull() & F.col("target").isNotNull())
    rows = e.select(resolve_path(F.col("source")).alias("source"), resolve_path(F.col("target")).alias("target"), "specifiers", "import_type", "indexed_at")
    return maintenance.last_edges(rows).select("source", "target", "import_type", "indexed_at", F.size("specifiers").alias("n_specifiers"))


def pruned_edges(s, d):
    return maintenance.prune_edges(_edges(s, d), _files(s, d))


def orphan_sources(s, d):
    return lifecycle.orphan_sources(_edges(s, d), _files(s, d))


def deleted_entries(s, d):
    """Edges that stay when every file that was not delivered last is deleted."""
    files = _files(s, d)
    gone = files.join(_last_delivery(s, d).select("path"), "path", "left_anti").select("path")
    edges = _edges(s, d).withColumnRenamed("src", "source")
    return maintenance.delete_entries(files, edges, gone)[1].select(F.col("source").alias("src"), "dst")


def retained_events(s, d):
    events = read_table(s, d, "telemetry")
    return maintenance.retain_since(report.distinct_events(events), F.lit(_newest(events, "timestamp")), 30).select("id", "timestamp")


def events_jsonl(s, d):
    return maintenance.to_jsonl(_events(s, d)).select("id", "line")


def event_log(s, d):
    events = read_table(s, d, "telemetry")
    found = report.event_log(report.distinct_events(events), "search_miss", _newest(events, "timestamp") - 60 * DAY_MS)
    return found.select("id", "timestamp", "metadata_json")


def latest_events(s, d):
    """The hundred latest events with their place."""
    latest = report.event_log(_events(s, d).where(F.col("id").isNotNull() & F.col("timestamp").isNotNull()), limit=100)
    return latest.withColumn("place", F.row_number().over(Window.orderBy(F.col("timestamp").desc(), "id"))).select("place", "id", "timestamp", "event_type")


def report_by_type(s, d):
    return report.events_by_type(_events(s, d))


def report_totals(s, d):
    return report.totals(_events(s, d))


def report_last_hours(s, d):
    events = read_table(s, d, "telemetry")
    return report.totals(report.since(report.distinct_events(events), _newest(events, "timestamp") - 48 * report.HOUR_MS))


def report_top_files(s, d):
    return report.top_files(_events(s, d))


def report_file_use(s, d):
    return report.files_by_use(_events(s, d))


def report_missed(s, d):
    return report.missed_queries(_events(s, d))


def report_sessions(s, d):
    return report.by_session(_events(s, d))


def age_histogram(s, d):
    files = read_table(s, d, "files")
    return report.age_histogram(cat.newest_files(files), F.lit(_newest(files)))


def token_report(s, d):
    return report.report_rows(report.token_report(read_table(s, d, "telemetry")))


def language_breakdown(s, d):
    return projects.language_breakdown(_files(s, d))


def folder_counts(s, d):
    return projects.folder_counts(_files(s, d))


def folder_counts_shallow(s, d):
    return projects.folder_counts(_files(s, d), 2)


def import_edges(s, d):
    return _edges(s, d)


def node_degrees(s, d):
    return graph.degrees(_edges(s, d))


def most_connected(s, d):
    return graph.most_connected(_edges(s, d)).select("node", "degree")


def graph_summary(s, d):
    return graph.summary(_edges(s, d))[0]


def graph_adjacency(s, d):
    """Edges of the 50 most connected files."""
    return graph.summary(_edges(s, d))[1]


def node_centrality(s, d):
    c = graph.node_centrality(_edges(s, d))
    return c.select("node", F.round("centrality", 9).alias("centrality"))


def symbol_edges(s, d):
    return graph.symbol_edges(read_table(s, d, "imports"))


def symbol_usage(s, d):
    """Edges and importing files of each symbol."""
    return graph.symbol_edges(read_table(s, d, "imports")).groupBy("symbol").agg(F.count("*").alias("n_edges"), F.countDistinct("source").alias("n_sources"))


def _starts(s, d) -> DataFrame:
    return cat.entry_points(_files(s, d)).select(F.col("path").alias("node"))


def reach_two(s, d):
    """Files at most two imports from an entry point."""
    return graph.reach(_edges(s, d), _starts(s, d), 2)


def reach_all(s, d):
    return graph.reach(_edges(s, d), _starts(s, d)).select("node")


def dependents_all(s, d):
    """Files that reach a configuration file by any number of imports."""
    back = _edges(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    starts = _files(s, d).where(F.col("path").contains("/config/")).select(F.col("path").alias("node"))
    return graph.reach(back, starts).select("node")


def proximity(s, d):
    flagged = read_table(s, d, "task_files").where("status = 'flagged'").select(resolve_path(F.col("file_path")).alias("node"))
    return graph.proximity(_edges(s, d), flagged)


def _hub(s, d, edges) -> str:
    first = graph.most_connected(edges, 1).first()
    return first["node"] if first else ""


def related_files(s, d):
    """Files related to the most connected one."""
    edges = _edges(s, d)
    return graph.related_files(edges, _files(s, d), _hub(s, d, edges))


def rank_composite(s, d):
    return ranking.ranked(read_table(s, d, "ranked_files"))


def rank_signals(s, d):
    """Recency (half-life of a week), type relevance and task context of every file."""
    files = read_table(s, d, "files")
    newest = cat.newest_files(files)
    near = ranking.task_context(newest, read_table(s, d, "task_files"))
    base = newest.select("path", F.round(recency(F.lit(_newest(files)) - F.col("last_checked"), 7 * DAY_MS), 9).alias("recency"), file_type_relevance(F.col("path")).alias("file_type"))
    return base.join(near, "path")


def search_purpose(s, d):
    return search.search(_files(s, d), "test fold graph entry")


def search_scores(s, d):
    return search.search_scores(_files(s, d), "source batch id")


def frontier_files(s, d):
    return memory.frontier(_files(s, d), read_table(s, d, "task_files"))


def task_summaries(s, d):
    return memory.task_summary(read_table(s, d, "tasks"), read_table(s, d, "task_files"))


def sessions(s, d):
    return memory.sessions(read_table(s, d, "tasks"))


def session_unchecked(s, d):
    """Files not checked since the latest session began."""
    latest = memory.sessions(read_table(s, d, "tasks")).orderBy(F.col("started_at").desc(), "session_id").limit(1)
    return memory.checked_before(_files(s, d), latest).select("path", "last_checked")


def garbage_counts(s, d):
    files = read_table(s, d, "files")
    events = _events(s, d)
    tasks = memory.newest_tasks(read_table(s, d, "tasks"))
    return lifecycle.garbage_counts(cat.newest_files(files), _last_delivery(s, d), _edges(s, d), events, tasks, now_ms=_newest(files))


def invalidated(s, d):
    """Rows of test files, taken out of the catalogue, as events."""
    files = _files(s, d)
    tests = files.where(F.col("path").contains("/tests/"))
    return lifecycle.invalidate(files, tests, F.lit(0).cast("bigint"))[1]


def regex_summaries(s, d):
    done = extract.summarise(_sources(s, d)).where(F.col("summary").isNotNull())
    lists = [F.col(f"summary.{n}").alias(a) for n, a in (("exports", "exports"), ("imports", "imports"), ("topLevelDeclarations", "declarations"))]
    return done.select("path", "summary.purpose", "summary.lineCount", "summary.confidence", *lists)


def source_outlines(s, d):
    """Purpose line and declared names of every source."""
    return outline.outlines(_sources(s, d))


def outline_names(s, d):
    """Names that every source declares, without its purpose line."""
    return outline.outlines(_sources(s, d)).select("path", "language", "classes", "functions", "types", "constants", "lines")


def import_refs(s, d):
    files = _sources(s, d)
    refs = extract.resolve_refs(extract.import_refs(files), _files(s, d), project_of)
    return refs.select("source", "ordinal", "module", "target", "specifiers", "import_type", "external")


def diff_classes(s, d):
    rows = read_table(s, d, "source_files").select(resolve_path(F.col("path")).alias("path"), "contents", "mtime")
    return extract.diff_classes(rows)


def smart_summaries(s, d):
    """Summaries of all versions of the sources, kept over small edits."""
    rows = read_table(s, d, "source_files").select(resolve_path(F.col("path")).alias("path"), "contents", "mtime")
    done = extract.smart_summaries(rows)
    lists = [F.size(f"summary.{n}").alias(a) for n, a in (("exports", "n_exports"), ("imports", "n_imports"), ("topLevelDeclarations", "n_declarations"))]
    return done.select("path", "mtime", "summary_source", "summary.purpose", "summary.lineCount", "summary.confidence", *lists)


def summary_savings(s, d):
    """Tokens that serving summaries saves against the texts, per project."""
    from treeledger.functions.text import tokens_saved

    both = _sources(s, d).where(F.col("contents").isNotNull())
    summed = extract.summarise(both).join(both, "path")
    return summed.groupBy(project_of(F.col("path")).alias("project")).agg(F.count("*").alias("n_files"), F.sum(tokens_saved(F.col("contents"), F.col("summary"))).alias("tokens_saved"))


def _placed(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with their place; only for results that a limit has made small."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def ordered_paths(s, d):
    """The first hundred paths of a scan in byte order."""
    return _placed(_files(s, d).select("path").orderBy("path").limit(100), "path")


def known_paths(s, d):
    """Paths of the catalogue and of the texts, together."""
    texts = read_table(s, d, "source_files").select(resolve_path(F.col("path")).alias("path")).where("path <> ''")
    return _files(s, d).select("path").unionByName(texts).distinct()


def safe_paths(s, d):
    """Spellings of paths that stay below the root."""
    raw = read_table(s, d, "files").select("path").where("path is not null").distinct()
    return raw.select("path", inside_root(F.col("path")).alias("inside"))


def shown_files(s, d):
    files = _files(s, d)
    return files.where(~cat.placeholder(F.col("path"), F.col("hash"))).select("path")


def settled_sources(s, d):
    """Texts that need not be read again."""
    newest = read_table(s, d, "source_files").select(resolve_path(F.col("path")).alias("path"), "mtime").where("path <> ''").groupBy("path").agg(F.max("mtime").alias("mtime"))
    both = newest.join(_files(s, d).select("path", "last_checked"), "path", "left")
    return both.select("path", cat.settled(F.col("mtime"), F.col("last_checked")).alias("settled"))


def index_counters(s, d):
    """Files by what an index run would do with them."""
    return file_freshness(s, d).groupBy("status").agg(F.count("*").alias("n_files"))


def batch_counters(s, d):
    """Hits, misses and errors of asking for the summary of every imported file."""
    asked = _edges(s, d).select(F.col("dst").alias("path")).distinct()
    there = _files(s, d).select("path", F.col("summary").isNotNull().alias("hit"))
    found = asked.join(there, "path", "left")
    return found.agg(F.count_if("hit").alias("n_hits"), F.count_if(~F.col("hit")).alias("n_misses"), F.count_if(F.col("hit").isNull()).alias("n_errors"))


def cleared_summaries(s, d):
    return maintenance.clear_summaries(_files(s, d)).select("path", "hash", "last_checked", F.col("summary").isNull().alias("cleared"))


def removed_node(s, d):
    """Edges without the most connected file."""
    edges = _edges(s, d)
    left = maintenance.remove_node(edges.select(F.col("src").alias("source"), F.col("dst").alias("target")), _hub(s, d, edges))
    return left.select(F.col("source").alias("src"), F.col("target").alias("dst"))


def sampled_events(s, d):
    """A tenth of the events, by a hash of the id."""
    return maintenance.sample_events(_events(s, d).where("id is not null"), 0.1).select("id", "timestamp", "event_type")


def session_totals(s, d):
    """Totals of the events since the latest session began."""
    latest = memory.sessions(read_table(s, d, "tasks")).orderBy(F.col("started_at").desc(), "session_id").limit(1)
    start = latest.agg(F.max("started_at")).first()[0]
    return report.totals(report.since(_events(s, d), start))


def formatted_counts(s, d):
    """Counts by type as a report prints them."""
    counts = report.events_by_type(_events(s, d))
    total = counts.agg(F.sum("n_events")).first()[0] or 1
    return counts.select("event_type", F.format_number("n_events", 0).alias("shown"), F.concat(F.format_number(F.round(F.col("n_events") * 100 / F.lit(total), 1), 1), F.lit("%")).alias("share"))


def hub_neighbourhood(s, d):
    """Files at most two imports from the most connected one, either way."""
    edges = _edges(s, d)
    return graph.neighbourhood(edges, _hub(s, d, edges), "both", 2)


def candidate_centrality(s, d):
    """Centrality of the entry points among themselves."""
    c = graph.node_centrality(_edges(s, d), _starts(s, d))
    return c.select("node", "degree", F.round("centrality", 9).alias("centrality"))


def related_ranked(s, d):
    """Files related to the most connected one, with their score (half-life of a week)."""
    edges, files = _edges(s, d), read_table(s, d, "files")
    none = memory.newest_task_files(read_table(s, d, "task_files")).where(F.lit(False))
    scored = ranking.rank_related(edges, cat.newest_files(files), _hub(s, d, edges), none, F.lit(_newest(files)), 7 * DAY_MS)
    return scored.select("path", ranking.relationship_score(F.col("relationship")).alias("relationship"), F.round("score", 9).alias("score"))


def served_lines(s, d):
    """Matches of a search and ten times their mean line count."""
    files = _files(s, d)
    hits = search.search(files, "test fold graph entry").join(files.select("path", "summary.lineCount"), "path")
    return hits.agg(F.count("*").alias("n_results"), F.round(F.avg("lineCount") * 10).cast("bigint").alias("tokens"))


def latest_sessions(s, d):
    return _placed(memory.sessions(read_table(s, d, "tasks")).orderBy(F.col("started_at").desc(), "session_id").limit(10), F.col("started_at").desc(), "session_id")


def latest_tasks(s, d):
    """The ten active tasks that were updated last."""
    order = F.col("updated_at").desc(), F.col("id")
    active = memory.newest_tasks(read_table(s, d, "tasks")).where("state = 'active'").orderBy(*order).limit(10)
    return _placed(active, *order).select("place", "id", "name", "updated_at")


def activated_tasks(s, d):
    return memory.activated(read_table(s, d, "tasks"), read_table(s, d, "task_files"))


def task_files_left(s, d):
    """Files of the tasks that a collection leaves."""
    tasks = memory.newest_tasks(read_table(s, d, "tasks"))
    done = tasks.where(F.col("state").isin("completed", "archived"))
    return memory.delete_tasks(tasks, memory.newest_task_files(read_table(s, d, "task_files")), done)[1].select("task_id", "file_path", "status", "explored_at")


def explored_files(s, d):
    """Files of the largest task in the order in which they were explored."""
    rows = memory.newest_task_files(read_table(s, d, "task_files"))
    largest = rows.groupBy("task_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "task_id").limit(1)
    return rows.join(largest, "task_id", "left_semi").select("file_path", "status", "notes", "explored_at").orderBy("explored_at", "file_path")


def generation_actions(s, d):
    """What each of the tags made from the tasks' times would do to summaries of two modes."""
    tag = F.concat(F.element_at(F.array(*map(F.lit, ("ast:", "regex:", "Ast:", ""))), (F.col("created_at") % 4 + 1).cast("int")), (F.col("updated_at") % 5).cast("string"))
    tags = memory.newest_tasks(read_table(s, d, "tasks")).select("id", tag.alias("tag"))
    return tags.select("id", "tag", lifecycle.generation_action(F.col("tag"), "regex").alias("regex_action"), lifecycle.generation_action(F.col("tag"), "ast").alias("ast_action"))


def iso_times(s, d):
    """Times of documents written as ISO text and read again."""
    at = F.col("updated_at").cast("timestamp")
    text = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return read_table(s, d, "documents").select("doc_id", text.alias("iso"), changes.since_ms(text).alias("ms"))


def first_sentences(s, d):
    """First sentence of the first line of every document."""
    line = F.substring_index(F.regexp_replace("text", r"\r", ""), "\n", 1)
    return read_table(s, d, "documents").where("text is not null").select("doc_id", outline.first_sentence(line).alias("sentence"))


CATALOGUE = {
    f.__name__: f
    for f in (
        scan_files, path_scope, stale_files, file_freshness, capped_exports, entry_points, change_detection, changes_since, duplicate_contents, source_tokens,
        upsert_files, touched_files, last_edges, pruned_edges, orphan_sources, deleted_entries, retained_events, events_jsonl, event_log, latest_events,
        report_by_type, report_totals, report_last_hours, report_top_files, report_file_use, report_missed, report_sessions, age_histogram, token_report,
        language_breakdown, folder_counts, folder_counts_shallow, import_edges, node_degrees, most_connected, graph_summary, graph_adjacency, node_centrality, symbol_edges, symbol_usage,
        reach_two, reach_all, dependents_all, proximity, related_files, rank_composite, rank_signals, search_purpose, search_scores,
        frontier_files, task_summaries, sessions, session_unchecked, garbage_counts, invalidated, regex_summaries, source_outlines, outline_names, import_refs, diff_classes, smart_summaries, summary_savings, stream_type_counts,
        ordered_paths, known_paths, safe_paths, shown_files, settled_sources, index_counters, batch_counters, cleared_summaries, removed_node, sampled_events, session_totals, formatted_counts,
        hub_neighbourhood, candidate_centrality, related_ranked, served_lines, latest_sessions, latest_tasks, activated_tasks, task_files_left, explored_files, generation_actions, iso_times, first_sentences,
    )
}
