"""The operations on one catalogue: a tree of sources, its stored tables and their reports.

Methods that change tables commit new versions through the store. What an operation reads
from the tree is written once to the shared folder before it is hashed, summarised and
stored, so that a file edited in between cannot be stored with a summary of other contents;
edges are committed before hashes, so a crash between them only makes a file be read again.
Results are DataFrames, so callers decide what reaches the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.paths import basename, dirname, validated
from treeledger.functions.text import tokens_saved
from treeledger.operators import catalogue as cat
from treeledger.operators import changes, extract, graph, lifecycle, maintenance, memory, outline, projects, ranking, report, search
from treeledger.session import cut_lineage
from treeledger.sources import tree
from treeledger.sources.config import Settings, load_settings, operations
from treeledger.sources.store import TableStore

SUMMARY = "struct<purpose:string,exports:array<string>,imports:array<string>,lineCount:int,topLevelDeclarations:array<string>,confidence:string>"
SCHEMAS = {
    "files": f"path string, hash string, last_checked bigint, summary {SUMMARY}",
    "imports": "source string, target string, specifiers array<string>, import_type string",
    "tasks": "id string, name string, state string, created_at bigint, updated_at bigint, session_id string, metadata_json string",
    "task_files": "task_id string, file_path string, status string, notes string, explored_at bigint",
    "telemetry": "id bigint, timestamp bigint, event_type string, file_path string, tokens_estimated bigint, metadata_json string",
    "sessions": "id string, started_at bigint, ended_at bigint, metadata_json string",
    "meta": "key string, value string",
}
GENERATION_KEY = "summarizer_generation"


@dataclass(frozen=True)
class Batch:
    """Summaries of several files, how many were stored ones, and what could not be read."""

    results: DataFrame
    hits: int
    misses: int
    errors: dict[str, str]


def _now() -> int:
    return int(time.time() * 1000)


class Ledger:
    def __init__(self, spark: SparkSession, root: str, store: str | None = None, settings: Settings | None = None):
        self.spark, self.root = spark, str(Path(root).resolve())
        self.settings = settings or load_settings(root)
        self.store = TableStore(spark, store or f"{self.root}/.treeledger")
        self.operations = operations(self.settings)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name) if self.store.exists(name) else self._frame(name, [])

    def _frame(self, name: str, rows: list) -> DataFrame:
        return self.spark.createDataFrame(rows, SCHEMAS[name])

    def _paths(self, paths: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in paths], "path string")

    def listing(self) -> DataFrame:
        most = int(self.settings.max_files) if self.settings.max_files else None
        return tree.listing(self.spark, self.root, exclude=self.settings.ignore, max_files=most)

    def scan(self) -> DataFrame:
        return tree.read_files(self.spark, self.root, self.listing()).where(F.col("hash").isNotNull())

    def edges(self) -> DataFrame:
        return self.table("imports").select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()

    # summaries and their generation

    def _summarise(self, files: DataFrame) -> DataFrame:
        """(path, summary) by the mode of the settings."""
        made = outline.summarise(files) if self.settings.summarizer == "ast" else extract.summarise(files)
        return made.select("path", F.col("summary").cast(SUMMARY).alias("summary"))

    def _reconcile(self) -> bool:
        """Clear or retag the stored summaries where another mode or generation made them; False when a newer one owns them."""
        mode = self.settings.summarizer
        tag = F.lit(self.get_meta(GENERATION_KEY)).cast("string")
        action = self.spark.range(1).select(lifecycle.generation_action(tag, mode).alias("action")).first()["action"]
        if action == "clear" and self.store.exists("files"):
            self.store.commit("files", maintenance.clear_summaries(self.table("files")))
        if action in ("clear", "retag"):
            self.set_meta(GENERATION_KEY, f"{mode}:{lifecycle.GENERATION}")
        return action != "block"

    def _store(self, fresh: DataFrame, known: DataFrame, gone: DataFrame, summaries: DataFrame | None, seen: DataFrame | None = None) -> None:
        """Edges, then hashes and summaries, of files that were read; files of ``gone`` leave, those of ``seen`` are touched.

        ``known``: the paths that references may mean. Without ``summaries`` the stored ones
        of these files are cleared, as they were made from other contents.
        """
        refs = extract.resolve_refs(extract.import_refs(fresh.where(cat.indexable(F.col("path")))), known)
        files, edges = maintenance.delete_entries(self.table("files"), self.table("imports"), gone)
        self.store.commit("imports", maintenance.replace_edges(edges, refs, fresh))
        made = F.lit(None).cast(SUMMARY).alias("summary")
        rows = fresh.select("path", "hash", F.lit(_now()).alias("last_checked"))
        rows = rows.select("*", made) if summaries is None else rows.join(summaries, "path", "left")
        touched = files if seen is None else maintenance.touch(files, seen, F.lit(_now()))
        self.store.commit("files", maintenance.upsert(touched, rows.select("path", "hash", "last_checked", "summary")))

    def index(self, rebuild: bool = False) -> dict[str, int]:
        """Bring files, summaries and edges up to date.

        Texts are read only where the file is new, has no summary or may have changed since it
        was last checked; with ``rebuild`` all are. Of those only the ones with another hash
        are summarised again.
        """
        writable = self._reconcile()
        listed, stored = cut_lineage(self.listing()), self.table("files")
        settled = F.col("summary").isNotNull() & cat.settled(F.col("mtime"), F.col("last_checked"))
        known = listed.join(stored.select("path", "last_checked", "summary"), "path", "left")
        skipped = known.where(settled).count() if not rebuild else 0
        read = cut_lineage(tree.read_files(self.spark, self.root, known if rebuild else known.where(~settled)))
        there = read.where(F.col("hash").isNotNull())
        state = cat.freshness(stored.join(there.select("path"), "path", "left_semi"), there, F.lit(_now())).select("path", "status")
        state = state.withColumn("status", F.when(F.lit(rebuild) & (F.col("status") == "hit"), "again").otherwise(F.col("status")))
        counts = {r["status"]: r["count"] for r in state.groupBy("status").count().collect()}
        # Listed files that cannot be read are gone, as are stored ones that are no longer listed.
        gone = stored.select("path").join(listed.select("path"), "path", "left_anti").unionByName(read.where(F.col("hash").isNull()).select("path"))
        n_gone = gone.join(stored.select("path"), "path", "left_semi").count()
        fresh = there.join(state.where("status <> 'hit'").select("path"), "path", "left_semi")
        here = listed.select("path").join(read.where(F.col("hash").isNull()).select("path"), "path", "left_anti")
        self._store(fresh, here, gone, self._summarise(fresh) if writable else None, state.where("status = 'hit'"))
        made = sum(n for s, n in counts.items() if s != "hit")
        return {"scanned": skipped + sum(counts.values()), "fresh": skipped + counts.get("hit", 0), "summarized": made, "deleted": n_gone}

    def collect_garbage(self, dry_run: bool = False) -> dict[str, int]:
        """Remove deleted and stale files, orphan edges, old events and old finished tasks; only count them in a dry run."""
        ages, now = self.settings.ages, _now()
        files, imports, events, tasks = (self.table(n) for n in ("files", "imports", "telemetry", "tasks"))
        found = lifecycle.garbage(
            files, self.listing().where(F.col("size").isNotNull()), imports.withColumnRenamed("source", "src"), events, tasks, now,
            ages["cacheMaxAgeDays"], ages["telemetryMaxAgeDays"], ages["taskMaxAgeDays"],
        )
        found = {name: cut_lineage(rows) for name, rows in found.items()}
        counts = {name: rows.count() for name, rows in found.items()}
        if not dry_run:
            gone = found["deleted_files"].select("path").unionByName(found["stale_files"].select("path"))
            left = files.join(gone, "path", "left_anti")
            self.store.commit("imports", lifecycle.kept_edges(imports, left))
            self.store.commit("files", left)
            kept = memory.delete_tasks(tasks, self.table("task_files"), found["old_tasks"])
            self.store.commit("task_files", kept[1])
            self.store.commit("tasks", kept[0])
            self.store.commit("telemetry", maintenance.retain_since(events, F.lit(now), ages["telemetryMaxAgeDays"]))
        return counts

    # the thirteen operations

    def get_project_map(self, depth: int = 2) -> dict[str, DataFrame]:
        """Folders, files, languages and entry points of the tree; files without a stored summary are summarised for the map.

        Empty ``.gitkeep`` files are not told; files below ``depth`` neither, but languages count all.
        """
        listed, stored = cut_lineage(self.listing().where(F.col("size").isNotNull())), self.table("files")
        left = listed.join(stored.where(F.col("summary").isNotNull()), "path", "left_anti")
        made = self._summarise(tree.read_files(self.spark, self.root, left).where(F.col("hash").isNotNull()))
        files = cut_lineage(stored.select("path", "summary").where(F.col("summary").isNotNull()).join(listed.select("path"), "path", "left_semi").unionByName(made))
        shown = listed.where(~((basename(F.col("path")) == ".gitkeep") & (F.col("size") == 0))).select("path")
        placed = shown.withColumn("folder", dirname(F.col("path"))).where((F.col("folder") == ".") | (F.size(F.split("folder", "/")) <= depth))
        named = placed.join(files.select("path", "summary.purpose"), "path", "left").select("folder", basename(F.col("path")).alias("name"), "purpose")
        return {
            "folders": projects.folder_counts(shown, depth).orderBy("folder"),
            "files": named.orderBy("folder", "name"),
            "languages": projects.language_breakdown(listed),
            "entry_points": cat.entry_points(files).orderBy("path"),
            "total_files": listed.agg(F.count("*").alias("n_files")),
        }

    def get_related_files(self, path: str, limit: int = 10, task_id: str | None = None) -> DataFrame:
        """Related files with their score, best first. A task's files are further anchors and give the task signal."""
        path = validated(self.root, path)
        touched = memory.newest_task_files(self.table("task_files")).where(F.lit(False) if task_id is None else F.col("task_id") == task_id)
        scored = ranking.rank_related(self.edges(), self.table("files"), path, touched, F.lit(_now())).orderBy(F.col("score").desc(), "path")
        return scored.limit(limit) if limit > 0 else scored

    def get_dependency_graph(self, path: str | None = None, direction: str = "both", depth: int | None = None, symbol: str | None = None, limit: int = 50) -> dict[str, DataFrame]:
        """``edges`` and ``totals`` around a path, of a symbol, or of the most connected files, then with ``most_connected``."""
        edges = self.edges()
        if symbol:
            found = graph.symbol_edges(self.table("imports"), symbol, resolved=True)
            found = found if path is None else found.where((F.col("source") == validated(self.root, path)) | (F.col("target") == validated(self.root, path)))
            ends = found.select(F.explode(F.array("source", "target")).alias("node"))
            return {"edges": found.orderBy("source", "target"), "totals": self._totals(ends, found)}
        if path is None:
            totals, shown = graph.summary(edges, limit)
            return {"edges": shown, "totals": totals, "most_connected": graph.most_connected(edges, 10)}
        path = validated(self.root, path)
        around = graph.neighbourhood(edges, path, direction, depth)
        return {"edges": around.orderBy("direction", "node"), "totals": self._totals(around.select("node").unionByName(self._paths([path]).toDF("node")), around)}

    def _totals(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """One row: distinct nodes and edges."""
        n_nodes, n_edges = nodes.agg(F.countDistinct("node").alias("total_files"), F.lit(1).alias("one")), edges.agg(F.count("*").alias("total_edges"), F.lit(1).alias("one"))
        return n_nodes.join(n_edges, "one").drop("one")

    def get_changed_files(self, since: str | int | None = None) -> DataFrame:
        """(path, status) of added, changed and deleted files. ``since`` is an ISO time or epoch milliseconds."""
        since_ms = since if isinstance(since, int) else changes.parse_since(since)
        return changes.compare(self.scan(), self.table("files"), since_ms).where("status <> 'unchanged'").orderBy("path")

    def get_file_summary(self, path: str) -> DataFrame:
        """As ``batch_file_summaries`` for one path; a path out of the tree or without a file is an error."""
        found = self.batch_file_summaries([path])
        for wrong in found.errors.values():
            raise ValueError(wrong)
        return found.results

    def batch_file_summaries(self, paths: list[str]) -> Batch:
        """(path, from_store, age_seconds, suggest_full_read, summary): stored summaries where the hash is the same, else new ones.

        New ones are stored with their edges. Each file is an event of use: a hit with the
        tokens that its summary saves, or a miss.
        """
        writable, errors, wanted = self._reconcile(), {}, []
        for path in dict.fromkeys(paths):
            try:
                wanted.append(validated(self.root, path))
            except ValueError as wrong:
                errors[path] = str(wrong)
        stored = self.table("files")
        read = cut_lineage(tree.read_files(self.spark, self.root, self._paths(wanted)))
        errors |= {r["path"]: f"no file {r['path']}" for r in read.where(F.col("hash").isNull()).collect()}
        there, now = read.where(F.col("hash").isNotNull()), _now()
        state = cat.freshness(stored.join(there.select("path"), "path", "left_semi"), there, F.lit(now))
        fresh = there.join(state.where("status <> 'hit'").select("path"), "path", "left_semi")
        made = cut_lineage(self._summarise(fresh))
        known = stored.where(F.col("summary").isNotNull()).join(state.where("status = 'hit'").select("path"), "path", "left_semi").select("path", "summary").unionByName(made)
        hit = F.col("status") == "hit"
        low = F.coalesce(F.col("summary.confidence") == "low", F.lit(False))
        results = cut_lineage(state.select("path", "status", "age_seconds").join(known, "path").select("path", hit.alias("from_store"), "age_seconds", low.alias("suggest_full_read"), "summary"))
        served = results.join(there.select("path", "contents"), "path").select(
            F.lit(now).alias("timestamp"), F.when(F.col("from_store"), "cache_hit").otherwise("cache_miss").alias("event_type"), F.col("path").alias("file_path"),
            F.when(F.col("from_store"), tokens_saved(F.col("contents"), F.col("summary"))).otherwise(0).cast("bigint").alias("tokens_estimated"),
        )
        self.track(served)
        hits, misses = (results.where(F.col("from_store") == flag).count() for flag in (True, False))
        if misses:
            self._store(fresh, self.listing().select("path"), self._paths([]), made if writable else None)
        return Batch(results, hits, misses, errors)

    def force_reread(self, path: str) -> DataFrame:
        """The summary of a file, made anew and stored."""
        path, writable = validated(self.root, path), self._reconcile()
        read = cut_lineage(tree.read_files(self.spark, self.root, self._paths([path])).where(F.col("hash").isNotNull()))
        made = cut_lineage(self._summarise(read))
        self._store(read, self.listing().select("path"), self._paths([]), made if writable else None)
        self.track(read.select(F.lit(_now()).alias("timestamp"), F.lit("force_reread").alias("event_type"), F.col("path").alias("file_path"), F.lit(0).cast("bigint").alias("tokens_estimated")))
        return made

    def search_by_purpose(self, query: str, limit: int = 20, prefix: str | None = None) -> DataFrame:
        """(path, purpose, score, exports, exports_truncated, confidence): the best matches whose texts are as stored.

        Matching files are read again: those that are gone leave the tables, edited ones are
        summarised, stored and scored anew and drop out when they no longer match; the others
        move up. A search is one event: served, with the mean tokens of a file, or a miss.
        """
        writable, stored = self._reconcile(), self.table("files")
        matched = search.search_scores(stored, query, prefix).select("path")
        read = cut_lineage(tree.read_files(self.spark, self.root, matched))
        there = read.where(F.col("hash").isNotNull())
        same = stored.join(there.select("path", F.col("hash").alias("today")), "path").where(F.col("hash") == F.col("today"))
        edited = there.join(same.select("path"), "path", "left_anti")
        made = cut_lineage(self._summarise(edited))
        rows = same.select("path", "summary").unionByName(made)
        best = search.search(rows, query, limit, prefix)
        full = best.join(rows, "path").join(cat.capped_exports(rows), "path").withColumn("confidence", F.col("summary.confidence"))
        out = cut_lineage(full.select("path", "purpose", "score", "exports", "exports_truncated", "confidence", F.col("summary.lineCount").alias("lines")).orderBy(F.col("score").desc(), "path"))
        n, lines = out.agg(F.count("*"), F.avg("lines")).first()
        in_scope = stored.where(F.col("summary").isNotNull() & cat.in_scope(F.col("path"), prefix)).count()
        told = lambda kind, path, tokens, more: self._frame("telemetry", [(None, _now(), kind, path, tokens, json.dumps({"query": query} | more))])
        if n:
            self.track(told("summary_served", out.orderBy(F.col("score").desc(), "path").first()["path"], int(lines * 10 + 0.5), {"resultCount": n}))
        elif in_scope:
            self.track(told("search_miss", None, 0, {"totalCached": in_scope}))
        gone = read.where(F.col("hash").isNull()).select("path")
        if not gone.isEmpty() or not edited.isEmpty():
            self._store(edited, self.listing().select("path"), gone, made if writable else None)
        return out.drop("lines").orderBy(F.col("score").desc(), "path")

    def invalidate(self, path: str | None = None) -> int:
        """Forget one file, or all; the number of files, 1 for a single one even where it is not stored."""
        gone = None if path is None else self._paths([validated(self.root, path)])
        files, events = lifecycle.invalidate(self.table("files"), gone, F.lit(_now()))
        events = cut_lineage(events)
        self.track(events.select("timestamp", "event_type", "file_path"))
        removed = self.table("files").select("path") if gone is None else gone
        self.store.commit("imports", maintenance.delete_entries(self.table("files"), self.table("imports"), removed)[1])
        self.store.commit("files", files)
        return events.count() if path is None else 1

    def create_task(self, name: str, metadata_json: str | None = None, session_id: str | None = None) -> str:
        now, key = _now(), str(uuid.uuid4())
        self.store.append("tasks", self._frame("tasks", [(key, name, "created", now, now, session_id, metadata_json)]))
        return key

    def get_task(self, task_id: str) -> DataFrame:
        return self.table("tasks").where(F.col("id") == task_id)

    def list_tasks(self, state: str | None = None) -> DataFrame:
        tasks = self.table("tasks")
        return (tasks.where(F.col("state") == state) if state else tasks).orderBy(F.col("updated_at").desc(), "id")

    def update_task(self, task_id: str, name: str | None = None, state: str | None = None, metadata_json: str | None = None) -> None:
        """Change what is given and the time of the update. An unknown task is an error."""
        self._require_task(task_id)
        given = {"name": name, "state": state, "metadata_json": metadata_json}
        self._change_task(F.col("id") == task_id, {k: v for k, v in given.items() if v is not None})

    def _change_task(self, which, values: dict) -> None:
        changed = {k: F.when(which, F.lit(v)).otherwise(F.col(k)) for k, v in (values | {"updated_at": _now()}).items()}
        self.store.commit("tasks", self.table("tasks").withColumns(changed))

    def _require_task(self, task_id: str) -> None:
        if self.get_task(task_id).isEmpty():
            raise KeyError(task_id)

    def delete_task(self, task_id: str) -> None:
        tasks, touched = memory.delete_tasks(self.table("tasks"), self.table("task_files"), self.spark.createDataFrame([(task_id,)], "id string"))
        self.store.commit("task_files", touched)
        self.store.commit("tasks", tasks)

    def get_task_context(self, task_id: str | None = None) -> dict[str, DataFrame]:
        tasks, touched = self.table("tasks"), self.table("task_files")
        if task_id is None:
            return {"tasks": memory.task_summary(tasks, touched)}
        explored = memory.newest_task_files(touched).where(F.col("task_id") == task_id).orderBy("explored_at", "file_path")
        return {"files": explored, "frontier": memory.frontier(self.table("files"), touched, task_id)}

    def mark_explored(self, task_id: str, path: str, status: str = "explored", notes: str | None = None) -> None:
        """Add a row; the newest of a task and path counts. A created task becomes active. An unknown task is an error."""
        self._require_task(task_id)
        self.store.append("task_files", self._frame("task_files", [(task_id, path, status, notes, _now())]))
        which = (F.col("id") == task_id) & (F.col("state") == "created")
        if not self.table("tasks").where(which).isEmpty():
            self._change_task(which, {"state": "active"})

    def get_token_report(self, hours: float | None = None, session_id: str | None = None) -> DataFrame:
        """The report of the last hours, or of the events since a session started; an unknown session keeps all events."""
        events = self.table("telemetry")
        if session_id is not None:
            return report.token_report(events, self.table("sessions").where(F.col("id") == session_id).agg(F.min("started_at")).first()[0])
        start = int(_now() - hours * report.HOUR_MS) if hours else None
        return report.token_report(events, start)

    def diagnostics(self) -> dict:
        files, now = self.table("files"), F.lit(_now())
        return {"entries": files.count(), "ages": report.age_histogram(files, now), "stale": cat.stale(files, now), "bytes": self.store.size()}

    # sessions, settings values and the event log

    def start_session(self, metadata_json: str | None = None) -> str:
        key = str(uuid.uuid4())
        self.store.append("sessions", self._frame("sessions", [(key, _now(), None, metadata_json)]))
        return key

    def end_session(self, session_id: str) -> None:
        """Set the end of a session; an unknown one changes nothing."""
        ended = F.when(F.col("id") == session_id, F.lit(_now())).otherwise(F.col("ended_at"))
        self.store.commit("sessions", self.table("sessions").withColumn("ended_at", ended))

    def list_sessions(self, limit: int = 100) -> DataFrame:
        return self.table("sessions").orderBy(F.col("started_at").desc(), "id").limit(limit)

    def set_meta(self, key: str, value: str) -> None:
        self.store.commit("meta", maintenance.upsert(self.table("meta"), self._frame("meta", [(key, value)]), "key"))

    def get_meta(self, key: str) -> str | None:
        found = self.table("meta").where(F.col("key") == key).first()
        return found["value"] if found else None

    def track(self, events: DataFrame, rate: float = 1.0) -> None:
        """Append events; ids come from a hash of their place, so that sampling by id repeats."""
        types = dict(x.split(" ", 1) for x in SCHEMAS["telemetry"].split(", "))
        full = events.select(*[(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items() if c != "id"])
        named = full.withColumn("id", F.xxhash64(*full.columns, F.lit(time.time_ns()), F.monotonically_increasing_id())).select("id", *full.columns)
        self.store.append("telemetry", maintenance.sample_events(named, rate))

    def get_events(self, event_type: str | None = None, since_ms: int | None = None, limit: int | None = None) -> DataFrame:
        return report.event_log(self.table("telemetry"), event_type, since_ms, limit)

    def export_events(self, folder: str, event_type: str | None = None, since_ms: int | None = None) -> None:
        maintenance.write_jsonl(self.get_events(event_type, since_ms), folder)
