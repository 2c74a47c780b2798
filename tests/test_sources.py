import json
import os
import subprocess
import time
import warnings

from conftest import rows
from pyspark.sql import functions as F

from treeledger.api import SCHEMAS, Ledger
from treeledger.functions.paths import validated
from treeledger.operators.changes import parse_since
from treeledger.sources.config import Settings, operations, parse_settings
from treeledger.sources.store import TableStore
from treeledger.sources.tree import scan
from treeledger.streaming.events import stream_type_counts


def test_settings():
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        s = parse_settings({"ignore": ["x/"], "maxFiles": 0, "summarizer": "regex", "gc": {"cacheMaxAgeDays": 3, "taskMaxAgeDays": "x"}, "tools": {"tasks": True}})
    assert s.ignore == ("x/",) and s.max_files is None and s.ages["cacheMaxAgeDays"] == 3 and s.ages["taskMaxAgeDays"] == 30 and s.groups["tasks"]
    assert len(said) == 2


DAY = 86_400_000


def test_operations():
    assert len(operations(Settings())) == 9 and len(operations(Settings(groups={"summaries": True, "tasks": True, "telemetry": True}))) == 13


def test_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"))
    assert store.version("x") == 0 and store.size() == 0
    store.commit("x", spark.range(3))
    store.commit("x", store.read("x").where("id > 0"))
    store.append("x", spark.range(10, 11))
    assert rows(store.read("x")) == [(1,), (10,), (2,)] and store.read("x", 1).count() == 3 and store.size() > 0


def test_store_survives_a_crash_before_the_mark(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"))
    store.commit("x", spark.range(3))
    spark.range(9).write.parquet(str(tmp_path / "t/x/v2"))  # written, but never made current
    assert store.version("x") == 1 and store.read("x").count() == 3
    assert store.commit("x", spark.range(4)) == 2 and store.read("x").count() == 4


def _write(root, **texts):
    for name, text in texts.items():
        path = root / name.replace("__", "/").replace("_ts", ".ts")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (1e9, 1e9) if name not in NEW else None)


NEW: set = set()


def test_ledger(spark, tmp_path):
    root = tmp_path / "p q"
    (root / "src").mkdir(parents=True)
    (root / "src/index.ts").write_text("import { h } from './h.js';\nexport function main() {}\n")
    (root / "src/h.ts").write_text("export const h = 1;\n")
    (root / "ignored.ts").write_text("x")
    (root / ".gitignore").write_text("ignored.ts\n")
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    assert rows(scan(spark, str(root)).select("path")) == [(".gitignore",), ("src/h.ts",), ("src/index.ts",)]
    ledger = Ledger(spark, str(root), str(tmp_path / "store"))
    assert ledger.index()["summarized"] == 3
    assert rows(ledger.edges()) == [("src/index.ts", "src/h.ts")]
    assert ledger.index() == {"scanned": 3, "fresh": 3, "summarized": 0, "deleted": 0}
    assert ledger.table("files").where("path = 'src/index.ts'").first()["summary"]["purpose"] == "entry point: function main"
    (root / "src/index.ts").write_text("export function main() {}\n")  # its last import is gone, and so is its edge
    assert ledger.index()["summarized"] == 1 and rows(ledger.edges()) == []
    (root / "src/h.ts").unlink()
    assert rows(ledger.get_changed_files()) == [("src/h.ts", "deleted")]
    assert rows(ledger.get_changed_files("2999-01-01")) == [] and rows(ledger.get_changed_files("soon")) == [("src/h.ts", "deleted")]
    assert ledger.index() == {"scanned": 2, "fresh": 2, "summarized": 0, "deleted": 1}
    session = ledger.start_session()
    ledger.end_session("unknown")
    ledger.end_session(session)
    assert ledger.list_sessions().where("ended_at is not null").count() == 1
    ledger.set_meta("x", "1")
    ledger.set_meta("x", "2")
    assert ledger.get_meta("x") == "2" and ledger.get_meta("none") is None


def test_settled_files_are_not_read_again(spark, tmp_path):
    root = tmp_path / "r"
    _write(root, a_ts="export const a = 1;\n", b_ts="export const b = 1;\n")
    ledger = Ledger(spark, str(root), str(tmp_path / "store"))
    ledger.index()
    _write(root, a_ts="export const other = 1;\n")  # its time says that it is old
    assert ledger.index() == {"scanned": 2, "fresh": 2, "summarized": 0, "deleted": 0}
    assert ledger.index(rebuild=True)["summarized"] == 2
    assert ledger.table("files").where("path = 'a.ts'").first()["summary"]["exports"] == ["other"]


def test_generations(spark, tmp_path):
    root = tmp_path / "r"
    _write(root, a_ts="/** Adds. */\nexport function add() {}\n")
    ledger = Ledger(spark, str(root), str(tmp_path / "store"))
    ledger.index()
    assert ledger.get_meta("summarizer_generation") == "ast:3"
    purpose = lambda l: l.table("files").first()["summary"]
    assert purpose(ledger)["purpose"] == "function add — Adds."
    plain = Ledger(spark, str(root), str(tmp_path / "store"), Settings(summarizer="regex"))
    plain.index()
    assert plain.get_meta("summarizer_generation") == "regex:3" and purpose(plain)["purpose"] == "source"
    plain.set_meta("summarizer_generation", "regex:9")  # a newer one owns the tables: nothing is cleared, no summary stored
    (root / "a.ts").write_text("export function sub() {}\n")
    plain.index()
    assert plain.get_meta("summarizer_generation") == "regex:9" and purpose(plain) is None


def test_events_of_use(spark, tmp_path):
    root = tmp_path / "r"
    _write(root, a_ts="export function walrus() {}\n" + "// more\n" * 200, b_ts="import { walrus } from './a';\n")
    ledger = Ledger(spark, str(root), str(tmp_path / "store"))
    first = ledger.batch_file_summaries(["a.ts", "b.ts", "../x", "none.ts", "a.ts"])
    assert (first.hits, first.misses) == (0, 2) and set(first.errors) == {"../x", "none.ts"}
    assert rows(ledger.edges()) == [("b.ts", "a.ts")]
    again = ledger.batch_file_summaries(["a.ts"])
    assert (again.hits, again.misses) == (1, 0) and again.results.first()["from_store"]
    ledger.force_reread("b.ts")
    ledger.search_by_purpose("walrus")
    ledger.search_by_purpose("nothing")
    ledger.invalidate("b.ts")
    report = ledger.get_token_report().first()
    assert report["events_by_type"] == {"cache_hit": 1, "cache_miss": 2, "force_reread": 1, "summary_served": 1, "search_miss": 1, "invalidation": 1}
    assert report["tokens_saved"] > 2010 and [tuple(q) for q in report["top_missed_queries"]] == [("nothing", 1)]
    assert [r["event_type"] for r in ledger.get_events("cache_hit", 0, 1).collect()] == ["cache_hit"]
    ledger.export_events(str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).where("id is null").count() == 0 if "id" in spark.read.json(str(tmp_path / "lines")).columns else True
    assert spark.read.text(str(tmp_path / "lines")).count() == 7
    try:
        ledger.get_file_summary("none.ts")
        raise AssertionError
    except ValueError:
        pass


def test_tasks(spark, tmp_path):
    root = tmp_path / "r"
    _write(root, a_ts="import './b';\n", b_ts="export const b = 1;\n", c_ts="")
    ledger = Ledger(spark, str(root), str(tmp_path / "store"))
    ledger.index()
    task, other = ledger.create_task("t"), ledger.create_task("u")
    ledger.mark_explored(task, "a.ts", "flagged")
    assert rows(ledger.get_task_context(task)["frontier"]) == [("b.ts",), ("c.ts",)]
    assert rows(ledger.list_tasks("active").select("id")) == [(task,)] and rows(ledger.list_tasks("created").select("id")) == [(other,)]
    plain, helped = (ledger.get_related_files("b.ts", task_id=t).where("path = 'a.ts'").first()["signals"] for t in (None, task))
    assert (plain["taskContextRelevance"], helped["taskContextRelevance"]) == (0.1, 1.0) and plain["centrality"] == 1.0
    ledger.update_task(other, name="v", state="completed")
    assert ledger.get_task(other).first()["name"] == "v"
    ledger.delete_task(task)
    assert ledger.get_task(task).isEmpty() and ledger.table("task_files").isEmpty()
    for call in (lambda: ledger.mark_explored("x", "a.ts"), lambda: ledger.update_task("x")):
        try:
            call()
            raise AssertionError
        except KeyError:
            pass


def test_collection(spark, tmp_path):
    root = tmp_path / "r"
    _write(root, a_ts="import './b';\n", b_ts="export const b = 1;\n", old_ts="import './b';\n")
    ledger = Ledger(spark, str(root), str(tmp_path / "store"))
    ledger.index()
    now = int(time.time() * 1000)
    ledger.store.commit("files", ledger.table("files").withColumn("last_checked", F.when(F.col("path") == "old.ts", now - 40 * DAY).otherwise(F.col("last_checked"))))
    ledger.store.commit("tasks", spark.createDataFrame([("x", "n", "completed", 1, 1, None, None), ("y", "n", "active", 1, 1, None, None), ("z", "n", "archived", now, now, None, None)], SCHEMAS["tasks"]))
    ledger.store.commit("task_files", spark.createDataFrame([("x", "a.ts", "explored", None, 1), ("y", "a.ts", "explored", None, 1)], SCHEMAS["task_files"]))
    ledger.store.commit("telemetry", spark.createDataFrame([(1, now - 100 * DAY, "cache_hit", None, 1, None), (2, now, "cache_hit", None, 1, None)], SCHEMAS["telemetry"]))
    (root / "a.ts").unlink()
    want = {"deleted_files": 1, "stale_files": 1, "orphan_edges": 2, "old_events": 1, "old_tasks": 1}
    assert ledger.collect_garbage(dry_run=True) == want and ledger.table("files").count() == 3
    assert ledger.collect_garbage() == want
    assert [rows(ledger.table(t).select(c)) for t, c in (("files", "path"), ("imports", "source"), ("tasks", "id"), ("task_files", "task_id"), ("telemetry", "id"))] == [[("b.ts",)], [], [("y",), ("z",)], [("y",)], [(2,)]]
    assert set(ledger.collect_garbage().values()) == {0}


def test_graph_of_a_tree(spark, tmp_path):
    root = tmp_path / "r"
    _write(root, index_ts="import { h } from './helper';\n", helper_ts="import { u } from './util';\nexport const h = u;\n", util_ts="export const u = 1;\n")
    ledger = Ledger(spark, str(root), str(tmp_path / "store"))
    ledger.index()
    full = ledger.get_dependency_graph(limit=1)
    assert tuple(full["totals"].first()) == (3, 2, 1, 1, True) and rows(full["edges"]) == [("helper.ts", "util.ts")] and rows(full["most_connected"].select("node"))[0] == ("helper.ts",)
    assert tuple(ledger.get_dependency_graph()["totals"].first()) == (3, 2, 3, 2, False)
    near = ledger.get_dependency_graph("./index.ts", "dependencies", 5)
    assert rows(near["edges"]) == [("dependencies", "helper.ts"), ("dependencies", "util.ts")] and tuple(near["totals"].first()) == (3, 2)
    assert tuple(ledger.get_dependency_graph(symbol="u")["totals"].first()) == (2, 1)


def test_commands(spark, tmp_path, capsys):
    from treeledger.__main__ import main

    _write(tmp_path, a_ts="export const a = 1;\n")
    assert main(["index", str(tmp_path), "--quiet"]) == 0 and capsys.readouterr().out == ""
    assert main(["report", str(tmp_path), "--json", "--diagnostics"]) == 0
    assert json.loads(capsys.readouterr().out)["diagnostics"]["ages"]["<1 day"] == 1
    assert main(["report", str(tmp_path)]) == 0 and "ratio n/a" in capsys.readouterr().out
    assert main(["collect", str(tmp_path), "--dry-run"]) == 0 and "0 old tasks" in capsys.readouterr().out


def test_paths_and_times(tmp_path):
    assert [validated("/r", p) for p in ("a//b", "./a", "/r/x/../y", "", "a\\b")] == ["a/b", "a", "y", "", "a/b"]
    for wrong in ("../x", "/other", "a/../../x", "a\0b", "/r2/x"):
        try:
            validated("/r", wrong)
            raise AssertionError(wrong)
        except ValueError:
            pass
    assert [parse_since(t) for t in ("1970-01-02", "1970-01-01T00:00:01Z", "1970-01-01T01:00:00+01:00", "last_check", "", None, "soon")] == [86_400_000, 1000, 0, None, None, None, None]


def test_edited_files_stay_in_the_search(spark, tmp_path):
    root = tmp_path / "r"
    _write(root, empty__x="", full__x="")
    (root / "empty/x").rename(root / "empty/.gitkeep")
    (root / "full/x").unlink()
    (root / "full/.gitkeep").write_text("x")
    for name in "abcd":
        (root / f"{name}.ts").write_text(f"export function walrus{name.upper()}() {{}}\n")
    ledger = Ledger(spark, str(root), str(tmp_path / "store"), Settings(summarizer="regex"))
    ledger.index()
    (root / "a.ts").write_text("export function walrus() {}\nexport function pelican() {}\n")
    (root / "b.ts").write_text("export function other() {}\n")
    (root / "c.ts").unlink()
    assert [r["path"] for r in ledger.search_by_purpose("walrus", 1).collect()] == ["a.ts"]
    assert {r["path"] for r in ledger.search_by_purpose("walrus").collect()} == {"a.ts", "d.ts"}
    assert [r["path"] for r in ledger.search_by_purpose("pelican").collect()] == ["a.ts"]  # the search before has stored it
    assert "c.ts" not in {r["path"] for r in ledger.table("files").collect()}
    told = ledger.get_project_map()
    assert {r["folder"] for r in told["folders"].collect()} == {"full"} and told["total_files"].first()[0] == 5
    assert [tuple(r)[:2] for r in told["files"].collect()] == [(".", "a.ts"), (".", "b.ts"), (".", "d.ts"), ("full", ".gitkeep")]


def test_report_of_a_session(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), str(tmp_path / "store"))
    event = lambda t: spark.createDataFrame([(t, "cache_hit", "a", 5)], "timestamp bigint, event_type string, file_path string, tokens_estimated bigint")
    ledger.track(event(5))
    session = ledger.start_session()
    start = ledger.list_sessions().first()["started_at"]
    ledger.track(event(start - 1))
    ledger.track(event(start))
    assert [ledger.get_token_report(session_id=s).first()["total_events"] for s in (session, "unknown")] == [1, 3]


def test_stream(spark, tmp_path):
    folder = tmp_path / "d"
    spark.createDataFrame([(1, 5, "a ", None, 1, None), (2, 6, "A", "x", None, "{")], "id bigint, timestamp bigint, event_type string, file_path string, tokens_estimated bigint, metadata_json string").write.parquet(str(folder / "telemetry.parquet"))
    assert rows(stream_type_counts(spark, str(folder))) == [("a", 2)]
