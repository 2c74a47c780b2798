from conftest import rows
from pyspark.sql import functions as F

from treeledger.functions import text
from treeledger.operators import catalogue as cat
from treeledger.operators import changes, lifecycle, maintenance, memory, projects, ranking, report, search

SUMMARY = "struct<purpose:string,exports:array<string>,imports:array<string>,lineCount:int,topLevelDeclarations:array<string>,confidence:string>"
FILES = f"path string, hash string, last_checked bigint, summary {SUMMARY}"
DAY = 86_400_000


def summary(purpose="source", exports=(), declarations=(), confidence="high"):
    return (purpose, list(exports), [], 3, list(declarations), confidence)


def files(spark, data):
    return spark.createDataFrame(data, FILES)


def test_newest_files(spark):
    df = files(spark, [("./a", "SHA256:AA", 1, None), ("a", "bb", 2, summary()), ("a", "bb", 2, summary()), (None, "c", 1, None), ("b", None, None, None)])
    assert [(r["path"], r["hash"], r["last_checked"]) for r in cat.newest_files(df).orderBy("path").collect()] == [("a", "bb", 2), ("b", None, None)]


def test_scan_patterns(spark):
    names = ["src/a.ts", "src/b.PNG", "node_modules/x/a.ts", "lib/.git/a", "tests/a.ts", "tests", "a/tests/b.ts"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    keep = lambda **k: [r[0] for r in df.where(cat.scannable(F.col("path"), **k)).collect()]
    assert keep() == ["src/a.ts", "tests/a.ts", "tests", "a/tests/b.ts"]
    assert keep(include=["*.ts"], exclude=["tests/"]) == ["src/a.ts", "a/tests/b.ts"]
    assert keep(exclude=["tests"]) == ["src/a.ts"]


def test_scope(spark):
    df = spark.createDataFrame([("src/auth/a",), ("src/authx/a",), ("src/auth",), ("b",)], "path string")
    ask = lambda p: [r[0] for r in df.where(cat.in_scope(F.col("path"), p)).collect()]
    assert ask("./src/auth/") == ["src/auth/a", "src/auth"]
    assert len(ask("/")) == len(ask(None)) == 4 and ask(".") == []


def test_freshness(spark):
    c = files(spark, [("a", "1", 1000, summary(confidence="low")), ("b", "1", 1, None), ("c", "1", 1, summary()), ("d", "1", 1, None)])
    now = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("e", "1")], "path string, hash string")
    got = {r["path"]: tuple(r)[1:] for r in cat.freshness(c, now, F.lit(4500)).collect()}
    assert got == {"a": ("hit", 3, True), "b": ("pending", None, None), "c": ("stale", None, None), "d": ("deleted", None, None), "e": ("new", None, None)}


def test_changes_since(spark):
    c = files(spark, [("a", "1", 5, None), ("b", "1", 9, None), ("x", "1", 5, None), ("y", "1", 9, None)])
    scan = spark.createDataFrame([("a", "2"), ("b", None), ("n", "1")], "path string, hash string")
    assert rows(changes.compare(scan, c)) == [("a", "changed"), ("b", "changed"), ("n", "added"), ("x", "deleted"), ("y", "deleted")]
    assert rows(changes.compare(scan, c, 9)) == [("b", "changed"), ("n", "added"), ("y", "deleted")]


def test_maintenance(spark):
    c = files(spark, [("a", "1", 5, summary()), ("b", "1", 5, summary())])
    new = spark.createDataFrame([("a", "1", 9), ("b", "2", 9), ("c", "3", 9)], "path string, hash string, last_checked bigint")
    got = {r["path"]: (r["hash"], r["last_checked"], r["summary"] is not None) for r in maintenance.guarded_upsert(c, new).collect()}
    assert got == {"a": ("1", 9, True), "b": ("2", 9, False), "c": ("3", 9, False)}
    assert maintenance.clear_summaries(c).where("summary is not null").count() == 0
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "a"), ("a", "x")], "src string, dst string")
    assert rows(maintenance.prune_edges(edges, c)) == [("a", "b"), ("b", "a")]
    refs = spark.createDataFrame([("a", "c", ["p"], "static", 1, False), ("a", "c", ["q"], "static", 2, False), ("a", "zod", [], "static", 3, True)], "source string, target string, specifiers array<string>, import_type string, ordinal int, external boolean")
    old = spark.createDataFrame([("a", "old", [], "static"), ("b", "a", [], "static")], "source string, target string, specifiers array<string>, import_type string")
    read = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    assert rows(maintenance.replace_edges(old, refs, read("a"))) == [("a", "c", ["q"], "static"), ("b", "a", [], "static")]
    assert rows(maintenance.replace_edges(old, refs.where("false"), read("a", "b"))) == []  # read again, and no import is left


def test_report(spark):
    data = [(1, 10, "cache_hit", "a", 100, None), (2, 11, " Cache_Hit ", "./a", None, None), (3, 12, "summary_served", "b", 250, "{"), (4, 13, "force_reread", "a", 999, None), (5, 14, "cache_miss", "", 300, None), (6, 15, "search_miss", None, None, '{"query": "x"}'), (7, 16, "search_miss", None, None, '{"query": 3}'), (1, 10, "cache_hit", "a", 100, None)]
    events = report.distinct_events(spark.createDataFrame(data, "id bigint, timestamp bigint, event_type string, file_path string, tokens_estimated bigint, metadata_json string"))
    t = report.totals(events).first()
    assert (t["total_events"], t["cache_hits"], t["cache_misses"], t["tokens_saved"]) == (7, 2, 1, 350) and abs(t["hit_ratio"] - 2 / 3) < 1e-12
    assert [tuple(r)[:3] for r in report.top_files(events).collect()] == [("a", 3, 1099), ("b", 1, 250)]
    assert rows(report.missed_queries(events)) == [("x", 1)]
    assert report.totals(events.limit(0)).first()["hit_ratio"] == 0.0
    assert report.since(events, 0).count() == 7 and report.since(events, 14).count() == 3


def test_age_histogram(spark):
    c = files(spark, [("a", "1", 100 * DAY, None), ("b", "1", 98 * DAY, None), ("c", "1", 69 * DAY, None)])
    assert dict(rows(report.age_histogram(c, F.lit(100 * DAY)))) == {"<1 day": 1, "1-7 days": 1, "7-30 days": 0, ">30 days": 1}
    assert [r[0] for r in cat.stale(c, F.lit(100 * DAY)).select("path").collect()] == ["c"]


def test_search(spark):
    c = files(spark, [("src/auth/validation.ts", "1", 1, summary("validates email input", ["validateEmail"])), ("src/db/queries.ts", "1", 1, summary("queries", ["findEmails"])), ("src/x.ts", "1", 1, None), ("b/store.tsx", "1", 1, summary("store"))])
    got = [tuple(r) for r in search.search(c, "validate email").select("path").collect()]
    assert got == [("src/auth/validation.ts",), ("src/db/queries.ts",)]
    assert search.search(c, "email", 0).count() == 0 and search.search(c, "  ").count() == 0
    assert search.search(c, "ts").count() == 0 and [r[0] for r in search.search(c, "tsx").collect()] == ["b/store.tsx"]
    assert search.search(c, "email", prefix="src/db").count() == 1


def test_tokens(spark):
    df = spark.createDataFrame([("getHTTPServer_id2Foo",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.identifier_tokens(F.col("t"))).collect()] == [["get", "http", "server", "id2", "foo"], [], None]
    assert [r[0] for r in df.select(text.line_count(F.col("t"))).collect()] == [1, 0, None]
    tags = spark.createDataFrame([("ast:3",), ("ast:10",), ("x",), (None,), ("regex:2",)], "t string")
    assert [r[0] for r in tags.select(text.generation_of(F.col("t"))).collect()] == [3, 10, None, None, 2]
    assert [r[0] for r in tags.select(lifecycle.generation_action(F.col("t"), "regex")).collect()] == ["clear", "block", "clear", "retag", "retag"]
    assert [r[0] for r in tags.select(lifecycle.generation_action(F.col("t"), "ast")).collect()] == ["keep", "block", "clear", "clear", "clear"]
    old = spark.createDataFrame([("regex:0",), ("regex:3",), ("regex:4",)], "t string")
    assert [r[0] for r in old.select(lifecycle.generation_action(F.col("t"), "regex")).collect()] == ["clear", "keep", "block"]


def test_ranking(spark):
    names = [("src/a.ts", 1.0), ("src/a.test.ts", 0.3), ("tests/x.ts", 1.0), ("a/tests/x.ts", 0.3), ("package.json", 0.5), ("a/vite.config.ts", 0.5), ("a.py", 0.2)]
    df = spark.createDataFrame(names, "p string, want double")
    assert df.where(text.file_type_relevance(F.col("p")) != F.col("want")).count() == 0
    ages = spark.createDataFrame([(None,), (-5,), (4 * 3_600_000,)], "a bigint")
    assert [r[0] for r in ages.select(text.recency(F.col("a"), ranking.HALF_LIFE_MS)).collect()] == [0.5, 1.0, 0.5]
    assert abs(sum(ranking.WEIGHTS.values()) - 1) < 1e-12
    tf = spark.createDataFrame([("a/b/x", "explored"), ("c/d/x", "flagged"), (None, "flagged")], "file_path string, status string")
    c = spark.createDataFrame([("a/b/y",), ("c/d/y",), ("a/q/y",), ("z/z/y",)], "path string")
    assert rows(ranking.task_context(c, tf)) == [("a/b/y", 0.7), ("a/q/y", 0.4), ("c/d/y", 1.0), ("z/z/y", 0.1)]


def test_projects_and_tasks(spark):
    df = spark.createDataFrame([("p/a/x.ts",), ("p/a/b/y",), ("p/z.TS",), ("root",)], "path string")
    assert rows(projects.folder_counts(df)) == [("p", 1, 1, 3), ("p/a", 2, 1, 2), ("p/a/b", 3, 1, 1)]
    assert rows(projects.folder_counts(df, 2)) == [("p", 1, 1, 2), ("p/a", 2, 1, 1)]
    assert ("p", "(no extension)", 1) in rows(projects.language_breakdown(df))
    tf = spark.createDataFrame([("t", "p/z.TS", "skipped", None, 1), ("u", "root", "explored", None, 1)], "task_id string, file_path string, status string, notes string, explored_at bigint")
    assert rows(memory.frontier(df, tf, "t")) == [("p/a/b/y",), ("p/a/x.ts",), ("root",)]
    assert memory.frontier(df, tf).count() == 2
