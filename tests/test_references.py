import random

from conftest import rows
from pyspark.sql import functions as F

from treeledger.operators import references as ref

PARENTS = "domain string, key string, live boolean, first_at bigint, note string"
REFS = "domain string, key string, ref_table string, ref_field string, key_a string, key_b string, ref_at bigint, orphan int, block string"
DAY = 86_400_000


def parents(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], PARENTS)


def refs(spark, data):
    return spark.createDataFrame([(d, k, "t", "f", k, b, at, 7, "clash") for d, k, b, at in data], REFS)


def test_runs_and_as_of(spark):
    numbers = spark.createDataFrame([(n,) for n in [1, 2, 3, 3, 7, 8, 70000, None]], "number bigint")
    assert rows(ref.contiguous_runs(numbers).select("run_start", "run_end")) == [(1, 3), (7, 8), (70000, 70000)]
    asked = spark.createDataFrame([(n, n * 10) for n in [0, 1, 3, 3, 4, 7, 9, 69999, 70000, 70001]], "number bigint, more bigint")
    got = ref.match_runs(asked, ref.contiguous_runs(numbers))
    assert sorted((r["number"], r["orphan"]) for r in got.collect()) == [(0, True), (1, False), (3, False), (3, False), (4, True), (7, False), (9, True), (69999, True), (70000, False), (70001, True)]


def test_runs_are_cut_at_blocks(spark):
    numbers = spark.range(0, 25).select(F.col("id").alias("number"))
    assert rows(ref.contiguous_runs(numbers, block=10).select("run_start", "run_end")) == [(0, 9), (10, 19), (20, 24)]
    asked = spark.range(0, 30).select(F.col("id").alias("number"))
    assert ref.match_runs(asked, ref.contiguous_runs(numbers, block=10), block=10).where("orphan").count() == 5


def test_reasons(spark):
    p = parents(spark, [("file", "a", True, None), ("file", "a", False, 5 * DAY), ("file", "b", False, 1), ("task", "a", True, 9 * DAY), ("file", None, True, 1)])
    r = refs(spark, [("file", "a", "1", 4 * DAY), ("file", "a", "1", 6 * DAY), ("file", "b", "2", DAY), ("file", "c", "3", None), ("task", "a", "4", 9 * DAY), ("task", "a", "4", 40 * DAY), ("task", "z", "5", 1), ("file", None, "6", 1), ("file", "c", "3", None)])
    got = rows(ref.broken_references(r, p).select("key_a", "key_b", "period_month", "reason"))
    assert got == sorted([("a", "1", "1970-01", "late"), ("b", "2", "1970-01", "deleted"), ("c", "3", None, "missing"), ("z", "5", "1970-01", "missing")], key=repr)


def test_empty_tables(spark):
    p, r = parents(spark, []), refs(spark, [("file", "a", "1", 1)])
    assert rows(ref.broken_references(r, p).select("reason")) == [("missing",)]
    assert rows(ref.broken_references(r.limit(0), p)) == []


def test_against_brute_force_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(ref, "HOT_SHARE", 0.05)
    random.seed(1)
    keys = [f"k{i}" for i in range(60)]
    p = [("d", random.choice(keys), random.random() < 0.5, random.choice([None, random.randint(0, 90) * DAY])) for _ in range(70)]
    r = [("d", "hot" if random.random() < 0.4 else random.choice(keys), str(random.randint(0, 300)), random.choice([None, random.randint(0, 90) * DAY])) for _ in range(4000)]
    import datetime as dt

    want = set()
    for d, k, b, at in r:
        month = None if at is None else (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=at)).strftime("%Y-%m")
        mine = [x for x in p if x[1] == k]
        first = min((x[3] for x in mine if x[3] is not None), default=None)
        if not any(x[2] for x in mine):
            want.add((k, b, month, "deleted" if mine else "missing"))
        elif first is not None and at is not None and first > at:
            want.add((k, b, month, "late"))
    got = ref.broken_references(refs(spark, r), parents(spark, p)).select("key_a", "key_b", "period_month", "reason")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_catalogue_references(spark):
    imports = spark.createDataFrame(
        [("./p/a.ts", "p\\b.ts", ["x"], "static", 1), ("p/a.ts", "node:fs", None, "static", 1), ("p/a.ts", "zod", None, "static", 1), (None, "p/c.ts", None, "static", None), ("p/a.ts", None, None, None, 2)],
        "source string, target string, specifiers array<string>, import_type string, indexed_at bigint",
    )
    tasks = spark.createDataFrame([("T1", "./p/a.ts", "s", None, 5), (None, "p/a.ts", "s", None, 5)], "task_id string, file_path string, status string, notes string, explored_at bigint")
    got = ref.catalogue_references(imports, tasks).where("key is not null").select("ref_field", "key", "key_a", "key_b")
    assert rows(got) == sorted([("source", "p/a.ts", "p/a.ts", "p/b.ts"), ("target", "p/b.ts", "p/a.ts", "p/b.ts"), ("source", "p/a.ts", "p/a.ts", "node:fs"), ("source", "p/a.ts", "p/a.ts", "zod"), ("target", "p/c.ts", None, "p/c.ts"), ("source", "p/a.ts", "p/a.ts", None), ("task_id", "T1", "T1", "p/a.ts")], key=repr)
