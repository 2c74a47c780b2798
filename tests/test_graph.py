import random

from conftest import rows

from treeledger.operators import graph


def edges(spark, data):
    return spark.createDataFrame(data, "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_chain_and_cycle(spark):
    e = edges(spark, [("index", "helper"), ("helper", "util"), ("util", "index"), ("util", "util")])
    assert rows(graph.reach(e, nodes(spark, "index"))) == [("helper", 1), ("util", 2)]
    assert rows(graph.reach(e, nodes(spark, "index"), 0)) == [("helper", 1)]
    assert rows(graph.reach(e, nodes(spark, "nowhere", None))) == []
    assert rows(graph.reach(e.limit(0), nodes(spark, "index"))) == []


def test_random_walks_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_SHARE", 0.0)
    random.seed(4)
    data = list({(f"n{random.randint(0, 300)}", f"n{random.randint(0, 300)}") for _ in range(350)} | {("hub", f"n{i}") for i in range(1100)})
    out = {}
    for a, b in data:
        out.setdefault(a, set()).add(b)
    seen, front, depth = {"n1": 0, "n2": 0}, {"n1", "n2"}, 0
    while front:
        depth += 1
        front = {b for a in front for b in out.get(a, ())} - seen.keys()
        seen |= dict.fromkeys(front, depth)
    e = edges(spark, data)
    assert rows(graph.reach(e, nodes(spark, "n1", "n2"))) == sorted(((n, d) for n, d in seen.items() if d), key=repr)
    assert graph.reach(e, nodes(spark, "hub"), 1).count() == 1100


def test_degrees_and_proximity(spark):
    e = edges(spark, [("b", "a"), ("a", "mid"), ("mid", "deep"), ("deep", "more"), ("x", "y")])
    assert [tuple(r) for r in graph.most_connected(e, 2).select("node", "degree").collect()] == [("a", 2), ("deep", 2)]
    assert graph.most_connected(e, -1).count() == 0
    assert rows(graph.proximity(e, nodes(spark, "a"))) == [("b", 1.0), ("deep", 0.5), ("mid", 1.0), ("more", 0.25)]


def test_related(spark):
    e = edges(spark, [("s/q", "s/x"), ("s/x", "t/z"), ("u/p", "s/q")])
    files = spark.createDataFrame([("s/q",), ("s/x",), ("s/other",), ("v/w",)], "path string")
    assert rows(graph.related_files(e, files, "s/q")) == [("s/other", "same-directory"), ("s/x", "imports"), ("t/z", "transitive-dependency"), ("u/p", "imported-by")]


def test_symbols(spark):
    df = spark.createDataFrame([("p/a", "p/b", ["Foo", "foo", None], "static"), ("p/a", "zod", ["Foo"], "static"), (None, "p/b", ["Foo"], "static"), ("p/c", "p/b", None, "static")], "source string, target string, specifiers array<string>, import_type string")
    assert rows(graph.symbol_edges(df, "Foo")) == [("Foo", "p/a", "p/b", "static")]
    assert rows(graph.import_edges(df)) == [("p/a", "p/b"), ("p/c", "p/b")]
