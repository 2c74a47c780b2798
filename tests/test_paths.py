import posixpath
import unicodedata

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeledger.functions import paths


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


CASES = [
    ("a/b.ts", "a/b.ts"), ("./a/./b.ts", "a/b.ts"), (".\\a\\b.ts", "a/b.ts"), ("a//b", "a/b"), ("a/x/../b", "a/b"), ("a/x/y/../../b", "a/b"), ("../a", "a"), ("/a/", "a"), (".", ""), ("", ""),
    ("a/résumé.ts", "a/résumé.ts"), ("a/résumé/..", "a"), ("a/.env", "a/.env"), ("a/..b/c", "a/..b/c"), (None, None),
]


def test_resolve_path(spark):
    got = spark.createDataFrame([(a,) for a, _ in CASES], "x string").select("x", paths.resolve_path(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == [b for _, b in CASES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", "", "é", "é", "x.y"]), min_size=1, max_size=7), min_size=1, max_size=80))
def test_resolve_path_like_a_stack(spark, lists):
    def plain(parts):
        done = []
        for p in parts:
            if p == "..":
                done[-1:] = []
            elif p not in ("", "."):
                done.append(p)
        return unicodedata.normalize("NFC", "/".join(done))

    data = [("/".join(x), plain(x)) for x in lists]
    got = spark.createDataFrame(data, "x string, y string").select(paths.resolve_path(F.col("x")).alias("r"), "y").collect()
    assert all(r["r"] == r["y"] for r in got)


def test_parts_of_paths(spark):
    df = spark.createDataFrame([("a/b/c.test.ts",), ("c",), (".gitignore",), ("a/x.d.ts",)], "p string")
    p = F.col("p")
    got = df.select(paths.dirname(p), paths.basename(p), paths.extname(p), paths.last_dot(p), paths.typed_extension(p), paths.ancestors(p)).collect()
    assert tuple(got[0]) == ("a/b", "c.test.ts", ".ts", ".ts", ".ts", ["a", "a/b"])
    assert tuple(got[1]) == (".", "c", "", "", "", [])
    assert tuple(got[2])[:5] == (".", ".gitignore", "", ".gitignore", ".gitignore")
    assert tuple(got[3])[4] == ".d.ts"
    assert posixpath.splitext("c.test.ts")[1] == ".ts"


def test_hash_spelling(spark):
    df = spark.createDataFrame([("sha256:AB",), ("ab",), ("SHA256:aB",), (None,)], "h string")
    assert [r[0] for r in df.select(paths.normal_hash(F.col("h"))).collect()] == ["ab", "ab", "ab", None]
    assert rows(df.limit(0)) == []
