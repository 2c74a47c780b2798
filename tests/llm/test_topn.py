import random

import pytest
from conftest import rows

from treeledger.llm.topn import top_n

SCHEMA = "g string, i string, s double, v bigint, r int, sub string"


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "clash") for r in data], SCHEMA)


def test_ties_nulls_and_repeats(spark):
    nan = float("nan")
    data = [("a", "x", 1.0, 1), ("a", "x", 9.0, 0), ("a", "y", 1.0, None), ("a", "é", 1.0, 1), ("a", "Z", 1.0, 1), ("a", "n", nan, 1), ("a", None, 5.0, 1), (None, "x", 5.0, 1), ("a", "q", None, 1), ("b", "x", -1.0, 1), ("b", "x", -1.0, 1)]
    assert rows(top_n(frame(spark, data), "g", "i", "s", 3, "v")) == [("a", "Z", 1), ("a", "x", 2), ("a", "y", 3), ("b", "x", 1)]
    assert rows(top_n(frame(spark, []), "g", "i", "s", 3, "v")) == []
    assert rows(top_n(frame(spark, data), "g", "i", "s", 1)) == [("a", "x", 1), ("b", "x", 1)]


@pytest.mark.parametrize("subgroups", [1, 7, 64])
def test_against_sorting(spark, subgroups):
    random.seed(subgroups)
    data = [(random.choice("aaaaab"), f"i{random.randint(0, 400)}", random.randint(0, 5) / 2, random.randint(0, 9)) for _ in range(3000)]
    best = {}
    for g, i, s, v in data:
        best[g, i] = max(best.get((g, i), (-1, 0)), (v, s))
    want = []
    for g in "ab":
        items = sorted(((-s, i) for (h, i), (_, s) in best.items() if h == g))[:10]
        want += [(g, i, n) for n, (_, i) in enumerate(items, 1)]
    assert rows(top_n(frame(spark, data), "g", "i", "s", 10, "v", subgroups)) == sorted(want, key=repr)
