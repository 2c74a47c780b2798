import random

from conftest import rows

from treeledger.operators.snapshots import file_deliveries, snapshot_changes

SCHEMA = "source string, snapshot_no int, key string, hash string, version bigint, number int, salt string"


def frame(spark, data):
    return spark.createDataFrame([(*r, 5, "clash") for r in data], SCHEMA)


def test_changes(spark):
    data = [
        ("p", 1, "a", "1", 1), ("p", 1, "b", "1", 1), ("p", 3, "a", "2", 1), ("p", 3, "c", "1", 1), ("p", 4, "a", "2", 1), ("p", 4, "b", "1", 1), ("p", 4, "c", None, 1),
        ("q", 2, "z", None, None), ("q", 4, "z", None, 3), (None, 4, "z", "1", 1), ("q", 4, None, "1", 1),
    ]
    got = rows(snapshot_changes(frame(spark, data)))
    assert got == sorted([("p", 3, "a", "changed"), ("p", 3, "b", "deleted"), ("p", 3, "c", "added"), ("p", 4, "b", "added"), ("p", 4, "c", "changed")], key=repr)


def test_newest_row_of_a_delivery_counts(spark):
    data = [("p", 1, "a", "1", 1), ("p", 1, "a", "0", 0), ("p", 1, "a", "1", 1), ("p", 2, "a", "0", 0), ("p", 2, "a", "1", 9), ("p", 2, "a", "9", None)]
    assert rows(snapshot_changes(frame(spark, data))) == []
    assert rows(snapshot_changes(frame(spark, []))) == []


def test_against_sets(spark):
    random.seed(2)
    data = [(random.choice("pqqq"), random.randint(1, 6), f"k{random.randint(0, 25)}", str(random.randint(0, 2)), random.randint(0, 5)) for _ in range(900)]
    best = {}
    for s, n, k, h, v in data:
        best[s, n, k] = max(best.get((s, n, k), (-1, "")), (v, h))
    want = []
    for s in "pq":
        numbers = sorted({n for a, n, _ in best if a == s})
        for before, after in zip(numbers, numbers[1:]):
            old, new = ({k: v[1] for (a, n, k), v in best.items() if a == s and n == x} for x in (before, after))
            want += [(s, after, k, "added") for k in new.keys() - old.keys()] + [(s, after, k, "deleted") for k in old.keys() - new.keys()]
            want += [(s, after, k, "changed") for k in old.keys() & new.keys() if old[k] != new[k]]
    assert rows(snapshot_changes(frame(spark, data))) == sorted(want, key=repr)


def test_spellings(spark):
    df = spark.createDataFrame([(1, "./p/a.ts", "SHA256:AB", 1), (2, "p\\a.ts", "ab", 1), (2, None, "ab", 1)], "snapshot_no int, path string, hash string, last_checked bigint")
    assert rows(snapshot_changes(file_deliveries(df))) == []
