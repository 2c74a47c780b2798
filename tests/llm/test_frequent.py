import random
from collections import Counter

import pytest
from conftest import rows

from treeledger.llm.frequent import frequent_values, stacked, telemetry_events


def values(spark, data):
    return spark.createDataFrame([(f, v, 3, 4) for f, v in data], "field_name string, item_value string, h int, prefix int")


def test_bad_values_and_empty(spark):
    data = [("f", "x"), ("f", "x"), ("f", None), ("f", ""), ("g", "y")]
    assert rows(frequent_values(values(spark, data), min_share=0.5)) == [("f", "x", 2, 2), ("g", "y", 1, 1)]
    assert rows(frequent_values(values(spark, []), min_share=0.5)) == [] and rows(frequent_values(values(spark, []), k=2)) == []
    with pytest.raises(ValueError):
        frequent_values(values(spark, data))


@pytest.mark.parametrize("bits", [(1, 2, 3), (2, 20), (12, 24)])
def test_against_counting(spark, bits):
    random.seed(7)
    data = [("f", f"v{min(int(random.paretovariate(0.6)), 100000)}") for _ in range(4000)] + [("g", random.choice("abc")) for _ in range(50)]
    counts = Counter(data)
    for share in (0.2, 0.01):
        total = Counter(f for f, _ in data)
        want = sorted(((f, v, n, total[f]) for (f, v), n in counts.items() if n >= share * total[f]), key=repr)
        assert rows(frequent_values(values(spark, data), min_share=share, prefix_bits=bits)) == want
    want = []
    for f in "fg":
        want += [(f, v) for v, _ in sorted(((v, n) for (g, v), n in counts.items() if g == f), key=lambda x: (-x[1], x[0]))[:12]]
    assert rows(frequent_values(values(spark, data), k=12, prefix_bits=bits).select("field_name", "item_value")) == sorted(want, key=repr)


def test_events(spark):
    data = [(1, 5, " A\t", "./p//x", None, None), (1, 5, " A\t", "./p//x", None, None), (2, 1, "b", "p/x", None, None), (2, 3, "B", "p/y", -1, "{"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(data, "id bigint, timestamp bigint, event_type string, file_path string, tokens_estimated bigint, metadata_json string")
    events = telemetry_events(df)
    assert rows(events) == sorted([("p/x", "a"), ("p/y", "b"), (None, None)], key=repr)
    assert stacked(events, "file_path", "event_type").count() == 6
