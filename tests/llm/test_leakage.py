import random
import time

from conftest import rows

from treeledger.llm import leakage
from treeledger.llm.leakage import bare, leaked, tiles


def longest(a, b):
    best, ends = 0, [0] * (len(b) + 1)
    for x in a:
        ends = [0] + [ends[j] + 1 if x == b[j] else 0 for j in range(len(b))]
        best = max(best, *ends)
    return best


def test_bare():
    assert bare("Ｈéllo, Straße—№ ½_x​­") == "héllostrasseno12x"
    assert bare("...") == ""


def test_tiles():
    assert tiles("xxabcdefyyghijkl", "ghijklabcdef", 3) == [(2, 6, 6), (10, 0, 6)]
    assert tiles("abc", "abc", 4) == [] and tiles("", "abc", 1) == []
    assert sum(n for *_, n in tiles("a" * 500, "a" * 90, 10)) == 90
    random.seed(2)
    for _ in range(60):
        a, b = ("".join(random.choices("ab", k=random.randint(5, 60))) for _ in range(2))
        found = tiles(a, b, 2)
        assert not found or found[0][2] == longest(a, b)
        assert [n for *_, n in found] == sorted((n for *_, n in found), reverse=True)
        for side in (0, 1):
            used = [p for f in found for p in range(f[side], f[side] + f[2])]
            assert len(used) == len(set(used))
        assert all(a[x : x + n] == b[y : y + n] for x, y, n in found)


def test_leaked_like_brute_force(spark):
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefgh", k=random.randint(3, 9)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(12)]
    docs = []
    for n in range(150):
        text = " ".join(word() for _ in range(30))
        if n % 3 == 0:
            t = random.choice(items)[1]
            a = random.randrange(0, 60)
            piece = t[a : a + random.randint(50, 110)]
            text = text[:70] + " " + piece.upper().replace(" ", random.choice([" ", "-", "\n> ", "​ "])) + " " + text[70:]
        docs.append((n, text))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, items[1][1]), (202, items[1][1]), (203, items[2][1] * 3)]
    want = {(d, i) for d, t in docs if t and d is not None for i, x in items if longest(bare(t), bare(x)) >= 60}
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id bigint, text string, bare string, item_id int")
    i = spark.createDataFrame([*items, (90, None), (91, "short"), (None, "x" * 90), items[0]], "item_id bigint, text string")
    got = leaked(d, i)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and got.count() == len(want)
    assert got.where("doc_id = 202 and item_id = 1").first()["coverage"] == 1.0
    assert rows(leaked(d.limit(0), i)) == [] and rows(leaked(d, i.limit(0))) == []


def test_reordered_passages_are_covered(spark):
    random.seed(8)
    parts = ["".join(random.choices("abcdefghijklmnop", k=70)) for _ in range(3)]
    d = spark.createDataFrame([(1, "zz".join(reversed(parts)))], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "".join(parts))], "item_id bigint, text string")
    got = leaked(d, i).first()
    assert got["coverage"] > 0.95 and got["longest_run"] < 100


def test_long_documents(spark):
    random.seed(9)
    parts = ["".join(random.choices("abcdefghijklmnop", k=30)) for _ in range(100)]
    document = "".join("".join(random.choices("qrstuvwxyz", k=2000)) + p for p in random.sample(parts, 100))
    began = time.time()
    assert sorted(n for *_, n in tiles(document, "".join(parts), 15))[:1] == [30] and sum(n for *_, n in tiles(document, "".join(parts), 15)) == 3000
    assert time.time() - began < 5


def test_shared_boilerplate_and_many_items(spark, monkeypatch):
    random.seed(4)
    shared = "".join(random.choices("abcdefgh", k=200))
    items = [(i, shared[i : i + 80] + "".join(random.choices("ijklmnop", k=50))) for i in range(50)]
    docs = [(n, "".join(random.choices("qrstuvwxyz", k=100)) + (shared if n % 3 == 0 else shared[:50]) + items[n][1][60:]) for n in range(50)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {(n, k) for n, t in docs for k, x in items if longest(t, x) >= 60}
    assert {(r[0], r[1]) for r in leaked(d, i).collect()} == want
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(leakage, "BROADCAST_TEXT", 0)
    assert {(r[0], r[1]) for r in leaked(d, i).collect()} == want
