import random
from pathlib import Path

import pytest
from conftest import rows

from treeledger.llm.tokens import VOCABULARIES, decoded, encoder, token_ids

pytestmark = pytest.mark.skipif(not Path(VOCABULARIES, "byte_bpe_50k.tiktoken").exists(), reason="no vocabulary files")

TEXTS = ["", "Hello  world's\n\n\t it's fine, they'll see 123 éßñ", "   ", "<|endoftext|>", "'ll 've're", "中文。テキスト ไทย", "a" * 300, " \n" * 40, "🚀👩‍💻 x"]


def test_tree_equals_the_whole_encoding():
    e = encoder("byte_bpe_50k", VOCABULARIES)
    random.seed(3)
    texts = TEXTS + ["".join(random.choices("a' lsrevd1\n\t .,éß中", k=random.randint(1, 40))) for _ in range(250)]
    for text in texts:
        want = e.leaf(text)
        for leaf in (1, 3, 16):
            assert e.encode(text, leaf) == want, (text, leaf)
        assert e.decode(want) == text


def test_joins_in_any_order():
    e = encoder("byte_bpe_50k", VOCABULARIES)
    text = "The catalogue's rows   weren't\n\n kept since v1.2; they'll be back."
    parts = [(text[i : i + 5], e.leaf(text[i : i + 5])) for i in range(0, len(text), 5)]
    random.seed(1)
    while len(parts) > 1:
        i = random.randrange(len(parts) - 1)
        (a, x), (b, y) = parts[i : i + 2]
        parts[i : i + 2] = [(a + b, e.join(a, x, b, y))]
    assert parts[0][1] == e.leaf(text)


def test_nothing_crosses_a_stable_place():
    """Texts from all Unicode planes, cut at every stable place: the pieces' tokens are those of the whole."""
    e = encoder("byte_bpe_50k", VOCABULARIES)
    random.seed(7)
    for _ in range(400):
        text = "".join(random.choice(["'", "s", " ", "\n", "9", ".", chr(random.randrange(1, 160)), chr(random.choice([random.randrange(32, 0x3000), random.randrange(0x3000, 0xD800), random.randrange(0x10000, 0x20000)]))]) for _ in range(60))
        places = [0, *(m.start() for m in e.first.finditer(text)), len(text)]
        assert [i for a, b in zip(places, places[1:]) for i in e.leaf(text[a:b])] == e.leaf(text), text
        assert e.encode(text, 7) == e.leaf(text)


def test_rows(spark):
    long = "Some words, and it's long. " * 50
    data = [(1, "ab"), (2, None), (3, ""), (4, long), (5, "ab"), (5, "ab"), (6, long[:-1] + "é"), (7, "x" * 333), (8, " " * 50 + "y" * 90 + "中文。" * 40)]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in data], "doc_id bigint, text string, ids string, n int")
    e = encoder("byte_bpe_50k", VOCABULARIES)
    for part in (7, 100):  # with seven code points many parts have no stable place
        assert rows(token_ids(df, part=part, leaf=3)) == sorted(((k, e.leaf(t or "")) for k, t in data), key=repr)
    got = token_ids(df, part=100, leaf=16)
    assert rows(got) == sorted(((k, e.leaf(t or "")) for k, t in data), key=repr)
    assert sorted(r["decoded"] for r in decoded(got).collect()) == sorted(t or "" for _, t in data)
    assert rows(token_ids(df.limit(0))) == []


def test_texts_of_usual_length_are_joined(monkeypatch):
    e, joins = encoder("byte_bpe_50k", VOCABULARIES), []
    monkeypatch.setattr(type(e), "join", lambda self, *parts, join=type(e).join: joins.append(1) or join(self, *parts))
    text = "The catalogue's rows   weren't\n\n kept since v1.2; they'll be back. " * 8
    assert e.encode(text) == e.leaf(text) and len(joins) == 3
