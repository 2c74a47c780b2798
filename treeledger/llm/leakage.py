"""Held-out test texts inside a training corpus, by greedy string tiling.

Texts are reduced to letters and digits. Each document gives a seed at every 20th place,
each test item all its windows of a seed's length; a run that both share and that is long
enough for a case holds a whole seed of the document, so joining seeds with windows by hash
loses no pair. Joined pairs are tiled: the longest common run that no tile covers yet is
found by rolling Karp-Rabin hashes and marked in both texts, again and again, so passages
are found in any order.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeledger.session import all_salts, read_table, salted

#: Least shared run of a case, and how far apart the seeds of a document stand.
MIN_RUN, STRIDE = 60, 20
#: Least tile that counts for coverage.
MIN_TILE = 15
#: Windows of test items up to this number, and item texts of up to so many characters, are broadcast; with 16 and 4 bytes each both stay under 64 MB.
BROADCAST_WINDOWS, BROADCAST_TEXT = 2_000_000, 8_000_000
#: Beyond that the seeds of one hash are spread over so many keys.
SALTS = 16
#: Items of one document that are tiled in one row.
ITEMS_IN_A_ROW = 16

_OTHER = re.compile(r"[\W_]+")


def bare(text: str) -> str:
    """NFKC, case-folded, letters and digits only."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).casefold())


@F.pandas_udf(T.StringType())
def bare_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: bare(t) if t else "")


class _Hashes:
    """Karp-Rabin hashes of the windows of a text, modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.made: dict[int, np.ndarray] = {}
        n = len(self.codes)
        powers = np.ones(n + 1, np.uint64)
        backs = np.ones(n + 1, np.uint64)
        powers[1:], backs[1:] = self.BASE, self.INVERSE
        with np.errstate(over="ignore"):
            powers, self.backs = np.multiply.accumulate(powers), np.multiply.accumulate(backs)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(self.codes * powers[:n])])

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[starts + length] - self.sums[starts]) * self.backs[starts]

    def all(self, length: int) -> np.ndarray:
        if length not in self.made:
            self.made[length] = self.of(np.arange(max(0, len(self.codes) - length + 1)), length)
        return self.made[length]


@lru_cache(1)
def _document(text: str) -> _Hashes:
    """Hashes of the document that is tiled at present, made once for all of its items."""
    return _Hashes(text)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the values that occur among ``known``."""
    if not len(known):
        return np.empty(0, np.int64)
    known = np.sort(known)
    places = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.flatnonzero(known[places] == values)


def _runs(places: np.ndarray) -> np.ndarray:
    """For each place how many follow each other from it on."""
    ends = np.flatnonzero(np.append(np.diff(places) != 1, True))
    return places[ends[np.searchsorted(ends, np.arange(len(places)))]] - places + 1


def _common(a: _Hashes, b: _Hashes, at_a: np.ndarray, at_b: np.ndarray, length: int) -> tuple[int, int] | None:
    """First of the places of a, with the first of b, where a run of this length is the same."""
    if not len(at_a) or not len(at_b):
        return None
    hash_a, hash_b = a.of(at_a, length), b.of(at_b, length)
    order = np.argsort(hash_b, kind="stable")
    sorted_b = hash_b[order]
    places = np.minimum(np.searchsorted(sorted_b, hash_a), len(order) - 1)
    for i in np.flatnonzero(sorted_b[places] == hash_a):
        x, y = int(at_a[i]), int(at_b[order[places[i]]])
        if np.array_equal(a.codes[x : x + length], b.codes[y : y + length]):
            return x, y
    return None


def tiles(document: str, item: str, least: int) -> list[tuple[int, int, int]]:
    """(place in the document, place in the item, length), longest first, none overlapping.

    Only places whose next ``least`` characters occur in the other text, unmarked in both, can
    be part of a tile, so a search looks at no others.
    """
    a, b = _document(document), _Hashes(item)
    free_a = _among(a.all(least), b.all(least))
    free_b = _among(b.all(least), a.all(least)[free_a])
    found, most = [], len(item)
    while len(free_a) and len(free_b):
        run_a, run_b = _runs(free_a), _runs(free_b)
        common = lambda n: _common(a, b, free_a[run_a > n - least], free_b[run_b > n - least], n)  # noqa: B023, E731
        most = min(most, int(run_a.max()) + least - 1, int(run_b.max()) + least - 1)
        at, low, high = common(least), least, most
        if at is None:
            break
        while low < high:  # a longer run holds all shorter ones
            middle = (low + high + 1) // 2
            hit = common(middle)
            if hit is None:
                high = middle - 1
            else:
                at, low = hit, middle
        found.append((*at, low))
        free_a = free_a[(free_a + least <= at[0]) | (free_a >= at[0] + low)]
        free_b = free_b[(free_b + least <= at[1]) | (free_b >= at[1] + low)]
        most = low
    return found


_TILED = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("longest", T.IntegerType()), T.StructField("covered", T.IntegerType()), T.StructField("size", T.IntegerType())]))


def leaked(documents: DataFrame, items: DataFrame, min_run: int = MIN_RUN, min_tile: int = MIN_TILE) -> DataFrame:
    """(doc_id, item_id, longest_run, coverage) of documents and items that share a run of ``min_run`` characters.

    ``documents``: doc_id, text; ``items``: item_id, text; further columns are ignored.
    Characters are those of the bare texts. Rows with a null or empty text or a null id give
    nothing, as do items shorter than ``min_run``; repeated rows count once. ``coverage`` is
    the share of the item in tiles of at least ``min_tile`` characters, in any order.
    """
    stride = max(1, min(STRIDE, min_run // 3))
    seed = min_run - stride + 1
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    tests = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), bare_text("text").alias("item_text")).where(F.length("item_text") >= min_run).distinct()
    windows = tests.select("item_id", F.explode(F.expr(rf"regexp_extract_all(item_text, '(?=(.{{{seed}}}))', 1)")).alias("w")).select("item_id", F.xxhash64("w").alias("h")).distinct()
    seeds = docs.select("doc_id", bare_text("text").alias("bare")).select("doc_id", F.explode(F.expr(rf"regexp_extract_all(bare, '(?=(.{{{seed}}})).{{{stride}}}', 1)")).alias("w")).select("doc_id", F.xxhash64("w").alias("h"))
    n_windows, n_text = windows.count(), tests.agg(F.sum(F.length("item_text"))).first()[0] or 0
    if n_windows <= BROADCAST_WINDOWS:
        pairs = seeds.join(F.broadcast(windows), "h")
    else:  # a seed that a third of the documents share is spread over many keys
        everywhere = windows.select("item_id", "h", F.explode(all_salts(F.lit(True), SALTS)).alias("salt"))
        pairs = seeds.withColumn("salt", salted(F.lit(True), F.hash("doc_id"), SALTS)).join(everywhere, ["h", "salt"])
    pairs = pairs.select("doc_id", "item_id").distinct()
    texts = pairs.join(F.broadcast(tests) if n_text <= BROADCAST_TEXT else tests, "item_id")
    # A document of many items has several rows, each with a bounded number of them.
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("item_id", "item_text")) - 1
    wanted = texts.withColumn("part", F.floor(place / F.lit(ITEMS_IN_A_ROW))).groupBy("doc_id", "part").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))

    @F.pandas_udf(_TILED)
    def tile(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, tests in zip(texts, lists):
            document = bare(text)
            rows = []
            for t in tests:
                found = tiles(document, t["item_text"], min_tile)
                if found and found[0][2] >= min_run:
                    rows.append((t["item_id"], found[0][2], sum(n for *_, n in found), len(t["item_text"])))
            out.append(rows)
        return pd.Series(out)

    hits = docs.join(wanted, "doc_id").select("doc_id", F.explode(tile("text", "items")).alias("t"))
    return hits.select("doc_id", "t.item_id", F.col("t.longest").alias("longest_run"), F.round(F.col("t.covered") / F.col("t.size"), 6).alias("coverage")).distinct()


def p7_found(spark, folder: str) -> DataFrame:
    return leaked(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p7_items(spark, folder: str) -> DataFrame:
    """For each leaked item: documents that hold a part of it, and those with at least half of it in any order."""
    found = leaked(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.count_if(F.col("coverage") >= 0.5).alias("n_half_covered"), F.max("longest_run").alias("longest_run"))
