"""Encoding of whole texts with a public byte-level tokenizer, by a tree of joined halves.

A text is halved until its parts are short; parts are encoded on their own and joined again
from the bottom up. The pattern that splits a text before the merges keeps letters, digits,
white space and other characters apart, but for a space before the three others and an
apostrophe before letters. So where a character and the next are of different kinds, and the
first is neither white space nor an apostrophe before a letter, no split of any text goes
over the place between them: tokens on both sides stand, whatever else the text holds. A join
keeps the left part's tokens up to its last such place and the right part's from its first
one on, and encodes the window between them, which grows from the seam until both are found.
The order of joins does not matter, so parts of very long texts are encoded in separate tasks.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeledger.session import read_table

#: Folder of the vocabulary files.
VOCABULARIES = "/opt/tokenizers"
#: Pattern of the byte-level vocabularies, which splits a text before the merges. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _settled() -> dict[str, str]:
    """Character classes, as parts of patterns, of the kinds that the splitting pattern tells apart.

    Regular expression engines follow different versions of Unicode, so only characters of the
    basic plane that have been of one kind since version 3.2 are in a class.
    """

    def kind(data, c: str) -> str:
        category = data.category(c)
        return category[0] if category[0] in "LN" else "S" if category == "Zs" else "" if category[0] in "CZ" else "P"

    places: dict[str, list[int]] = {"L": [], "N": [], "P": [], "S": list(map(ord, "\t\n\v\f\r"))}
    for code in range(0x10000):
        now = kind(unicodedata, chr(code))
        if now and now == kind(unicodedata.ucd_3_2_0, chr(code)) and chr(code) not in "'\u180e":
            places[now].append(code)
    classes = {}
    for name, codes in places.items():
        starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
        ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
        classes[name] = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))
    return classes


def stable_places() -> str:
    """Pattern of the places that no split crosses."""
    c = _settled()
    pairs = ((c["L"], c["N"] + c["P"] + c["S"] + "'"), (c["N"], c["L"] + c["P"] + c["S"] + "'"), (c["P"], c["L"] + c["N"] + c["S"]), ("'", c["N"] + c["S"]))
    return "|".join(f"(?<=[{before}])(?=[{after}])" for before, after in pairs)


#: Code points of a leaf of the tree, far fewer than usual texts have, and of a part that is a row of its own.
LEAF, PART = 256, 1 << 20


class Encoder:
    def __init__(self, name: str, folder: str):
        import regex
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.leaf = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.last = regex.compile(stable_places()), regex.compile("(?r)" + stable_places())
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """The tokens of ``text``: those of its halves, joined."""
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left, leaf), right, self.encode(right, leaf))

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """Tokens of ``left + right`` from those of each, without reading more than the window at the seam."""
        p, q = self.last.search(left), self.first.search(right)
        end, begin = left[p.start() if p else 0 :], right[: q.start() if q else len(right)]
        return a[: len(a) - self._count(reversed(a), end)] + self.leaf(end + begin) + b[self._count(b, begin) :]

    def _count(self, ids, text: str) -> int:
        """How many of the tokens, one after the other, make up the bytes of ``text``."""
        left, n = len(text.encode("utf-8", "replace")), 0
        for i in ids:
            if left <= 0:
                break
            left -= self.size[i]
            n += 1
        return n

    def ends(self, text: str) -> tuple[str, str, str] | None:
        """``text`` in three at its first and last stable place; None without any."""
        first = self.first.search(text)
        if first is None:
            return None
        p, q = first.start(), self.last.search(text).start()
        return text[:p], text[p:q], text[q:]

    def decode(self, ids) -> str:
        """Bytes of tokens concatenate, so decoding needs no seams."""
        return b"".join(self.bytes_of[int(i)] for i in ids).decode("utf-8", "replace")


@cache
def encoder(name: str, folder: str) -> Encoder:
    return Encoder(name, folder)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES, part: int = PART, leaf: int = LEAF) -> DataFrame:
    """(key, ids) for each row: the tokens of its text without special ones.

    Null and empty texts have an empty list. What looks like a special token is ordinary
    text. Other columns are ignored, repeated rows kept; keys must be unique only among
    texts longer than ``part``. Rows of such texts are split over tasks and joined by key.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        e = encoder(vocabulary, folder)
        return pd.Series([e.encode(t, leaf) if t else [] for t in texts])

    long = F.coalesce(F.length(text) > part, F.lit(False))
    short = documents.where(~long).select(F.col(key), encode(F.col(text)).alias("ids"))

    thirds = T.StructType([T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    @F.pandas_udf(thirds)
    def encode_part(texts: pd.Series) -> pd.DataFrame:
        e = encoder(vocabulary, folder)
        cut = [e.ends(t) for t in texts]
        # A part without a stable place is all head, and has no tokens of its own.
        return pd.DataFrame({"head": [c[0] if c else t for c, t in zip(cut, texts)], "tail": [c[2] if c else None for c in cut], "ids": [e.encode(c[1], leaf) if c else None for c in cut]})

    # Parts of very long texts: each task encodes what lies between the first and the last stable place of its part,
    # then the seams, from the last place of one part to the first of the next that has any, are encoded in further tasks.
    numbers = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / part).cast("int"))
    parts = (
        documents.where(long)
        .select(F.col(key).alias("k"), F.posexplode(F.transform(numbers, lambda i: F.substring(F.col(text), i * part + 1, F.lit(part)))).alias("n", "piece"))
        .repartition("k", "n")
        .select("k", "n", encode_part("piece").alias("e"))
        .select("k", "n", "e.*", F.count("e.tail").over(Window.partitionBy("k").orderBy("n")).alias("place"))
    )
    cut = F.col("tail").isNotNull()
    heads = F.struct((F.col("place") - cut.cast("int")).alias("place"), (F.col("n") * 2).alias("at"), F.col("head").alias("text"))
    tails = F.struct(F.col("place"), (F.col("n") * 2 + 1).alias("at"), F.col("tail").alias("text"))
    seams = parts.select("k", F.explode(F.when(cut, F.array(heads, tails)).otherwise(F.array(heads))).alias("s")).groupBy("k", "s.place").agg(F.array_sort(F.collect_list(F.struct("s.at", "s.text"))).alias("texts"))
    joined = seams.select("k", (F.col("place") * 2 + 1).alias("place"), encode(F.array_join("texts.text", "")).alias("ids"))
    middles = parts.where(cut).select("k", (F.col("place") * 2).alias("place"), "ids")
    # One row for each text, as asked for: its runs of tokens in order.
    whole = middles.unionByName(joined).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("runs"))
    return short.unionByName(whole.select(F.col("k").alias(key), F.flatten("runs.ids").alias("ids")))


def decoded(rows: DataFrame, ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``rows`` with ``decoded``: the text of the tokens; '' for an empty list, null for null."""

    @F.pandas_udf(T.StringType())
    def decode(lists: pd.Series) -> pd.Series:
        e = encoder(vocabulary, folder)
        return pd.Series([None if x is None else e.decode(x) for x in lists])

    return rows.withColumn("decoded", decode(F.col(ids)))


def p6_ids(spark, folder: str) -> DataFrame:
    return token_ids(read_table(spark, folder, "documents").select("doc_id", "text"))


def p6_roundtrip(spark, folder: str) -> DataFrame:
    """Documents whose tokens do not decode to their text, and tokens per language."""
    documents = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    back = decoded(p6_ids(spark, folder)).withColumn("n_tokens", F.size("ids")).drop("ids")
    differs = F.count_if(~F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))))
    return documents.join(back, "doc_id").groupBy("lang").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), differs.alias("n_differing"))
