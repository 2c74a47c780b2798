"""Search over summaries by weighted term matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.text import identifier_tokens, term_quality
from treeledger.operators.catalogue import in_scope

# Weights of the fields.
FIELD_WEIGHTS = {"purpose": 3, "exports": 2, "declarations": 1, "path": 1}


def search(catalogue: DataFrame, query: str, limit: int = 20, prefix: str | None = None) -> DataFrame:
    """(path, purpose, score): the ``limit`` best matches, equal scores by path.

    The query is split at white space and lower-cased; repeated terms count again. Rows
    without a summary or a match are left out. A limit of 0 or less, or a blank query, gives none.
    """
    scored = search_scores(catalogue, query, prefix)
    return scored.orderBy(F.col("score").desc(), "path").limit(max(0, limit))


def search_scores(catalogue: DataFrame, query: str, prefix: str | None = None) -> DataFrame:
    """As ``search`` for all matches."""
    s = F.col("summary")
    rows = catalogue.where(s.isNotNull() & in_scope(F.col("path"), prefix)).select(
        "path",
        F.coalesce(s.purpose, F.lit("")).alias("purpose"),
        F.array_join(F.coalesce(s.exports, F.array().cast("array<string>")), " ").alias("exports"),
        F.array_join(F.coalesce(s.topLevelDeclarations, F.array().cast("array<string>")), " ").alias("declarations"),
    )
    fields = {"purpose": F.col("purpose"), "exports": F.col("exports"), "declarations": F.col("declarations"), "path": F.regexp_replace("path", r"\.[^./]*$", "")}
    raws = {"purpose": F.col("purpose"), "exports": F.col("exports"), "declarations": F.col("declarations"), "path": F.col("path")}
    tokenised = rows.select("*", *[identifier_tokens(c).alias(f"t_{n}") for n, c in fields.items()])
    score = F.lit(0.0)
    for term in query.lower().split():
        for name, weight in FIELD_WEIGHTS.items():
            score = score + term_quality(term, F.col(f"t_{name}"), raws[name]) * F.lit(float(weight))
    return tokenised.select("path", "purpose", score.alias("score")).where("score > 0")
