"""Text, token and scoring functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeledger.functions.paths import basename, last_dot


def line_count(text: Column) -> Column:
    """0 for '', else line breaks plus one; null for null."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1)))


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up."""
    return F.ceil(F.length(text) / F.lit(4))


def tokens_saved(raw: Column, summary: Column) -> Column:
    """Estimated tokens that the summary's JSON saves against the raw text, at least 0."""
    return F.greatest(F.lit(0).cast("bigint"), token_estimate(raw) - token_estimate(F.to_json(summary)))


def identifier_tokens(text: Column) -> Column:
    """Lower-case words of an identifier or text, split at case changes and at all but letters and digits."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != "")


def identifier_tokens_sql(text: str) -> str:
    return (
        f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), "
        "'([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: t <> '')"
    )


def term_quality(term: str, tokens: Column, raw: Column) -> Column:
    """1 for a whole token, 0.75 for a token's prefix, 0.5 inside the lower-cased raw text; terms under 3 letters only match whole tokens."""
    whole = F.when(F.array_contains(tokens, term), 1.0)
    if len(term) < 3:
        return whole.otherwise(0.0)
    return whole.when(F.exists(tokens, lambda t: t.startswith(term)), 0.75).when(F.lower(raw).contains(term), 0.5).otherwise(0.0)


def term_quality_sql(term: str, tokens: str, raw: str) -> str:
    whole = f"WHEN list_contains({tokens}, '{term}') THEN 1.0"
    if len(term) < 3:
        return f"CASE {whole} ELSE 0.0 END"
    return f"CASE {whole} WHEN len(list_filter({tokens}, lambda t: starts_with(t, '{term}'))) > 0 THEN 0.75 WHEN contains(lower({raw}), '{term}') THEN 0.5 ELSE 0.0 END"


def recency(age_ms: Column, half_life_ms: int) -> Column:
    """1 for no or a negative age, else halved for each half-life; ages count in whole minutes; 0.5 when unknown."""
    minutes = F.floor(age_ms / F.lit(60000)) * F.lit(60000)
    return F.when(age_ms.isNull(), 0.5).when(age_ms <= 0, 1.0).otherwise(F.pow(F.lit(2.0), -minutes / F.lit(float(half_life_ms))))


# File names that configure a project, test file patterns, extensions of sources.
CONFIG_NAMES = (
    "package.json", "tsconfig.json", "tsconfig.base.json", ".eslintrc", ".eslintrc.json", ".eslintrc.js", ".prettierrc", ".prettierrc.json",
    "jest.config.js", "jest.config.ts", "vitest.config.ts", "vitest.config.js", "webpack.config.js", "webpack.config.ts",
    "rollup.config.js", "rollup.config.ts", "vite.config.ts", "vite.config.js", "eslint.config.mjs", "eslint.config.js",
)
TEST_PATTERN = r"\.(test|spec)\.[jt]sx?$|/__tests__/|/tests?/"
SOURCE_EXTENSIONS = (".ts", ".js", ".tsx", ".jsx")


def file_type_relevance(path: Column, source_extensions: tuple[str, ...] = SOURCE_EXTENSIONS) -> Column:
    """Tests 0.3, configuration 0.5, source 1, other files 0.2; the first that fits counts."""
    return F.when(path.rlike(TEST_PATTERN), 0.3).when(basename(path).isin(*CONFIG_NAMES), 0.5).when(last_dot(path).isin(*source_extensions), 1.0).otherwise(0.2)


def file_type_relevance_sql(path: str) -> str:
    names = ", ".join(f"'{n}'" for n in CONFIG_NAMES)
    return (
        f"CASE WHEN regexp_matches({path}, '{TEST_PATTERN}') THEN 0.3 WHEN string_split({path}, '/')[-1] IN ({names}) THEN 0.5 "
        f"WHEN regexp_extract({path}, '(\\.[^.]*)$', 1) IN ('.ts', '.js', '.tsx', '.jsx') THEN 1.0 ELSE 0.2 END"
    )


def centrality(degree: Column, most: Column) -> Column:
    return F.when((degree <= 0) | (most <= 0), 0.0).otherwise(F.log1p(degree) / F.log1p(most))


def generation_of(tag: Column) -> Column:
    """Number of a tag like ``ast:3``; null for anything else."""
    return F.nullif(F.regexp_extract(tag, "^[a-z]+:([0-9]+)$", 1), F.lit("")).try_cast("int")


def generation_mode(tag: Column) -> Column:
    return F.nullif(F.regexp_extract(tag, "^([a-z]+):[0-9]+$", 1), F.lit(""))
