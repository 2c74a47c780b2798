"""Source files that do not parse in the language that their extension names."""

from __future__ import annotations

from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeledger.functions.paths import last_dot, project_of, resolve_path
from treeledger.llm.syntax.check import LANGUAGES
from treeledger.session import read_table

#: Code points of the text at an error that are told.
ERROR_TEXT = 40
#: Outcomes that a task remembers, so that copies of a text are parsed once; each takes a few hundred bytes.
REMEMBERED = 1 << 16
#: Copies of one text are spread over so many tasks.
COPY_SALTS = 16
_OUTCOMES: dict[tuple[str, bytes], tuple] = {}

_RESULT = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("error_line", T.IntegerType()), T.StructField("error_text", T.StringType())])


@F.pandas_udf(_RESULT)
def parse_outcome(language: pd.Series, contents: pd.Series) -> pd.DataFrame:
    """Whether each text is valid; else the line (from 1) of its first unrecoverable error and the text there."""
    from treeledger.llm.syntax.check import first_error

    rows = []
    for name, text in zip(language, contents):
        if name is None or text is None:
            rows.append((None, None, None))
            continue
        key = name, blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key not in _OUTCOMES:
            if len(_OUTCOMES) >= REMEMBERED:
                _OUTCOMES.clear()
            at = first_error(name, text)
            _OUTCOMES[key] = (True, None, None) if at is None else (False, text.count("\n", 0, at) + 1, text[at : at + ERROR_TEXT].split("\n")[0])
        rows.append(_OUTCOMES[key])
    return pd.DataFrame(rows, columns=["valid", "error_line", "error_text"])


def language_of(path: Column) -> Column:
    """Language that the extension names, letter case ignored; null for others."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(names, F.lower(last_dot(path)))


def parse_files(files: DataFrame) -> DataFrame:
    """(path, project, language, valid, error_line, error_text), one row for each path.

    ``files``: path, contents, mtime; further columns are ignored. Paths are resolved; the
    row with the greatest mtime decides (null mtimes last; equal ones by the greatest
    contents, null contents last). ``valid`` is null for null contents and for extensions
    without a grammar. Texts are parsed whole; copies of a text meet in a few tasks, each of
    which parses it once. ``error_text`` is what stands at the error, to the end of its line
    and ``ERROR_TEXT`` code points at most. Rows without a path are left out.
    """
    # Parsing costs far more than moving a text, so its tasks are as many as the cluster can use, however few bytes they hold.
    spark = files.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    latest = (
        files.select(resolve_path(F.col("path")).alias("path"), F.struct("mtime", "contents").alias("row"))
        .where(F.col("path").isNotNull())
        .groupBy("path")  # reduced before it moves, so a path of many rows is no hot key
        .agg(F.max("row").getField("contents").alias("contents"))
        .repartition(tasks, F.xxhash64("contents"), F.pmod(F.xxhash64("path"), F.lit(COPY_SALTS)))
        .withColumn("language", language_of(F.col("path")))
    )
    # Called nondeterministic, so that a filter on its outcome does not take it below the exchange.
    parsed = latest.withColumn("r", parse_outcome.asNondeterministic()("language", "contents"))
    return parsed.select("path", project_of(F.col("path")).alias("project"), "language", "r.valid", "r.error_line", "r.error_text")


def p4_found(spark, folder: str) -> DataFrame:
    return parse_files(read_table(spark, folder, "source_files")).where("not valid").select("path")


def p4_errors(spark, folder: str) -> DataFrame:
    """The first unrecoverable error of each file that does not parse."""
    return parse_files(read_table(spark, folder, "source_files")).where("not valid").select("path", "language", "error_line", "error_text")


def p4_rates(spark, folder: str) -> DataFrame:
    """Files and syntax errors per project and language, and beside them by the confidence of the files' summaries.

    ``n_high``, ``n_medium``, ``n_low`` and ``n_unknown`` count the files that were read by
    confidence, ``invalid_high`` and so on those of them that do not parse.
    """
    newest = (
        read_table(spark, folder, "files")
        .select(resolve_path(F.col("path")).alias("path"), F.struct("last_checked", F.col("summary.confidence").alias("confidence")).alias("row"))
        .groupBy("path")
        .agg(F.max("row").getField("confidence").alias("confidence"))
    )
    parsed = parse_files(read_table(spark, folder, "source_files")).select("path", "project", "language", "valid").join(newest, "path", "left")
    level = F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("unknown")
    read, bad = F.col("valid").isNotNull(), F.col("valid") == F.lit(False)
    beside = [F.count_if(test & (level == name)).alias(f"{stem}_{name}") for stem, test in (("n", read), ("invalid", bad)) for name in ("high", "medium", "low", "unknown")]
    rate = F.round(F.count_if(bad) / F.greatest(F.lit(1), F.count("valid")), 6)
    return parsed.groupBy("project", "language").agg(F.count("*").alias("n_files"), F.count_if(~read).alias("n_unread"), F.count_if(bad).alias("n_invalid"), rate.alias("invalid_rate"), *beside)
