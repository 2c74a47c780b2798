"""The catalogue of files: newest rows, scan filters and freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import basename, last_dot, normal_hash, posix, resolve_path

DAY_MS = 86_400_000

# Folders never scanned, binary files, files that can hold imports.
SKIPPED_SEGMENTS = (".git", ".treeledger", "node_modules")
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".bmp", ".webp", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".pdf", ".zip", ".tar", ".gz", ".bz2", ".7z",
    ".exe", ".dll", ".so", ".dylib", ".mp3", ".mp4", ".wav", ".avi", ".mov",
)
INDEXABLE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".kt", ".kts", ".java")


def newest_files(files: DataFrame) -> DataFrame:
    """(path, hash, last_checked, summary): one row for each resolved path, the one checked last.

    Equal times are settled by the greatest hash, then summary. Rows without a path are left out.
    """
    row = F.struct("last_checked", normal_hash(F.col("hash")).alias("hash"), "summary")
    rows = files.select(resolve_path(F.col("path")).alias("path"), row.alias("row")).where("path <> ''")
    return rows.groupBy("path").agg(F.max("row").alias("row")).select("path", "row.hash", "row.last_checked", "row.summary")


def matches(path: Column, pattern: str) -> Column:
    """``*.x`` is an ending, ``d/`` and ``d/*`` a folder, anything else a part of the path."""
    if pattern.startswith("*."):
        return path.endswith(pattern[1:])
    if pattern.endswith(("/", "/*")):
        folder = pattern.removesuffix("*").removesuffix("/")
        return path.startswith(folder + "/") | (path == folder)
    return path.contains(pattern)


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def scannable(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether a scan keeps the path: no skipped folder, no binary, in ``include`` (if any), not in ``exclude``."""
    keep = ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_SEGMENTS)))
    keep = keep & ~F.lower(last_dot(path)).isin(*BINARY_EXTENSIONS)
    if include:
        keep = keep & _any([matches(path, p) for p in include])
    if exclude:
        keep = keep & ~_any([matches(path, p) for p in exclude])
    return keep


def indexable(path: Column) -> Column:
    """Whether imports are read from the file; letter case of the extension does not count."""
    return F.lower(last_dot(path)).isin(*INDEXABLE_EXTENSIONS)


def settled(mtime: Column, last_checked: Column, window_ms: int = 2000) -> Column:
    """Whether a file need not be read again: it was changed more than ``window_ms`` before it was last checked. False where a time is unknown."""
    return F.coalesce(mtime < last_checked - F.lit(window_ms), F.lit(False))


def placeholder(path: Column, hash: Column) -> Column:
    """Whether the file is a ``.gitkeep`` of zero bytes, by the hash of its raw bytes."""
    return (basename(path) == ".gitkeep") & hash.eqNullSafe(F.sha2(F.lit("").cast("binary"), 256))


def in_scope(path: Column, prefix: str | None) -> Column:
    """The path is the prefix or lies below it; an empty prefix, or one of slashes, holds all."""
    scope = (prefix or "").strip().replace("\\", "/")
    while scope.startswith(("./", "/")):
        scope = scope.removeprefix("./").removeprefix("/")
    scope = scope.rstrip("/")
    return F.lit(True) if not scope else (posix(path) == scope) | posix(path).startswith(scope + "/")


def stale(files: DataFrame, now_ms: Column, max_age_ms: int = 30 * DAY_MS) -> DataFrame:
    """Rows checked longer than ``max_age_ms`` before now, exactly that long not included."""
    return files.where(F.col("last_checked") < now_ms - F.lit(max_age_ms))


def freshness(catalogue: DataFrame, contents: DataFrame, now_ms: Column) -> DataFrame:
    """(path, status, age_seconds, suggest_full_read) of each path of either side.

    ``contents``: path, hash of today. A ``hit`` has the same hash and a summary; ``pending``
    the same hash without one; ``stale`` another hash; ``deleted`` no contents; ``new`` no
    row. Only hits have an age, in whole seconds, and the flag for summaries of low confidence.
    """
    both = catalogue.alias("c").join(contents.select("path", F.col("hash").alias("today"), F.lit(True).alias("there")), "path", "full")
    same = F.coalesce(F.col("hash") == F.col("today"), F.lit(False))
    status = (
        F.when(F.col("there").isNull(), "deleted")
        .when(F.col("last_checked").isNull() & F.col("hash").isNull(), "new")
        .when(same & F.col("summary").isNotNull(), "hit")
        .when(same, "pending")
        .otherwise("stale")
    )
    out = both.select("path", status.alias("status"), "last_checked", F.col("summary.confidence").alias("confidence"))
    hit = F.col("status") == "hit"
    age = F.floor((now_ms - F.col("last_checked")) / F.lit(1000))
    return out.select("path", "status", F.when(hit, age).alias("age_seconds"), F.when(hit, F.coalesce(F.col("confidence") == "low", F.lit(False))).alias("suggest_full_read"))


def capped_exports(catalogue: DataFrame, most: int = 5) -> DataFrame:
    """Paths with at most ``most`` exports, and the whole number where some are left out."""
    exports = F.col("summary.exports")
    return catalogue.where(F.col("summary").isNotNull()).select("path", F.slice(exports, 1, most).alias("exports"), F.when(F.size(exports) > most, F.size(exports)).alias("exports_truncated"))


def entry_points(catalogue: DataFrame) -> DataFrame:
    return catalogue.where(F.col("summary.purpose").startswith("entry point")).select("path", F.col("summary.purpose").alias("purpose"))
