"""Path functions as Spark columns, with their DuckDB text for the oracle queries."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def posix(path: Column) -> Column:
    """Backslashes become slashes."""
    return F.translate(path, "\\", "/")


def compose(text: Column) -> Column:
    """Unicode composed form (NFC). Plain ASCII skips the normaliser.

    Spark has no such function of its own; the ICU library that ships with it for
    collations is called inside the JVM, so no row goes to Python.
    """
    nfc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\x00-\x7f]"), nfc).otherwise(text)


def resolve_segments(path: Column) -> Column:
    """Drop empty and ``.`` segments; ``..`` cancels the segment before it, if there is one."""

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment.isin("", "."), done)
            .when(segment == "..", F.regexp_replace(done, "/?[^/]*$", ""))
            .when(done == "", segment)
            .otherwise(F.concat(done, F.lit("/"), segment))
        )

    walked = F.aggregate(F.split(path, "/", -1), F.lit(""), step)
    return F.when(path.rlike(r"(^|/)\.{0,2}(/|$)"), walked).otherwise(path)


def resolve_path(path: Column) -> Column:
    """Spelling-free form of a relative path; null stays null, a path of dots gives ''.

    Use it in a projection: the composed form makes the expression nondeterministic for
    Spark, which keeps it out of join conditions and grouping keys.
    """
    return compose(resolve_segments(posix(path)))


def resolve_sql(path: str) -> str:
    """DuckDB text of ``resolve_path``."""
    return (
        f"nfc_normalize(list_reduce(string_split(replace({path}, '\\', '/'), '/'), "
        "lambda done, seg: CASE WHEN seg IN ('', '.') THEN done "
        "WHEN seg = '..' THEN regexp_replace(done, '/?[^/]*$', '') "
        "WHEN done = '' THEN seg ELSE done || '/' || seg END, ''))"
    )


def inside_root(path: Column) -> Column:
    """Whether a relative path stays below its root and holds no null character; null for null."""
    segments = F.filter(F.split(posix(path), "/", -1), lambda s: ~s.isin("", "."))
    step = lambda depth, s: F.when(depth < 0, depth).otherwise(F.when(s == "..", depth - 1).otherwise(depth + 1))
    return (F.aggregate(segments, F.lit(0), step) >= 0) & ~path.contains("\0") & ~path.startswith("/")


def project_of(path: Column) -> Column:
    """First segment of a resolved path."""
    return F.substring_index(path, "/", 1)


def dirname(path: Column) -> Column:
    """Parent folder; '.' for a file at the root, and for '.' itself."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extname(path: Column) -> Column:
    """Extension of the last segment with its dot; a leading dot alone makes none."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1)


def last_dot(path: Column) -> Column:
    """From the last dot of the whole text on; a dotfile is all extension."""
    return F.regexp_extract(path, r"(\.[^.]*)$", 1)


def typed_extension(path: Column) -> Column:
    """As ``last_dot`` but ``.d.ts`` counts as one extension."""
    return F.when(path.endswith(".d.ts"), F.lit(".d.ts")).otherwise(last_dot(path))


def normal_hash(value: Column) -> Column:
    """Hash without its ``sha256:`` prefix, lower-cased."""
    return F.regexp_replace(F.lower(value), "^sha256:", "")


def normal_hash_sql(value: str) -> str:
    return f"regexp_replace(lower({value}), '^sha256:', '')"


def ancestors(path: Column) -> Column:
    """All folders that contain the file, from the first segment down."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")),
    ).otherwise(F.array().cast("array<string>"))


def validated(root: str, path: str) -> str:
    """``path`` relative to ``root``, with slashes; '' for the root. A null character or a way out of the root is an error."""
    if "\0" in path:
        raise ValueError("null character in a path")
    base = posixpath.normpath(root.replace("\\", "/"))
    full = posixpath.normpath(posixpath.join(base, path.replace("\\", "/")))
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{path} is not below the root")
    return "" if full == base else full[len(base.rstrip("/")) + 1 :]
