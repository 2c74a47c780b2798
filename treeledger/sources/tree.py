"""Source trees as tables. Folders are listed and texts are read by tasks.

Spark's own file sources leave out names that start with a dot or an underscore, which
source trees are full of, so tasks open the files themselves; ``root`` must be a folder
that all executors see.
"""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.operators.catalogue import SKIPPED_SEGMENTS, scannable

#: The driver goes down the tree until it knows this many folders, and leaves what lies below them to tasks.
UNITS = 64
_LISTED, _READ = "path string, size bigint, mtime bigint", "path string, contents string, hash string, size bigint, mtime bigint"


def _folders(root: str, folder: str) -> list[str]:
    try:
        below = sorted(e.name for e in os.scandir(Path(root, folder)) if e.is_dir(follow_symlinks=False) and e.name not in SKIPPED_SEGMENTS)
    except OSError:
        return []
    return [f"{folder}/{name}" if folder else name for name in below]


def _units(root: str) -> list[tuple[str, bool]]:
    """(folder, whether all below it counts) of the parts in which a tree is listed."""
    flat, frontier = [], [""]
    while frontier and len(frontier) < UNITS:
        flat += frontier
        frontier = [below for folder in frontier for below in _folders(root, folder)]
    return [(f, False) for f in flat] + [(f, True) for f in frontier]


def in_git(root: str) -> bool:
    run = subprocess.run(["git", "-C", root, "rev-parse", "--is-inside-work-tree"], capture_output=True, text=True, timeout=60, check=False)
    return run.returncode == 0 and run.stdout.strip() == "true"


def _walked(root: str, folder: str, deep: bool) -> Iterator[str]:
    """Relative paths of regular files; unreadable folders are passed over."""
    for place, below, names in os.walk(Path(root, folder)):
        below[:] = [b for b in below if deep and b not in SKIPPED_SEGMENTS]
        for name in names:
            full = Path(place, name)
            if full.is_file():
                yield full.relative_to(root).as_posix()


def _tracked(root: str, folder: str, deep: bool) -> Iterator[str]:
    """Tracked and untracked, not ignored paths of a git work tree."""
    inside = re.sub(r"([*?\[\]\\])", r"\\\1", folder)
    spec = f":(literal){folder}" if deep else f":(glob){inside}/*" if folder else ":(glob)*"
    run = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard", "--", spec], capture_output=True, text=True, timeout=600, check=True)
    yield from sorted({p for p in run.stdout.split("\0") if p})


def listing(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), max_files: int | None = None) -> DataFrame:
    """(path, size, mtime) of the files of a tree that a scan keeps; of a git work tree only those that git does not ignore.

    With ``max_files`` the first ones in path order are kept. Listed files that are gone have nulls.
    """
    root = str(Path(root).resolve())
    listed = _tracked if in_git(root) else _walked

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, deep in zip(batch["folder"], batch["deep"]):
                out = []
                for path in listed(root, folder, deep):
                    try:
                        state = Path(root, path).stat()
                        out.append((path, state.st_size, int(state.st_mtime * 1000)))
                    except OSError:
                        out.append((path, None, None))
                yield pd.DataFrame(out, columns=["path", "size", "mtime"]).astype({"size": "Int64", "mtime": "Int64"})

    units = _units(root)
    parts = spark.createDataFrame(units, "folder string, deep boolean").repartition(len(units), "folder")
    found = parts.mapInPandas(each, _LISTED).where(scannable(F.col("path"), include, exclude))
    return found.orderBy("path").limit(max_files) if max_files else found


def read_files(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, contents, hash, size, mtime) of the given paths (path).

    Contents are decoded as UTF-8, the hash is that of the raw bytes; an unreadable file
    has nulls.
    """

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                full = Path(root, path)
                try:
                    raw, state = full.read_bytes(), full.stat()
                    out.append((path, raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest(), len(raw), int(state.st_mtime * 1000)))
                except OSError:
                    out.append((path, None, None, None, None))
            yield pd.DataFrame(out, columns=["path", "contents", "hash", "size", "mtime"]).astype({"size": "Int64", "mtime": "Int64"})

    # A path is short and its file long, so tasks are as many as the cluster can use.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return paths.select("path").repartition(tasks, "path").mapInPandas(read, _READ)


def scan(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), max_files: int | None = None) -> DataFrame:
    """The files of a ``listing`` with their texts. Files that are gone are left out."""
    root = str(Path(root).resolve())
    return read_files(spark, root, listing(spark, root, include, exclude, max_files)).where(F.col("hash").isNotNull())
