"""Session settings and the few runtime helpers that operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "treeledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session for this library; every setting may be overridden by ``conf``.

    Adaptive execution coalesces small shuffle partitions and splits skewed ones, so one
    generous partition count serves small and large inputs.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # call sites of every column cost as much as building it
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The folder is the one the session names in ``spark.checkpoint.dir``, see ``shared_folder``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors see, named by ``spark.checkpoint.dir``.

    Only a session that runs on one machine may leave it unset and gets a temporary folder;
    on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    return tempfile.mkdtemp(prefix="spark-")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def salted(hot: Column, spread: Column, salts: int) -> Column:
    """Salt of a row: one of ``salts`` values when its key is hot, else 0."""
    return F.when(hot, F.pmod(spread, F.lit(salts))).otherwise(F.lit(0)).cast("int")


def all_salts(hot: Column, salts: int) -> Column:
    """Array of the salts under which the other side's row of a key must be found."""
    return F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))


_shipped: set[str] = set()


def ship_library(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    # Texts may be long, so batches for Python tasks hold fewer rows than Spark's default.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    _shipped.add(context.applicationId)
