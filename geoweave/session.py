"""Session helpers: local session for tests/bench, checkpoint directory, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "geoweave") -> SparkSession:
    """Session used by tests and ``bench.py`` (never by library code)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GEOWEAVE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, honouring the cluster's ``spark.checkpoint.dir``.

    On a cluster the shared folder must be named by ``spark.checkpoint.dir``.  Only a single-JVM
    session (master ``local…``), where driver and tasks share their disk, gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="geoweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that is shuffled, not broadcast: its size is guessed from compressed files that are far smaller than its rows."""
    return df.hint("merge")


def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt out by ``cols`` before costly expressions: a file of a few MB, read by one task, may hold millions of rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *cols)


#: Rows that one task sorts or aggregates, where the number of tasks follows the input.
TASK_ROWS = 500_000


def tasks_of(spark: SparkSession, n_rows: int) -> int:
    """Tasks that hold about TASK_ROWS rows each; no fewer than the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // TASK_ROWS))


def tasks_for(df: DataFrame, per_row: int = 1) -> int:
    """:func:`tasks_of` the rows of ``df`` if every one becomes ``per_row``."""
    return tasks_of(df.sparkSession, df.count() * per_row)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What queries inside have shuffled goes when each ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame) -> str:
    """Folder under the shared checkpoint folder to which ``df`` was written once; :func:`opened` reads it, :func:`freed` deletes it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return path


def opened(like: DataFrame, *paths: str) -> DataFrame:
    """The rows of stored folders, with the columns of ``like``."""
    return like.sparkSession.read.schema(like.schema).parquet(*paths)


def freed(spark: SparkSession, *paths: str) -> None:
    """Deletes stored folders; what was made of them must be stored itself by now, or it is lost."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back, for frames that are joined with themselves round after round.

    A checkpoint keeps the size that its plan was guessed to have: for a join the product of both sides', so in a loop the number
    of its digits doubles each round, until the driver holds nothing else.  Files have the size they have.
    """
    return opened(df, stored(df))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); used between iterations."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
