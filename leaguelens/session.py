"""Session settings every operator relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key of a join even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leaguelens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    It is the cluster's ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary one: executors of a cluster could not read a
    folder of the driver's machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="leaguelens-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames made in here give back the files of their shuffles when an action on them ends.

    Else these files lie on the executors' disks until the driver happens to collect its garbage.
    """
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; nothing reads the files of its shuffles again."""
    checkpoint_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        own = df.select("*")  # the caller's frame keeps its shuffles
        return own.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, readable by every executor."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
