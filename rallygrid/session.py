"""Session set-up, table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size stays under this many bytes.
BROADCAST_BYTES = 32 << 20


def get_session(app: str = "rallygrid", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RALLYGRID_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only where none is set (a local
    session, as in tests) fall back to a temporary folder, removed at exit."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="rallygrid-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder once and go on from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class StepTables:
    """Tables of an iteration, written to the checkpoint folder and read back.

    A checkpoint keeps what the optimizer knew of its plan (sizes, constraints), which piles
    up over the steps of a loop; a table starts afresh, and its true size is known, so small
    ones are broadcast by the planner under its own threshold. Only the last ``keep`` tables
    stay; ``close`` removes the rest, once nothing reads them any more."""

    def __init__(self, spark: SparkSession, keep: int = 2) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.keep, self.paths, self.count = spark, keep, [], 0
        self.base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/steps-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, partition_by: str | None = None, keep: bool = False) -> DataFrame:
        """Write ``df`` and read it again; with ``keep`` the table stays until ``close``."""
        path = f"{self.base}/{self.count}"
        self.count += 1
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
        if not keep:
            self.paths.append(path)
            if len(self.paths) > self.keep:
                self._drop(self.paths[-1 - self.keep])
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        self._drop(self.base)

    def _drop(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Measure an already materialised ``df`` and mark it for broadcast when it is small.

    The measure is the summed length of its rows as text, an upper estimate of the rows'
    payload. Returns the frame and whether it was marked."""
    row = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    size = df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("n")).first()["n"]
    return (F.broadcast(df), True) if size <= limit else (df, False)


def own_columns(df: DataFrame, *needed: str) -> DataFrame:
    """Only the named columns: whatever else a table holds can't clash with helper columns."""
    return df.select(*[F.col(f"`{c}`") for c in needed])
