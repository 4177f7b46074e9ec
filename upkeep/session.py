"""Session construction and lineage cuts.

Library code never invents a storage location: the checkpoint folder is whatever the
cluster names in ``spark.checkpoint.dir``.  Only tests and the local benchmark set one,
and only when it is unset.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings that matter at scale; all are plain Spark SQL configuration.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime broadcast only when the materialised side is measured below this size.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "upkeep",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster use the cluster's builder plus SCALE_CONF."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("UPKEEP_DRIVER_MEMORY", "16g")))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_scale_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to an existing session (e.g. the driver's)."""
    for k, v in SCALE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked settings are left as the cluster set them
            pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the session names none, a single-machine session (``local[...]``, as in tests) sets
    a temporary folder of its own; on a cluster that would be a machine-local folder, so the
    call raises instead.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all "
                             "executors share")
        d = tempfile.mkdtemp(prefix="upkeep-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def ensure_test_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Tests/bench only: use the session's folder, or ``fallback`` where none is set."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


class Scratch:
    """The tables that one computation has written; ``drop()`` deletes them.

    A context manager only for jobs that have consumed their result: a returned lazy plan
    still reads the tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def new_path(self) -> str:
        """A new folder's name in the shared checkpoint folder."""
        path = os.path.join(checkpoint_dir(self.spark), "upkeep-tables", uuid.uuid4().hex)
        self.paths.append(path)
        return path

    def write(self, df: DataFrame) -> DataFrame:
        path = self.new_path()
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.paths = []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        self.drop()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give every Python worker this package, wherever the session was started from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="upkeep-ship-")
    staged = os.path.join(folder, "src")
    shutil.copytree(root, os.path.join(staged, os.path.basename(root)),
                    ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "upkeep-package"), "zip", staged))
    _shipped.add(app)


def materialize(df: DataFrame, scratch: Scratch | None = None, require: str | None = None) -> DataFrame:
    """Cut lineage by writing the rows as a Parquet table in the shared checkpoint folder
    and reading them back.  Runs a job at once, while the caller's plan is still being built.

    One job computes the rows once (``Dataset.checkpoint`` would compute them twice: once
    to count, once to write); the files survive a lost executor because they live in the
    cluster's shared folder; the read-back plan gets Parquet column pruning and row-count
    statistics (so AQE can size joins against it).  Pass a ``Scratch`` to be able to delete
    the table when its consumers are done.  ``require`` names rows that must not be none: they are
    counted by the job that writes them, and an error tells which were missing.
    """
    scratch = scratch or Scratch(df.sparkSession)
    if require is None:
        return scratch.write(df)
    seen = Observation()
    out = scratch.write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    if not seen.get.get("n"):
        raise ValueError(f"no rows: {require}")
    return out
