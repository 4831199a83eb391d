"""Session builder and the two things every job needs from its session: tables and durable cuts of lineage."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


SMALL = 64 << 20  # half of what a file split holds by default


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume. ``conf`` overrides; dots in keys are written ``__``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints. A cluster names it in ``spark.checkpoint.dir``; only a session
    without one (tests, a local run) gets a folder of its own."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerloom_ck_"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there: a lost executor then
    costs no recomputation of what came before, and what reads it twice computes it once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete shuffle files and checkpoints that nothing refers to any more. Spark does it when the driver happens to collect
    its garbage; a driver with memory to spare does that late, and until then they all lie on the executors' disks."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores. Only a table smaller than that many blocks of
    ``SMALL`` bytes is moved: it lies in few files and would keep most cores idle. A larger one has its partitions
    from its files and is never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores or df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > cores * SMALL:
        return df
    return df.repartition(cores)
