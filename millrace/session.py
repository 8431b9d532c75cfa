"""Session construction and the settings the plans rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution carries skew splitting and partition coalescing; the rest keeps Python transfers vectorised.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # what cut() writes goes when its frame is collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benches; a cluster passes its own session to every operator instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``. Where none is set a local one is made in local mode (tests);
    on a cluster that is an error, as a machine's own folder is lost with it."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "millrace-checkpoints"))


def cut(frame: DataFrame) -> DataFrame:
    """Materialise in the reliable checkpoint folder: survives lost executors and truncates the lineage."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def spread(frame: DataFrame) -> DataFrame:
    """A table of few splits dealt out to all cores, for a costly step to come; one with splits enough as it is."""
    parallel = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= parallel else frame.repartition(parallel)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, for clusters whose workers do not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="millrace"), "millrace.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(target)
    context._millrace_shipped = True
