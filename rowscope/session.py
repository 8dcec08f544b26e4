"""Session helper and lineage cutting.

On a cluster the session is created by the platform; ``get_spark`` only adds
defaults where nothing is configured. ``spark.checkpoint.dir`` is read from the
session: it must name a shared folder on a cluster. Only when it is unset (local
tests) a scratch folder under /tmp is used.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches bound the memory of Python workers (they do not spill).
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    # per-tree samples keep row_number() <= psi rows: cut them before the shuffle for large psi too
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "rowscope", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rowscope`` importable by the Python workers (``--py-files`` done from code).

    Functions sent to ``mapInPandas``/``applyInPandas`` are unpickled on the
    executors, which import this package by name. Once per application the
    package sources are zipped on the driver and added with ``addPyFile``; Spark
    ships the file to every executor. Skipped when the workers already import it
    from a deployed location listed in ``spark.submit.pyFiles``.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED or "rowscope" in (spark.conf.get("spark.submit.pyFiles", "") or ""):
        return
    import rowscope
    root = os.path.dirname(os.path.abspath(rowscope.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="rowscope-pkg-"), "rowscope.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder. Where it is unset, local runs and tests get a
    scratch folder; on a cluster that would be one machine's disk, so it is an error."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="rowscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable (shared-folder) checkpoint; survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20,
                 vector_width: int = 64) -> dict[str, str]:
    """Settings for a large run, derived from the input size and the cluster's cores.

    * shuffle partitions: enough that each holds about ``target_partition_bytes``
      of shuffled data (at least 2 waves of tasks); AQE coalesces small ones and
      splits skewed ones (a key with a third of the rows) at run time.
    * file splits of the same size, so scan tasks match shuffle tasks.
    * Arrow batches sized so one batch of ``vector_width`` doubles stays a few MB in
      the Python worker (Python workers do not spill).
    """
    parts = max(2 * total_cores, int(input_bytes // target_partition_bytes) + 1)
    batch_rows = max(1000, min(10_000, (4 << 20) // max(8 * vector_width, 1)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows),
        "spark.sql.session.timeZone": "UTC",
    }
