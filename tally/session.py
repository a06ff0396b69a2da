"""Spark session defaults and the shared checkpoint folder.

Everything here is ordinary session configuration: the engine itself is
Catalyst + Tungsten, we only pick sane defaults for a ledger workload.
"""

from __future__ import annotations

import contextlib
import gc
import itertools
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Defaults that matter for the ledger jobs at any scale.
#  - AQE re-plans joins (broadcast only when the runtime size is under the
#    threshold), coalesces small shuffle partitions and splits skewed ones.
#  - UTC keeps timestamps reproducible; driver data is TIMESTAMP_NTZ anyway.
#  - CSV column pruning is off so that short/long records stay flagged as
#    corrupt even when a query reads a subset of the columns.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.csv.parser.columnPruning.enabled": "false",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "tally",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Local/test session builder. On a cluster, use the cluster's session and
    only apply ``SESSION_DEFAULTS`` (see :func:`apply_defaults`)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf["spark.sql.execution.arrow.pyspark.enabled"] = "true"
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bound_listing(spark)
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(total_cores: int, input_bytes: int) -> dict[str, str]:
    """Suggested settings for a large cluster run (pass to the session builder).

    * shuffle partitions: enough that each holds ~128 MB of shuffled data at
      the input size, but at least 3 waves of the cores; AQE coalesces small
      ones and splits skewed ones at run time.
    * file splits of 256 MB: fewer, larger scan tasks for parquet and CSV.
    """
    mb = 1 << 20
    by_size = max(1, input_bytes // (128 * mb))
    partitions = max(3 * total_cores, by_size)
    return {
        **SESSION_DEFAULTS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * mb),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.files.maxPartitionBytes": str(256 * mb),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * mb),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * mb),
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * total_cores),
        # reclaim checkpoint files (per-block tables, layouts) once unused
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def apply_defaults(spark: SparkSession) -> None:
    """Set the runtime SQL defaults on an existing session (cluster case)."""
    for k, v in SESSION_DEFAULTS.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)


#: Spark's default number of tasks that list folders, at most one a path.
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_LISTING_DEFAULT = 10_000


def bound_listing(spark: SparkSession) -> None:
    """List folders of many small files by a few tasks per core, not by one
    task per folder, unless the session has a setting of its own."""
    if int(spark.conf.get(_LISTING, str(_LISTING_DEFAULT))) == _LISTING_DEFAULT:
        spark.conf.set(_LISTING, str(4 * spark.sparkContext.defaultParallelism))


#: Scans of many files take at most so many tasks per core.
_SCAN_TASKS = 16


@contextlib.contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """For actions that list and read many small files. A scan takes some tasks
    per core, each with many files, not one for every few files: Spark's driver
    keeps all tasks. Large files are split as ever. Listed files are not kept in
    the driver for the next reader of the same path, and at the end it gives back
    the memory that they took. Settings of the session's own stay."""
    ours = {"spark.sql.files.maxPartitionNum": str(_SCAN_TASKS * spark.sparkContext.defaultParallelism),
            "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}
    mine = {k: v for k, v in ours.items() if spark.conf.get(k, None) is None}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in mine:
            spark.conf.unset(k)
        gc.collect()  # what Python still refers to stays in the driver
        spark.sparkContext._jvm.System.gc()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared, fault-tolerant
    folder and we always use it. Only when it is unset (local runs, tests)
    do we create one of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        # A machine-local folder is not visible to other executors and is lost
        # with its host: on a cluster the shared folder must be configured.
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, object store)")
    local = tempfile.mkdtemp(prefix="tally-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


#: Scratch folders handed out and not yet released, and who asked for them.
_scratch: list[str] = []
_asked: dict[str, tuple[int, int]] = {}
_numbers = itertools.count(1)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables
    (stream checkpoints, sink outputs, lineage cuts). ``release_scratch``
    removes it."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _asked[path] = next(_numbers), threading.get_ident()
    _scratch.append(path)
    return path


def release_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove the scratch folders that this thread was given since the mark
    ``since`` (without one: all of the process), but for the last ``keep``, once
    what they hold is written or collected."""
    me = threading.get_ident()
    mine = [p for p in _scratch if not since or (_asked[p][0] > since and _asked[p][1] == me)]
    for path in mine[:max(0, len(mine) - keep)]:
        _scratch.remove(path)
        _asked.pop(path)
        remove_path(spark, path)


def scratch_mark() -> int:
    """The point to which a later ``release_scratch(spark, mark)`` goes back."""
    return next(_numbers)


def stage(df, name: str, path: str | None = None):
    """Write ``df`` once as parquet under the shared checkpoint folder (or
    ``path``) and read it back: later scans are columnar and pruned, and the
    lineage (for example a CSV parse) is cut, so a lost executor re-reads the
    staged files instead of re-parsing the source."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a staging folder once nothing lazy refers to it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
