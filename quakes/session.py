"""Session settings and the shared folder for materialised tables."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: naive-UTC timestamps, ANSI arithmetic, AQE for
# runtime re-planning (partition coalescing, skew splitting, broadcast switch).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Small fixed tables are shipped as Arrow batches (no Python worker).
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Whole-stage codegen emits large methods for the wide cleaning projection;
# let HotSpot JIT-compile them (its default skips methods over 8 KB of
# bytecode, which leaves them interpreted).  Set on executors of a cluster too.
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "quakes") -> SparkSession:
    """Local session for tests, bench and scripts (clusters bring their own)."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("QUAKES_DRIVER_MEMORY", "8g"))
        # remove DataFrame.checkpoint() files once the DataFrame is unreachable
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.extraJavaOptions", JVM_OPTIONS)
        .config("spark.executor.extraJavaOptions", JVM_OPTIONS)
    )
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to a session we did not build."""
    for k, v in SESSION_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked conf on a managed cluster
            if spark.conf.get(k, None) != v:  # without it answers could differ
                raise


#: Partition values that a task keeps files open for; the rows of more are sorted (and spilled).
OPEN_PARTITIONS = 32
#: Row groups of these files: what an open file holds in memory at most.
OPEN_FILE_OPTIONS = {"parquet.block.size": str(16 << 20)}


@contextmanager
def open_partitions(spark: SparkSession) -> Iterator[dict[str, str]]:
    """Partitioned writes within put each row into its partition's open file, so that a
    task's memory does not grow with its rows, as it does when it sorts them by partition.
    Gives the writer's options."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(OPEN_PARTITIONS))
    try:
        yield OPEN_FILE_OPTIONS
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and must be a shared file system.
    Only when it is unset and the session is local (tests, the bench) is a
    temporary folder chosen, once per application.
    """
    app = spark.sparkContext.applicationId
    d = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_DIRS.get(app)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        d = _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="quakes-ckpt-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


# application id -> the folder chosen for a local session without the setting
_LOCAL_DIRS: dict[str, str] = {}


def table_dir(spark: SparkSession, *parts: str) -> str:
    """A folder under the checkpoint dir, private to this application."""
    app = spark.sparkContext.applicationId
    key = hashlib.sha1("/".join(parts).encode()).hexdigest()[:12]
    return f"{checkpoint_dir(spark)}/quakes-tables/{app}/{parts[-1] if parts else 't'}-{key}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (works on shared stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def files_state(spark: SparkSession, path: str) -> str:
    """Changes when a file under ``path`` does (by names, sizes and times of change)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return hashlib.sha1(repr(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found)).encode()).hexdigest()
