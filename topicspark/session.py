"""Session settings and the reliable checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession

# Settings every job of the library expects.  AQE re-plans joins at runtime:
# a join side whose materialised size is under the broadcast threshold is
# broadcast, and skewed sort-merge partitions are split.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "topicspark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("TOPICSPARK_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES: list[list[DataFrame]] = []          # tables written in the open ``superseded`` blocks
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``topicspark`` importable in the Python workers (pandas UDF
    kernels refer to its functions): zip the package once per application and
    add it with ``addPyFile``, which distributes it to every executor."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="topicspark-pkg-"), "topicspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder and worker-side package; idempotent."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder of written tables and checkpoints: the session's
    ``spark.checkpoint.dir``, or, where it is unset (as in tests), a folder
    beside the session's tables (``spark.sql.warehouse.dir``)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    sc.setCheckpointDir(f"{warehouse}/topicspark-checkpoints")
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame, observe: dict | None = None) -> DataFrame:
    """Cut lineage by writing a parquet table into the checkpoint folder and
    reading it back: one job, the table survives executor loss (unlike a
    local checkpoint), and later reads get parquet pruning.

    ``observe`` maps names to aggregate columns that are computed in the same
    job; their values are put back into the dict.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tbl-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        if observe:
            obs = Observation(f"ckpt_{uuid.uuid4().hex[:8]}")
            df = df.observe(obs, *[c.alias(k) for k, c in observe.items()])
            df.write.parquet(path)
            observe.update(obs.get)
        else:
            df.write.parquet(path)
    back = spark.read.parquet(path)
    back.written_to = path
    if _SCOPES:
        _SCOPES[-1].append(back)
    return back


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files on the executors' disks:
    later reads go to the table, so Spark removes them when the job has ended
    and not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def superseded() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are emptied at the end, but for those passed
    through the function it gives: ``with superseded() as keep: x = keep(...)``."""
    mine, kept = [], []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _SCOPES.append(mine)
    try:
        yield keep
    finally:
        _SCOPES.pop()
    if _SCOPES:
        _SCOPES[-1] += kept
    discard(*[df for df in mine if not any(df is k for k in kept)])


def discard(*tables: DataFrame | None) -> None:
    """Empty written tables that nothing reads any more.  Their folders stay,
    with one file that holds the schema (the data source has no delete)."""
    def empty(df: DataFrame) -> None:
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(df.written_to)
        df.written_to = None

    some = list({df.written_to: df for df in tables if getattr(df, "written_to", None)}.values())
    if some:
        with ThreadPoolExecutor(min(8, len(some))) as pool:
            list(pool.map(empty, some))
