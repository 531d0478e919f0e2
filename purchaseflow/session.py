"""Spark session settings shared by the library, the tests and the bench.

The library never creates a session on its own inside an operator: every public
function takes DataFrames (or a session) and returns DataFrames.  This module only
holds the configuration the engine relies on:

* ANSI mode on (the Spark 4 default) -- the cleaning code uses ``try_*`` forms
  everywhere a value may be malformed, so bad input becomes null, never an error;
* UTC session time zone, so ``timestamp_ntz`` fixtures compare 1:1 with DuckDB;
* ``spark.sql.chunkBase64String.enabled=false`` so ``base64`` yields one line
  (a data URL must not carry line breaks);
* generated methods over 8,000 bytecodes are not used whole (HotSpot never compiles such a
  method, it interprets every row): their stage runs as split projections instead;
* AQE on, with skew-join splitting, so hot file names / order keys are split at
  run time instead of landing in a single reducer.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ENGINE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "purchaseflow", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a local session for tests and benchmarks.

    On a cluster the caller owns the session; use :func:`configure` on it instead.
    """
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("PF_DRIVER_MEMORY", "16g")))
    for k, v in {**ENGINE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the engine needs to an existing session."""
    for k, v in ENGINE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static confs on a running session are left as they are
            pass
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (the programmatic form of
    ``--py-files``): zip it once per session and add it with ``addPyFile``.  Needed
    by stages that run Python on executors (the extraction stage)."""
    import zipfile

    try:
        key = spark.sparkContext.applicationId
    except Exception:  # a Connect session has no SparkContext
        key = spark.conf.get("spark.app.id", str(id(spark)))
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    target = os.path.join(tempfile.mkdtemp(prefix="pf-pyfiles-"), "purchaseflow.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    try:
        spark.sparkContext.addPyFile(target)
    except Exception:  # a Connect session ships Python files as artifacts
        spark.addArtifacts(target, pyfile=True)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at storage that the driver and all executors
    share, and is used as is.  Only a session whose master is ``local`` may leave it
    unset: its executors share the driver's disk, so a fresh scratch folder is created.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Connect session has no SparkContext: use the setting alone
        sc = None
    configured = (sc.getConf().get("spark.checkpoint.dir", None) if sc else None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if configured:
        if sc and not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if sc and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc or not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all hosts share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pf-checkpoint-"))
    return sc.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside give back their shuffle files as soon as they end; others
    keep them until the driver happens to collect its garbage.  For writes, whose plan is run once."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint location, removed by
    :func:`release_scratch` (at the latest when the process ends)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint whose files :func:`release_scratch` removes too."""
    checkpoint_dir(df.sparkSession)
    kept = df.checkpoint()
    kept._staged_path = kept._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    _SCRATCH.append((df.sparkSession, kept._staged_path))
    return kept


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch folder."""
    _SCRATCH[:] = [(s, p) for s, p in _SCRATCH if p != path]
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_scratch() -> None:
    """Delete the scratch folders of this process: call it once the results that read
    them have been written."""
    for spark, path in list(_SCRATCH):
        try:
            drop_scratch(spark, path)
        except Exception:  # the session has ended: the folder's owner removes what is left
            return


atexit.register(release_scratch)
