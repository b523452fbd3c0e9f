"""Session helpers: building a session for tests / bench, and the shared folder
used to cut lineage (checkpoints, materialised tables, stream state)."""
from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a local session without ``spark.checkpoint.dir`` keeps its intermediate data.
LOCAL_BASE = "/tmp/vellum-scratch"

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Translation calls are side effects: never run a speculative copy.
    "spark.speculation": "false",
    # Remove checkpoint files of DataFrames that are no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "vellum", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  A ``local[...]``
    session without one uses ``LOCAL_BASE``/<application id>, removed when Python ends.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")
            d = f"{LOCAL_BASE}/{sc.applicationId}"
            atexit.register(shutil.rmtree, d, ignore_errors=True)
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/vellum-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the session's part of the shared folder (never reused)."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove everything under ``scratch_path``; DataFrames that read it are gone then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder.

    Used after the model stage so that a model call happens once per chunk
    even when later stages are recomputed (lost executor, several actions)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per SparkContext).

    Stages that run Python (model, pluggable extractor, stream state) pickle
    functions by reference to this package.  On a cluster the package is shipped at
    submit time (``--py-files vellum.zip``, i.e. ``spark.submit.pyFiles``) and nothing
    is written here.  A local-mode session (tests, bench) gets a zip of it through
    ``addPyFile``, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_vellum_shipped", False) or not sc.master.startswith("local"):
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(LOCAL_BASE, sc.applicationId, "code", "vellum.zip")
    os.makedirs(os.path.dirname(out), exist_ok=True)
    atexit.register(shutil.rmtree, os.path.dirname(out), ignore_errors=True)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    sc._vellum_shipped = True
