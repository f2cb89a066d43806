"""Session construction and cluster-wide settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale; all can be overridden by the cluster's own conf.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcasts in this library are explicit and size-checked; keep the
    # automatic threshold modest so nothing that grows with data is broadcast.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_session(master: str | None = None, app: str = "sparqa",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Return (or create) a session with the library defaults applied.

    ``master`` is only used when no session exists yet (local runs and tests);
    on a cluster the launcher decides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    merged = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        merged["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    merged.update(conf)
    for k, v in merged.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins (``DataFrame.checkpoint`` then writes to
    a per-application folder below it, and written tables such as build-once
    caches go directly below it so later sessions can reuse them). Only when it
    is unset on a local master (tests, laptop runs) is a fresh scratch folder
    registered; on a cluster an unset value is an error, never a machine-local
    folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not (sc.master or "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    current = tempfile.mkdtemp(prefix="sparqa-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(current)
    return current


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sparqa`` importable in Python workers (``mapInPandas`` operators).

    The package's ``.py`` files are zipped once per SparkContext and added with
    ``addPyFile``, which distributes them to every executor; workers then do
    not depend on the driver's working directory or on a preinstalled copy.
    """
    import pathlib
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = pathlib.Path(__file__).resolve().parent
    out = pathlib.Path(tempfile.mkdtemp(prefix="sparqa-pkg-")) / "sparqa.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(pkg.rglob("*.py")):
            z.write(f, f.relative_to(pkg.parent).as_posix())
    sc.addPyFile(str(out))
    _SHIPPED.add(app)
