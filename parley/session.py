"""SparkSession construction and job-wide settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the library relies on. AQE re-plans joins and
# aggregations at run time (coalescing small shuffle partitions, splitting
# skewed join partitions); none of them fixes a memory or executor layout.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of lineage cuts are removed once their data is unreachable
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "parley", master: str | None = None,
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """Return (or create) the session with the library's defaults applied."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> str:
    """Send this package to the Python workers (``addPyFile`` of a zip), for the
    functions that run there and import it. Operators that need Python call it
    themselves, so any session works, whatever folder it was started in. Done
    once per SparkContext."""
    import shutil

    sc = spark.sparkContext
    key = sc.applicationId
    pkg = os.path.dirname(os.path.abspath(__file__))
    if key in _SHIPPED:
        return pkg
    base = os.path.join(tempfile.mkdtemp(prefix="parley-pkg-"), "parley")
    archive = shutil.make_archive(base, "zip", root_dir=os.path.dirname(pkg), base_dir=os.path.basename(pkg))
    sc.addPyFile(archive)
    _SHIPPED.add(key)
    return archive


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Make sure reliable checkpoints have a directory.

    On a cluster the directory comes from ``spark.checkpoint.dir`` (a shared
    file system); without it a cluster run stops here rather than write
    checkpoints to a machine-local folder. Only local runs and tests get a
    scratch directory when nothing is configured.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if fallback:
            configured = fallback
        elif sc.master.startswith("local"):
            configured = tempfile.mkdtemp(prefix="parley-ckpt-", dir=os.environ.get("TMPDIR"))
        else:
            raise RuntimeError("spark.checkpoint.dir is not set: point it at a folder shared by the cluster")
    sc.setCheckpointDir(configured)
    return configured
