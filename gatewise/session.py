"""Session helpers.

Library code never creates its own session; it takes the caller's.  These
helpers exist for tests, ``bench.py`` and scripts.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast is decided from measured plan statistics; dimension tables in
    # this library are tiny and hinted, fact tables never are.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def cluster_conf(input_bytes: int, executor_cores: int, target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Partition sizing for a cluster run over ``input_bytes`` of parquet.

    Splits and shuffle partitions target ~256 MiB so a task's working set
    fits executor memory with room for sort buffers; shuffle partitions are
    at least 3 x total cores so every wave keeps all cores busy, and AQE
    coalesces small ones and splits skewed ones at run time.  At 100 TB this
    gives ~400k input splits and ~400k initial shuffle partitions, coalesced
    by AQE to the advisory size.
    """
    parts = max(3 * executor_cores, -(-input_bytes // target_partition_bytes))
    return {
        **SCALE_CONF,
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "gatewise") -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC, AQE on)."""
    scratch = tempfile.mkdtemp(prefix="gatewise-")
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("GATEWISE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .config("spark.local.dir", os.path.join(scratch, "local"))
    )
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    if os.environ.get("GATEWISE_SESSION_TZ"):  # robustness checks only
        b = b.config("spark.sql.session.timeZone", os.environ["GATEWISE_SESSION_TZ"])
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, scratch)
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``gatewise`` importable in Python workers (pandas folds, UDFs).

    Zips the package once per process and hands it to ``addPyFile``, the
    standard way Spark distributes Python code to executors.  Deployments
    that already pass the package with ``--py-files`` are unaffected.
    """
    import zipfile

    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    # built next to the code it packages (the driver's copy of the library);
    # a read-only install falls back to a scratch folder on the driver
    dist = os.path.join(os.path.dirname(pkg), ".dist")
    try:
        os.makedirs(dist, exist_ok=True)
        probe = os.path.join(dist, f".w{os.getpid()}")
        open(probe, "w").close()
        os.remove(probe)
    except OSError:
        dist = tempfile.mkdtemp(prefix="gatewise-pkg-")
    out = os.path.join(dist, f"gatewise-{os.getpid()}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(id(sc))


def ensure_checkpoint_dir(spark: SparkSession, fallback_root: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared, fault-tolerant folder and is
    used as is, and so is a folder the caller gave to ``setCheckpointDir``.
    Only where neither is set, on a local master (tests), is a scratch folder
    made; elsewhere that would be a machine-local one, so it is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen:
        return chosen
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = fallback_root or tempfile.mkdtemp(prefix="gatewise-ckpt-")
    path = os.path.join(root, "checkpoints")
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # static conf on some deployments; the context setting suffices
        pass
    spark.sparkContext.setCheckpointDir(path)
    return path
