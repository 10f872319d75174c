"""Session helpers: a tuned local session for tests/bench and a shared
checkpoint folder taken from the cluster's ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "ledgerline", driver_memory: str = "16g") -> SparkSession:
    """Local session for tests and the bench.  On a cluster, use the
    cluster's own session; ``recommended_conf`` lists what matters."""
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus)) or 8
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in recommended_conf(parts).items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", driver_memory).config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def recommended_conf(shuffle_partitions: int) -> dict[str, str]:
    """Settings the operators are designed around.  At 100 TB scale set
    ``spark.sql.shuffle.partitions`` to total cores x 2-3 and let AQE
    coalesce; keep ``maxPartitionBytes`` at 128-256 MB so a task holding
    long documents still fits executor memory."""
    return {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # text extraction is CPU-bound: do not merge small shuffle outputs
        # into a few large tasks (only matters for small inputs)
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 * 1024),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }


#: Java compiles no method of more bytecodes than this; a larger one is interpreted for ever.
COMPILED_METHOD = 8000


def compiled_methods(spark: SparkSession) -> None:
    """Stages whose one generated method would be too large for Java's
    compiler run operator by operator, each split into small methods, where
    the session leaves the default."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED_METHOD))


_LOCAL_BASE: dict[str, str] = {}


def _shared_base(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset on a
    local master (tests, bench) a folder under /tmp, one per application.  On
    a cluster without the setting this raises: a machine-local folder is
    never used there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_BASE:
        _LOCAL_BASE[app] = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
    return _LOCAL_BASE[app]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared folder, with or without a
    scheme; Spark creates it when it writes, on the file system it names."""
    return f"{_shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
