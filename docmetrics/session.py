"""Session helpers.

On a cluster the session is built by the platform; these helpers only fill in
what is unset. Scratch output (stream sinks, lineage cuts) goes under the
shared folder named by ``spark.checkpoint.dir``; a private temporary folder is
set only when the session has none (local tests).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Map keys from later sources win, as in a dict merge {**a, **b}.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "docmetrics") -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "12g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (a temporary folder is then shared)."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it is unset, a temporary one is set if the master is
    local; elsewhere executors would each write to their own disk, so it raises."""
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        cur = spark.sparkContext.getCheckpointDir()
    if not cur:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all "
                               "executors share")
        cur = tempfile.mkdtemp(prefix="docmetrics-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
        spark.sparkContext.setCheckpointDir(cur)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(cur)
    return cur


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches that go to Python workers hold about ``BATCH_BYTES``, if the session does not say otherwise. Spark's
    64 MB would be 10,000 documents, which a worker holds as input, as result and as what waits to be read; a
    chunking stage has two workers a core."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/docmetrics/{name}/{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str = "tables") -> DataFrame:
    """Write ``df`` once to the session's checkpoint folder (a job of its own) and read it back.

    For intermediate tables read by several branches of one plan: the work runs once, and the lineage is cut
    (a lost executor re-reads the files instead of recomputing from the documents)."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)  # one job; checkpoint() would run the plan twice
    return df.sparkSession.read.schema(df.schema).parquet(path)
