"""Session settings and durable staging.

Nothing here is specific to local mode: partition counts are left to the
cluster's own settings and AQE coalesces them at run time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key's partition even when the grouping after the join then needs a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # Call-site capture inspects the Python stack on every column operation; building
    # wide plans is several times faster without it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app: str = "renewlens", *, master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local folder would not survive the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: staging needs a shared folder on a cluster"
        )
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Used where one result feeds several passes (two-pass ranking, fitted bin
    edges). A written table cuts the lineage, keeps column pruning and gives
    the optimizer real sizes, so join strategies are chosen on facts.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/renewlens/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
