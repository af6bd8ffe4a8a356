"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings this library is written for.  A cluster normally supplies its own
#: shuffle parallelism; AQE then coalesces or splits the partitions at run time.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Large column expressions are built in Python; skip call-site capture.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str = "concordat", cpus: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster use the one you are given."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = dict(RECOMMENDED_CONF)
    settings["spark.sql.shuffle.partitions"] = "8"
    settings["spark.ui.enabled"] = "false"
    settings["spark.ui.showConsoleProgress"] = "false"
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) is a local
    temporary folder used, and the setting is then filled in for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written into the shared folder and read back, so that it is worked out once."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, limit_bytes: int = 64 << 20) -> bool:
    """Whether the optimizer's size estimate proves ``df`` fits a broadcast."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) <= limit_bytes
