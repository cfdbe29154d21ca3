"""Session settings and the two helpers that need the session."""

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build(master="local[*]", shuffle_partitions=None, **conf) -> SparkSession:
    """A session with adaptive execution and skew handling on. On a cluster, set only the runtime
    options of ``CONF`` on the session at hand instead."""
    b = SparkSession.builder.master(master).appName("factwright")
    for k, v in {**CONF, **conf}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder for this application under the one the cluster names in ``spark.checkpoint.dir``. A local
    one is made only where none is named and driver and executors are one process, as in tests."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _folders:
        named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = named or tempfile.mkdtemp(prefix="spark-")
        _folders[app] = f"{base}/factwright-{app}-{uuid.uuid4().hex[:8]}"
    return _folders[app]


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by writing a table to the shared folder and reading it back, so that a loop's plan
    stays small, nothing is computed twice and a lost executor costs a scan."""
    path = f"{shared_folder(df.sparkSession)}/cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
