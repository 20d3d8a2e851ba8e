"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: dict[str, str] = {}  # by application
_HANDED_OUT: list[str] = []

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where the next aggregation then needs its own exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # The JVM does not compile methods above 8000 bytes, it interprets them. Stages with more
    # generated code than that run faster operator by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("formline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def _base_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:  # the setting itself cannot be changed in a running session
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="formline-")
        atexit.register(shutil.rmtree, _OWN_FOLDERS[app], ignore_errors=True)
    return _OWN_FOLDERS[app]


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, visible to every executor.

    The setting belongs to the cluster. Only a single-machine session that has
    none gets a temporary folder of its own, which goes when the process ends.
    Folders handed out are remembered, so that ``release`` can delete them.
    """
    path = f"{_base_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _HANDED_OUT.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate folders of this process; call it once their results are stored.

    Frames that read such a folder are of no use afterwards. Returns the number of deleted folders.
    """
    jvm, gone = spark.sparkContext._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _HANDED_OUT:
        path = jvm.org.apache.hadoop.fs.Path(_HANDED_OUT.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def write_and_reload(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder and reading it back."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
