"""Session, shared storage and size-checked broadcasts: everything that touches the cluster's set-up."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of any script, for btrim: the code points of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def build_session(app: str = "loomgraph", cpus: int | None = None, shuffle: int | None = None) -> SparkSession:
    """A local session for tests and benches. On a cluster the operators use whatever session they are given."""
    n = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle or n),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("LOOM_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It is spark.checkpoint.dir where that is set; only a local session without
    it gets a temporary folder of its own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None or not os.path.isdir(own):
        own = shared_dir.own = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


#: The folders that this session has written and not released.
_written: list[str] = []


def stash_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def release(spark: SparkSession) -> int:
    """Deletes what was written to the shared folder so far and gives the number of folders. A result that still reads
    them must have been written before."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    n = 0
    while _written:
        path = fs.Path(_written.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives the loss of executors, and is computed
    once however often it is read."""
    path = stash_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
