"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even when the aggregate above then needs one more
    # exchange: without this a key holding a third of the rows stays in one task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder the cluster names in spark.checkpoint.dir.

    A machine-local folder is used only where that setting is missing (tests, one machine).
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="run-")
    # Short, as Spark cuts long paths in the text of a plan.
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:16]}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside delete their shuffle files when they end, not when the driver collects its garbage.

    For frames that run once: one that runs again makes its shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _written(df: DataFrame, path: str) -> DataFrame:
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: later steps start from files."""
    return _written(df, scratch_path(df.sparkSession, label))


@contextmanager
def lent(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` as ``stored`` returns it; its files are deleted when the block ends."""
    path = scratch_path(df.sparkSession, label)
    try:
        yield _written(df, path)
    finally:
        files, place = _at(df.sparkSession, path)
        files.delete(place, True)


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file if nobody has; False if it is there. Of several callers one succeeds.

    The text is written to a file of its own first and then renamed without overwriting, so the file
    never exists without its text, and a caller that dies half-way leaves only a hidden file that
    nobody reads. The rename is atomic on HDFS and on POSIX file systems; an object store needs a
    Hadoop connector whose rename refuses an existing target.
    """
    files, place = _at(spark, path)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    draft = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    try:
        context.rename(draft, place, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        files.delete(draft, False)
        if files.exists(place):
            return False
        raise error
    return True


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file; empty if it is not there."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return ""
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
