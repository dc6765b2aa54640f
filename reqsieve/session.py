"""Sessions and the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


#: Folders that ``shared_dir`` has given out.
_MADE: list[str] = []


def local_session(cores: str = "8", app: str = "reqsieve", **settings: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one named in ``spark.checkpoint.dir``.

    On a cluster that setting names a folder all executors reach. Only a local session
    without it gets a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="reqsieve-")
        spark.conf.set("spark.checkpoint.dir", base)
    _MADE.append(f"{base.rstrip('/')}/reqsieve-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back: Spark knows its size when it plans what uses it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create_new(spark: SparkSession, path: str, text: str = "") -> bool:
    """Write a small file that does not exist yet; False if it does. Of several writers one succeeds."""
    place, system = _file_system(spark, path)
    try:
        out = system.create(place, False)
    except Py4JJavaError as error:
        if system.exists(place):
            return False
        raise OSError(f"cannot write {path}") from error
    out.write(bytearray(text.encode()))
    out.close()
    return True


def remove_shared(spark: SparkSession) -> None:
    """Remove the folders that this process has made by ``shared_dir``. What still reads from them fails afterwards."""
    while _MADE:
        remove(spark, _MADE.pop())


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at a path (or pattern) of any file system that Spark reads?"""
    place, system = _file_system(spark, path)
    return system.exists(place) or bool(system.globStatus(place))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder."""
    place, system = _file_system(spark, path)
    return [status.getPath().getName() for status in system.listStatus(place)]


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that a path or pattern names."""
    place, system = _file_system(spark, pattern)
    return [status.getPath().toString() for status in system.globStatus(place) or [] if status.isDirectory()]


def remove(spark: SparkSession, path: str) -> None:
    place, system = _file_system(spark, path)
    system.delete(place, True)
