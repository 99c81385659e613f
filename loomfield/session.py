"""Session helpers: table access, work tables in the shared folder, sizing."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WORK: dict[str, list[str]] = {}
_MADE: dict[tuple, object] = {}


def get_spark(app: str = "loomfield", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects (case-sensitive names, AQE, UTC, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.caseSensitive": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=defaults | conf).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application.

    It matters where the package is on the driver's path only; with --py-files
    or a common PYTHONPATH it changes nothing.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    if root.suffix == ".zip" or not root.is_dir():  # shipped already
        return
    name = Path(tempfile.mkdtemp(prefix="loomfield-package-"), "loomfield.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, by exact name, even where others differ only by case or repeat the name."""
    lower = [c.lower() for c in df.columns]
    if any(lower.count(c.lower()) > 1 for c in columns):
        by_place = df.toDF(*[f"_{i}" for i in range(len(lower))])
        return by_place.select(*[F.col(f"_{df.columns.index(c)}").alias(c) for c in dict.fromkeys(columns)])
    return df.select(*[df[c] for c in dict.fromkeys(columns)])


def once(spark: SparkSession, key: tuple, make: Callable):
    """What make gives, made once per application; for files that several queries read."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _MADE:
        _MADE[full] = make()
    return _MADE[full]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; on a cluster
    that is an error, since a machine-local folder is lost with its machine.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="loomfield-")
    return _FALLBACK[app]


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    The plan behind it is cut, and the rows survive the loss of any executor.
    The table is deleted when the application ends, or before by
    work_tables_released.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _WORK.setdefault(spark.sparkContext.applicationId, []).append(path)
    where, fs = _file_system(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{what}/{uuid.uuid4().hex}"
    where, fs = _file_system(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def release_work_tables(spark: SparkSession, keep: int = 0) -> int:
    """Delete this application's work tables but for the first keep; frames that read them end with it."""
    made = _WORK.get(spark.sparkContext.applicationId, [])
    paths = made[keep:]
    del made[keep:]
    for p in paths:
        where, fs = _file_system(spark, p)
        fs.delete(where, True)
        fs.cancelDeleteOnExit(where)
    return len(paths)


@contextmanager
def work_tables_released(spark: SparkSession) -> Iterator[None]:
    """Work tables made inside are deleted at its end; what is made of them must be written or collected by then."""
    before = len(_WORK.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release_work_tables(spark, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, rows: int, rows_per_part: int) -> int:
    """Partitions so that none holds more than rows_per_part rows on average."""
    return max(1, min(shuffle_partitions(spark), rows), math.ceil(rows / rows_per_part))


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that costs far more than moving its rows.

    Inputs with enough splits, as all large ones have, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def local_path(path: str) -> str:
    """A file: URL or plain path as an operating system path; other schemes are refused, since files are opened by hand here."""
    text = os.fspath(path)
    if "://" in text or text.startswith("file:"):
        url = urlparse(text)
        if url.scheme != "file" or url.netloc not in ("", "localhost"):
            raise ValueError(f"{text}: only local or mounted file systems are read and written here")
        return unquote(url.path)
    return text


def file_url(path: str) -> str:
    """The URL by which Spark reads or writes a local path."""
    return "file://" + os.path.abspath(local_path(path))
