"""Where intermediate tables live: the shared folder the cluster names in spark.checkpoint.dir.

Scratch (frames that are read more than once) and results (tables a caller publishes) have folders
of their own, so scratch can be dropped without touching a published table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_watchers: list[list[str]] = []
_at_exit: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session.

    Where the setting is missing, a local master sets a folder inside its warehouse, which all of
    its tasks reach; any other master has to name one.
    """
    configured = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder all executors can reach")
    own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    spark.conf.set(_SETTING, own)
    return own


def application_folder(spark: SparkSession) -> str:
    """The folder of this application below the shared root; it goes when the application ends."""
    folder = f"{shared_root(spark)}/journeyloom-{spark.sparkContext.applicationId}"
    if folder not in _at_exit:
        _at_exit.add(folder)
        path, system = _located(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
    return folder


def scratch_folder(spark: SparkSession) -> str:
    return f"{application_folder(spark)}/scratch"


def results_folder(spark: SparkSession) -> str:
    """For tables published by queries; dropping scratch leaves them alone."""
    return f"{application_folder(spark)}/results"


def settle(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a frame once to the shared folder and go on from the written table.

    Later stages read it as often as they like, column by column, with real size statistics, and
    a lost executor costs a re-read instead of the whole lineage.  ``codec`` compresses this frame otherwise
    than the session does.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path, compression=codec)
    for seen in _watchers:
        seen.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def watched_frames() -> Iterator[list[str]]:
    """The paths of all frames settled inside the block, for ``drop_frames`` later on."""
    seen: list[str] = []
    _watchers.append(seen)
    try:
        yield seen
    finally:
        _watchers[:] = [w for w in _watchers if w is not seen]


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside the block the shuffle files of a query go when it ends.

    Otherwise they stay until the driver happens to collect the garbage of the frames behind them, so a chain
    of writes holds the shuffles of all its steps on disk.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def drop_frames(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete settled frames whose results have been written elsewhere."""
    for name in paths:
        path, system = _located(spark, name)
        system.delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every frame this application has settled; published results stay."""
    drop_frames(spark, [scratch_folder(spark)])


def _located(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_small_file(spark: SparkSession, name: str) -> str | None:
    """Text of a small file, None where it is missing."""
    path, system = _located(spark, name)
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_small_file(spark: SparkSession, name: str, text: str) -> None:
    """Write a file beside its place and rename it over the old one, which readers see until then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path, system = _located(spark, name)
    path = system.makeQualified(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path.toString()}.{uuid.uuid4().hex}")
    stream = system.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(beside, path, options)


def list_folder(spark: SparkSession, name: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    path, system = _located(spark, name)
    return [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []
