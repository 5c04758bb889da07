"""Cutting lineage and publishing tables.

``settle`` writes a checkpoint to the folder that all executors share, ``kept`` a table of which later steps read the columns
they need. ``publish`` and ``latest`` give a state table
atomic versions: every version is a folder of its own, and one small pointer, renamed into place, names the current one.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_KEPT: list[tuple[SparkSession, str]] = []


def _shared(spark: SparkSession) -> str:
    """The folder of checkpoints, set if there is none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="canopy-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    _shared(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a table in the shared folder that goes when this process ends."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/canopy-kept-{uuid.uuid4().hex}"
    _KEPT.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _KEPT:
        with contextlib.suppress(Exception):  # the session may have ended already
            fs, place = _fs(spark, path)
            fs.delete(place, True)


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def publish(df: DataFrame, table: str) -> str:
    """Write ``df`` as the new version of ``table`` (a folder) and make it the current one."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{version}")
    fs, pointer = _fs(spark, f"{table}/_current")
    _, draft = _fs(spark, f"{table}/_current-{version}")
    out = fs.create(draft, True)
    out.write(bytearray(version.encode()))
    out.hsync()
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, pointer, option)
    return version


def latest(spark: SparkSession, table: str) -> DataFrame:
    version = _read_pointer(spark, table)
    return spark.read.parquet(f"{table}/{version}")


def _read_pointer(spark: SparkSession, table: str) -> str:
    fs, pointer = _fs(spark, f"{table}/_current")
    stream = fs.open(pointer)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
