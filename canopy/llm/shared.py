"""What several operators need: column picking, tables in the shared folder, distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="canopy-")
        spark.conf.set("spark.checkpoint.dir", base)
        _WRITTEN.append((spark, base))
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/canopy-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            delete_path(spark, path)
        except Exception:  # the session may have ended already
            return


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    trim_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._canopy_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    spark = tables[0].sparkSession
    for path in {t._canopy_path for t in tables}:
        delete_path(spark, path)
        _WRITTEN.remove((spark, path))


def written(spark: SparkSession) -> set[str]:
    """Paths of all tables that are there still."""
    return {path for session, path in _WRITTEN if session is spark}


def drop_unread(docs: DataFrame, paths: set[str]) -> set[str]:
    """Delete those of ``paths`` that ``docs`` does not read; the others come back."""
    spark = docs.sparkSession
    files = [f.removeprefix("file:").lstrip("/") for f in docs.inputFiles()] if paths else []
    read = {p for p in paths if any(f.startswith(p.removeprefix("file:").lstrip("/") + "/") for f in files)}
    for path in paths - read:
        if (spark, path) in _WRITTEN:
            delete_path(spark, path)
            _WRITTEN.remove((spark, path))
    return read


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of steps whose results are written: its cleaner acts when the driver collects garbage."""
    for _ in range(2):  # the first round frees what this process holds in the JVM, the second what that held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> None:
    """Give back what the driver's JVM holds but does not use: a heap beyond half its bound, and free native memory.

    The C library keeps what compilers, codecs and network buffers freed in pools of many threads. Nothing is given back
    by JVMs that have no command for it.
    """
    context = spark.sparkContext
    jvm, gateway = context._jvm, context._gateway
    lang = jvm.java.lang
    heap = lang.Runtime.getRuntime()
    if heap.totalMemory() * 2 > heap.maxMemory():
        jvm.System.gc()

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    of = lang.Class.forName
    with contextlib.suppress(Py4JError):
        # by reflection, as the server's own class is not open to other modules
        kinds = array(lang.Class, of("javax.management.ObjectName"), of("java.lang.String"), of("[Ljava.lang.Object;"), of("[Ljava.lang.String;"))
        invoke = of("javax.management.MBeanServer").getMethod("invoke", kinds)
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array(lang.Object, commands, "systemTrimNativeHeap", None, None))


def trim_memory() -> None:
    """In a Python worker, at the end of a task: give free memory back, which idle workers would hold else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """At most 256 rows go to a Python worker at once: whole texts in the default of ten thousand take much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 256:
        spark.conf.set(name, "256")


def as_id(column: Column) -> Column:
    """Ids as integers; what is none counts as null."""
    return column.try_cast("long")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """``pick(df, id="doc_id")``: columns by exact name (the first of equal names) under new names.

    Works by position, so further columns whose names clash, also in case only, do no harm.
    """
    names = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"c{names.index(src)}").alias(out) for out, src in cols.items()])


def with_row_id(df: DataFrame, row_id: str) -> DataFrame:
    return df.withColumn(row_id, F.monotonically_increasing_id())


def global_rank(df: DataFrame, by: list[str], rank: str, label: str) -> DataFrame:
    """Rows of ``df`` plus their 0-based place in the order of ``by``, without a single-task sort.

    Rows go to range partitions, are numbered within each and shifted by the sizes of the partitions before;
    only one row for each partition meets in one task. The ranged table is written once so that the
    numbers hold when a task is run again.
    """
    placed = (
        df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in by])
        .sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in by])
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = materialize(placed, label)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()  # a row a partition
    starts, total = [], 0
    for row in sizes:
        starts.append((row["__part"], total))
        total += row["n"]
    begin = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    out = placed.join(F.broadcast(begin), "__part").withColumn(rank, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")
    out._canopy_path = placed._canopy_path
    return out


#: A key with at least one in so many of all rows is hot; so there are no more hot keys than that.
HOT = 1000


def join_counted(rows: DataFrame, keys: DataFrame, on: dict[str, str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, one row a key, whose column ``n`` counts the key's rows among ``total``.

    ``on``: columns of rows and of keys that are equal. The few hot keys are broadcast, so that their rows stay where
    they are; all others meet by sort-merge, at any size of the tables.
    """
    hot = F.col(n) * HOT >= total
    some, rest = keys.where(hot), keys.where(~hot)
    cond = [F.col(a) == F.col(b) for a, b in on.items()]
    few = F.broadcast(some)
    far = rows.join(F.broadcast(some.select(*on.values())), cond, "left_anti")
    return rows.join(few, cond).unionByName(far.hint("merge").join(rest, cond))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; null: empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
