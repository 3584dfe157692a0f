"""What the operators share: the folder every executor sees, written tables, ranks and prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..batches import small_batches  # noqa: F401

#: Sides of a join with at most this many rows of a few fixed-width columns may be broadcast.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; in its absence, in one process with the driver (tests), a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lw-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The paths that new_path gave, in order.
PATHS: list[str] = []


def _store(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not used yet; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/lw-{name}-{uuid.uuid4().hex}"
    there, store = _store(spark, path)
    store.deleteOnExit(there)
    PATHS.append(path)
    return path


def remove(spark: SparkSession, paths: list[str], unless_read_by: DataFrame) -> list[str]:
    """Delete tables that nothing needs any more; those that the plan of a frame still reads are kept and returned."""
    files = unless_read_by.inputFiles()
    kept = []
    for path in paths:
        if any(path.rsplit("/", 1)[-1] in f for f in files):
            kept.append(path)
        else:
            there, store = _store(spark, path)
            store.delete(there, True)
    return kept


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if a count shows that ``df`` has at most ``rows`` rows, else ``df`` as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: What Python code of this package holds between tasks of a worker, by its owner: how to let go of it.
HELD: dict[str, Callable[[], None]] = {}
_owner: list[str] = []


#: Seconds after which a worker without a task lets go of what an operator holds.
IDLE = 0.7
_waiting: list[threading.Timer] = []


def _shrink() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library can, freed pages go back to the system
        ctypes.CDLL(None).malloc_trim(0)


def lets_go(owner: str) -> None:
    """To be called where a task of an operator ends, if what it holds is large: it goes unless a task follows at once."""

    def release() -> None:
        HELD[owner]()
        _owner.clear()
        _shrink()

    _waiting.append(threading.Timer(IDLE, release))
    _waiting[-1].daemon = True
    _waiting[-1].start()


def takes_over(owner: str) -> None:
    """To be called by Python code on a worker: lets go of what other operators' code left there, as workers outlive stages."""
    while _waiting:
        _waiting.pop().cancel()
    if _owner == [owner]:
        return
    _owner[:] = [owner]
    for name, let_go in HELD.items():
        if name != owner:
            let_go()
    _shrink()


def lists(x: pa.Array) -> list[np.ndarray]:
    """The items of a column of lists, without copies."""
    values, at = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(at, at[1:], strict=False)]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, key: str | None, uid: str, name: str, value: str | None = None, per: int = 1024) -> DataFrame:
    """Add ``name``: the sum of ``value`` (null: a count) over the rows of the same ``key`` (null: all rows) that come before a row.

    Rows of a key are dealt into hash blocks of the unique ``uid``, the blocks get offsets from their
    sums, and only rows of one block are ordered together, so a hot key is never in one task. ``df`` must
    be a written table, of which ``uid`` is part, and ``key`` an integer of few values.
    """
    step, keys = F.lit(1) if value is None else F.col(value), [key] if key else []
    if key:
        counted, n = df.join(small(df.groupBy(key).agg(F.count("*").alias("_n"))), key), F.col("_n")
    else:
        counted, n = df, F.lit(df.count())
    blocks = F.greatest(F.lit(1), F.ceil(n / per)).cast("long")
    keyed = counted.withColumn("_b", F.pmod(F.xxhash64(F.lit(11), F.col(uid)), blocks)).drop("_n")
    sums = keyed.groupBy(*keys, "_b").agg(F.sum(step).alias("_c")).withColumn("_g", F.floor(F.col("_b") / 1024))
    # the blocks of a key are summed up in two steps, so no window has many rows
    outer = sums.groupBy(*keys, "_g").agg(F.sum("_c").alias("_s"))
    outer = outer.withColumn("_o", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_g")) - F.col("_s"))
    inner = sums.withColumn("_i", F.sum("_c").over(Window.partitionBy(*keys, "_g").orderBy("_b")) - F.col("_c"))
    offsets = small(inner.join(outer.select(*keys, "_g", "_o"), [*keys, "_g"]).select(*keys, "_b", (F.col("_i") + F.col("_o")).alias("_at")))
    before = F.sum(step).over(Window.partitionBy(*keys, "_b").orderBy(uid).rowsBetween(Window.unboundedPreceding, 0)) - step
    return keyed.withColumn("_w", before).join(offsets, [*keys, "_b"]).withColumn(name, (F.col("_at") + F.col("_w")).cast("long")).drop("_b", "_at", "_w")
