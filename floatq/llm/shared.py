"""Tables in the shared folder of the cluster, and ASCII lower-casing.

Lineage is cut by writing Parquet into the folder named by ``spark.checkpoint.dir``, which every
executor and the driver can reach, so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Most ids that are broadcast to pick rows: about 24 MB as a hashed relation of 64-bit keys.
MAX_BROADCAST_IDS = 1_000_000
#: Bytes of files for which a task is worth its while.
PARTITION_BYTES, MOST_TASKS = 4 << 20, 1 << 30
#: Rows of a key from which it is kept out of a shuffle.
MIN_HOT = 4096
#: Only used on a local master when the session names no folder.
LOCAL_DIR = "/tmp/checkpoints/floatq-local"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a session on a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "") or ""
    if master.startswith("local") and not master.startswith("local-cluster"):
        return LOCAL_DIR
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


class Scratch:
    """Written tables of one operator call.

    The folder goes when the JVM ends; a table no longer needed can go earlier with ``drop``.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/floatq-{label}-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))
        self._n = 0

    def save(self, df: DataFrame, name: str, rows: int | None = None, per_task: int = 100_000) -> DataFrame:
        """Write ``df`` once and read it back. Where a bound of the ``rows`` that its last stage reads is known, no more tasks write than these need."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // per_task)))
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._floatq_path = path
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now, not when the driver happens to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._fs.delete(self._path(table._floatq_path), True)


def pick(rows: DataFrame, wanted: DataFrame, key: str | list[str], how: str = "inner", most: int = MAX_BROADCAST_IDS) -> DataFrame:
    """``rows`` joined with the written table ``wanted``, which is broadcast up to ``most`` rows, else shuffled."""
    small = wanted.limit(most + 1).count() <= most
    return rows.join(F.broadcast(wanted) if small else wanted, key, how)


def pick_hot(rows: DataFrame, wanted: DataFrame, key: str, scratch: Scratch, most: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Inner join with the written table ``wanted``, whose column ``n`` counts the rows of each key.

    Up to ``most`` keys are broadcast. Beyond, only keys of MIN_HOT rows are, whose number is bounded by the rows over MIN_HOT,
    if that bound holds too; the others are shuffled, so no key brings many rows to a task.
    """
    if wanted.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(wanted), key)
    hot = wanted.where(F.col("n") >= MIN_HOT)
    if hot.limit(most + 1).count() > most:
        return rows.join(wanted, key)
    hot = scratch.save(hot, "hot")
    passed = rows.join(F.broadcast(hot), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(wanted.where(F.col("n") < MIN_HOT), key)
    return passed.unionByName(cold)


def gathered(df: DataFrame) -> DataFrame:
    """A scan of very many small files in fewer tasks: each reads PARTITION_BYTES at least, or a half of what a core gets.

    What a task costs beside its rows (a Python worker, a file in the shared folder) is so paid once for many files; a table of larger files
    is left as it is.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
    return df.coalesce(tasks) if tasks < MOST_TASKS else df  # an unknown size is taken as huge


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added until none is among the columns, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name in SQL."""
    return "`" + name.replace("`", "``") + "`"


def row_key(id_col: str, text_col: str) -> Column:
    """A 128-bit name of a row's id and text, to tell rows apart without assuming that ids are unique or set."""
    both = F.col(quoted(id_col)), F.col(quoted(text_col))
    return F.struct(F.xxhash64(*both).alias("a"), F.xxhash64(F.lit(1), *both).alias("b"))


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is several times faster than ``translate`` and agrees with it on pure ASCII, which is
    recognised by its byte count.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )
