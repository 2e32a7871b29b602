"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: the space and the control characters from tab to carriage return.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-cases A to Z and leaves every other character as it is."""
    return F.translate(col, UPPER, LOWER)


class Aside:
    """A table's columns under names of their own, so that none clashes with an operator's, and the way back.

    `df` has them as user_0, user_1, ...; `add` names those that the operator puts in place of columns so named.
    """

    def __init__(self, docs: DataFrame, add: list[str] | tuple = ()):
        added = {c.lower() for c in add}
        self.names = [c for c in docs.columns if c.lower() not in added]
        self.all = docs.columns
        self.df = docs.select(*[F.col(_quoted(c)).alias(f"user_{i}") for i, c in enumerate(docs.columns)])

    def col(self, name: str):
        """The column of that name, of whatever case; null where there is none."""
        found = [i for i, c in enumerate(self.all) if c.lower() == name.lower()]
        return F.col(f"user_{found[0]}") if found else F.lit(None).cast("string")

    def kept(self) -> list[str]:
        return [f"user_{i}" for i, c in enumerate(self.all) if c in self.names]

    def back(self, df: DataFrame, *added) -> DataFrame:
        return df.select(*[F.col(f"user_{i}").alias(c) for i, c in enumerate(self.all) if c in self.names], *added)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share. Where none is set, a temporary one if all run on this machine, else an error."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without its lineage."""
    shared_path(df.sparkSession, "")
    out = df.checkpoint(eager=True)
    settle(df.sparkSession)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), in a Parquet table: smaller, and read by columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    settle(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, **exprs) -> DataFrame:
    """Adds columns that are computed once a row, however often later expressions use them.

    Spark inlines projected columns into the expressions that follow; it doesn't inline what a generator puts out.
    """
    one = F.array(F.struct(*[e.alias(k) for k, e in exprs.items()]))
    return df.select("*", F.inline(one))


def maybe_in(asked: DataFrame, on: list[str], most_bits: int = 27) -> Column:
    """Whether a row's `on` may stand in asked, by a bitmap of eight bits a row of it, at most 2**most_bits. A row that does stand there always may."""
    size = 1 << min(most_bits, max(16, (8 * asked.count()).bit_length()))
    cell = F.pmod(F.xxhash64(*on), F.lit(size))
    ids = asked.select((cell + 1).alias("c"))
    parts = ids.groupBy(F.bitmap_bucket_number("c").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits")).collect()
    bitmap = np.zeros(max(size, 1 << 15) // 8, np.uint8)
    for r in parts:
        bitmap[(r["part"] - 1) << 12 : r["part"] << 12] = np.frombuffer(r["bits"], np.uint8)
    shared = asked.sparkSession.sparkContext.broadcast(bitmap)
    del parts, bitmap
    release()

    def within(cells: pa.Array) -> pa.Array:
        c = cells.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((shared.value[c >> 3] >> (c & 7) & 1).astype(bool))

    return F.arrow_udf(within, "boolean")(cell)


def settle(spark: SparkSession) -> None:
    """Collects the driver's garbage, so that its heap shrinks to what it holds and Spark drops shuffles, broadcasts and checkpoints of tables gone.

    Each stage leaves plans and statuses behind. Left to itself the JVM widens its heap up to the limit before it collects them all.
    """
    gc.collect()  # plans stay as long as Python refers to them
    spark.sparkContext._jvm.System.gc()
    release()


def release() -> None:
    """Gives memory that Python, numpy and Arrow have freed back to the system; workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(f):
    """f, a function over a task's batches or over one array, with release() after it."""
    import inspect

    if inspect.isgeneratorfunction(f):

        def run(batches):
            yield from f(batches)
            release()

        return run

    def once(*args):
        try:
            return f(*args)
        finally:
            release()

    return once
