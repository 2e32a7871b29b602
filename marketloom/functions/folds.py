"""Folds over rows in order, with a little state a key, in memory of one Arrow batch; and results that are computed once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(rows: DataFrame, key: str, order: list[str], schema: str | StructType, start: Callable) -> DataFrame:
    """Rows of each key, in order, through an object that start(key) makes.

    The object has step(frame) and end(), which give lists of tuples of the schema, or iterators over such lists. A key's rows come in one
    or more frames, so what the object keeps between them is all that is held of a key; keys are spread by hash.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(out) -> Iterator[pa.RecordBatch]:
            for some in [out] if isinstance(out, list) else out:
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), fields)], schema=fields)

        state, held = None, None
        for batch in batches:
            frame = batch.to_pandas()
            keys = frame[key].to_numpy(object)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if state is None or keys[a] != held:
                    if state is not None:
                        yield from given(state.end())
                    held, state = keys[a], start(keys[a])
                yield from given(state.step(frame.iloc[a:b]))
        if state is not None:
            yield from given(state.end())

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, so that few bytes are not taken for little work
    return rows.repartition(parts, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def once(df: DataFrame, name: str = "once") -> DataFrame:
    """df, computed and written as Parquet below spark.checkpoint.dir. Where that is unset, in a temporary folder if all run on this machine, else an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    path = f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # Spark drops the shuffles of tables that are gone when their plans are collected
    return spark.read.schema(df.schema).parquet(path)
