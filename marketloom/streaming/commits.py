"""A sink of candles that holds every micro-batch once, and counters of streams by interval."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class CommittedSink:
    """foreachBatch writer in two phases: a batch's rows are written to a folder of their own, then a manifest names it.

    A manifest appears by a rename, whole or not at all, and readers take only what manifests name. So a batch that
    is repeated adds nothing, and one that failed between write and commit is written anew, its first folder never being read.
    Rows whose keys earlier batches hold are left out, as are repeats in the batch: of its own rows the first by all columns stays.
    Only the days that a batch touches are compared. One query writes to a sink.
    """

    def __init__(self, path: str, keys: tuple = ("symbol", "bucket_epoch"), epoch: str = "bucket_epoch"):
        self.path, self.keys, self.epoch = path.rstrip("/"), list(keys), epoch

    def _fs(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), spark._jvm.org.apache.hadoop.fs.Path

    def committed(self, spark: SparkSession) -> dict[int, dict]:
        """What the manifests say, by batch: a line a batch."""
        fs, path = self._fs(spark)
        folder = path(f"{self.path}/commits")
        if not fs.exists(folder):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        if not any(n.endswith(".json") for n in names):
            return {}
        lines = spark.read.text([f"{self.path}/commits/{n}" for n in names if n.endswith(".json")]).collect()
        return {m["batch"]: m for m in map(json.loads, (r[0] for r in lines))}

    def read(self, spark: SparkSession, days: set | None = None) -> DataFrame | None:
        """All committed rows, or those batches' that touch the days; None if there is nothing."""
        found = [m for m in self.committed(spark).values() if m["folder"] and (days is None or days & set(m["days"]))]
        return spark.read.parquet(*[f"{self.path}/{m['folder']}" for m in found]) if found else None

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in self.committed(spark):
            return
        day = F.floor(F.col(self.epoch) / 86_400)
        batch = batch.persist()
        try:
            days = {r[0] for r in batch.select(day).distinct().collect()}  # a batch has few
            rest = [c for c in batch.columns if c not in self.keys]
            rows = batch.groupBy(*self.keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*self.keys, "_r.*").select(batch.columns)
            have = self.read(spark, days)
            rows = rows if have is None else rows.join(have.select(self.keys), self.keys, "left_anti")
            folder = f"data/{batch_id}-{uuid.uuid4().hex}" if days else ""
            if days:
                rows.write.parquet(f"{self.path}/{folder}")
            self.commit(spark, {"batch": batch_id, "folder": folder, "days": sorted(days)})
        finally:
            batch.unpersist()

    def commit(self, spark: SparkSession, manifest: dict) -> None:
        fs, path = self._fs(spark)
        fs.mkdirs(path(f"{self.path}/commits"))
        part = path(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(part, path(f"{self.path}/commits/{manifest['batch']}.json")):
            fs.delete(part, False)


def observed(rows: DataFrame, name: str, **counts) -> DataFrame:
    """Streaming rows whose number, and how many hold each of counts, are reported with every micro-batch under `name`."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()])


class IntervalCounters(StreamingQueryListener):
    """Counters of observed streams: a line a micro-batch that had any, and sums by interval of the batches' start."""

    def __init__(self, name: str):
        self.name, self.batches = name, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        got = event.progress.observedMetrics.get(self.name)
        if got is not None:
            self.batches.append({"run": str(event.progress.runId), "batch": event.progress.batchId, "at": event.progress.timestamp, **got.asDict()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def by_interval(self, spark: SparkSession, seconds: int) -> DataFrame:
        """from_epoch, batches and the sums of all counters of each interval in which a micro-batch began. A line a micro-batch is held."""
        if not self.batches:
            return spark.createDataFrame([], "from_epoch BIGINT, batches BIGINT, rows BIGINT")
        rows = spark.createDataFrame(self.batches)
        names = [c for c in rows.columns if c not in ("run", "batch", "at")]
        at = F.unix_seconds(F.to_timestamp("at"))
        return rows.groupBy((at - F.pmod(at, F.lit(seconds))).alias("from_epoch")).agg(F.count("*").alias("batches"), *[F.sum(c).alias(c) for c in names])
