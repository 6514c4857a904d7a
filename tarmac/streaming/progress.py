"""The run sampler's JSON lines as a stream: append, latest snapshot, and idle watch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SAMPLE = (
    "t timestamp, phase string, run string, epoch int, total int, mAP50 double, mAP50_95 double, sec_per_epoch double, eta_h double, "
    "export_src string, export_tiles long, export_out string, gpu_util int, gpu_mb int, disk_free_gb int, mem_free_mb int, load double, s3_objects long, s3_mb double"
)


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of samples in a folder of JSON line files; lines that don't parse are dropped."""
    return spark.readStream.schema(SAMPLE).option("mode", "DROPMALFORMED").json(folder).filter("t is not null")


def append_to(stream: DataFrame, folder: str, checkpoint: str):
    """Appends every sample as Parquet and keeps the latest sample of each run as a snapshot."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("append").parquet(f"{folder}/samples")
        cols = [c for c in batch.columns if c != "run"]
        latest = batch.groupBy("run").agg(F.max_by(F.struct(*cols), "t").alias("s")).select("run", "s.*")
        latest.write.mode("overwrite").json(f"{folder}/latest-{epoch % 2}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


IDLE_OUT = T.StructType([T.StructField("run", T.StringType()), T.StructField("t", T.TimestampType()), T.StructField("streak", T.IntegerType()), T.StructField("stop", T.BooleanType())])
IDLE_STATE = T.StructType([T.StructField("streak", T.IntegerType())])


def idle_watch(stream: DataFrame, limit: int, at_most: int = 5) -> DataFrame:
    """run, t, streak, stop: consecutive idle samples of each run, carried over batches."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("t")
        out = []
        for t, util in zip(rows["t"], rows["gpu_util"], strict=True):
            streak = streak + 1 if pd.notna(util) and util <= at_most else 0
            out.append((key[0], t, streak, streak >= limit))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["run", "t", "streak", "stop"])

    return stream.groupBy("run").applyInPandasWithState(update, IDLE_OUT, IDLE_STATE, "append", GroupStateTimeout.NoTimeout)
