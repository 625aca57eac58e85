"""Commit resolution over a stream of progress reports.

Durable offsets merge by their maximum, so the state of the stream is one row for each lane, whatever the order or
repetition of reports; the resolution is then the batch one over that state. (Failures do not commute, and are
resolved in batch by sequence number.)
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import quorum


def lane_state(progress_stream: DataFrame) -> DataFrame:
    """Streaming: seg, zone, durable. For output mode complete or update."""
    return progress_stream.groupBy("seg", "zone").agg(F.max("durable").alias("durable"))


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="logloom-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def resolve(spark: SparkSession, progress: DataFrame, ends: DataFrame, lanes: DataFrame, q: int) -> DataFrame:
    """Feed recorded progress through the stream, all that is there, and resolve what it leaves."""
    root = _folder(spark)
    progress.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(progress.schema).parquet(f"{root}/in")
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{root}/state")
    lane_state(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    state = spark.read.schema("seg long, zone int, durable long").parquet(f"{root}/state")
    full = lanes.join(state, ["seg", "zone"], "left").select("seg", "zone", F.coalesce("durable", F.lit(0)).alias("durable"))
    return quorum.commit_resolution(ends, full, q)
