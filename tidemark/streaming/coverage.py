"""The daily study on a stream: windowed coverage, session bursts, duplicates and per-user state over ``events``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.session import shared_dir


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream; instants are UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def distinct(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_counts(stream: DataFrame) -> DataFrame:
    """(user_id, n, total) after each batch: a custom state a user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there and give its output as a table in the shared folder, with its checkpoint beside it. Every batch is
    written to a folder of its own, so a batch that is run again replaces its first try. In complete mode the last batch counts; in
    update mode the last row of each of ``keys``."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    kind = StructType([*stream.schema.fields, StructField("__batch", IntegerType())])
    out = spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(f"{folder}/out") if _any(spark, f"{folder}/out") else spark.createDataFrame([], kind)
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("__batch").alias("__batch"))), "__batch")  # one row
    elif mode == "update":
        rest = [c for c in stream.columns if c not in (keys or [])]
        out = out.groupBy(*(keys or [])).agg(F.max_by(F.struct(*rest), "__batch").alias("x")).select(*(keys or []), "x.*")
    return out.drop("__batch")


def _any(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
