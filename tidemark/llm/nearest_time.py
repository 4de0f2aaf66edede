"""Nearest record in time of the same entity, within a tolerance, for entities of any size.

Both sides become one set of (entity, time) events that is range-partitioned over entity and time together, so an entity with a
third of all rows is spread over many tasks. Each partition is sorted and scanned on its own in both directions. What a scan
cannot see is the right record just outside its partition: each partition gives the first and last right record of its
entities, and a blocked parallel prefix scan over these edge records (first inside blocks of partitions, then over the blocks)
gives every partition what its neighbours hold. Only entities that cross a border take part, at most two a partition, so that
table is bounded by the number of partitions, not by the data.

Defined results: rows with a null entity or time match nothing (left ones give no row, right ones are ignored); a distance equal
to the tolerance counts; ties go to the earlier record, then to the smaller id; right records of one entity and instant count as
the one with the smallest id; repeated left rows give a row each; empty sides give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import kept_in_order

#: Rows of a range partition, about; a task holds one.
PARTITION_ROWS = 2_000_000

_EVENTS = "entity string, t bigint, left_id bigint, right_id bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition: for each left row the nearest right rows of its entity on both sides, as far as seen here."""
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    n = table.num_rows
    codes = pc.dictionary_encode(table["entity"]).combine_chunks()
    codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    t = table["t"].to_numpy()
    right = pc.is_valid(table["right_id"]).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(table["right_id"], 0).to_numpy()
    at = np.arange(n)
    starts = np.r_[True, codes[1:] != codes[:-1]]
    first = np.maximum.accumulate(np.where(starts, at, 0))
    ends = np.r_[codes[1:] != codes[:-1], True]
    last = np.minimum.accumulate(np.where(ends, at, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(right, at, -1))
    after = np.minimum.accumulate(np.where(right, at, n)[::-1])[::-1]
    rows = np.flatnonzero(~right)
    before, after = before[rows], after[rows]
    no_before, no_after = before < first[rows], after > last[rows]
    before, after = np.where(no_before, 0, before), np.where(no_after, 0, after)
    taken = table.take(pa.array(rows))
    yield from pa.table({
        "entity": taken["entity"], "pid": taken["pid"], "t": taken["t"], "left_id": taken["left_id"],
        "before_t": pa.array(t[before], mask=no_before), "before_id": pa.array(ids[before], mask=no_before),
        "after_t": pa.array(t[after], mask=no_after), "after_id": pa.array(ids[after], mask=no_after),
    }).combine_chunks().to_batches(max_chunksize=20_000)


def _edges(events: DataFrame, block: int) -> DataFrame:
    """(pid, entity) -> the last right record before the partition and the first one after it, for entities that cross a border."""
    rec = F.struct("t", "right_id")
    own = events.groupBy("pid", "entity").agg(
        F.max(F.when(F.col("right_id").isNotNull(), rec)).alias("last"), F.min(F.when(F.col("right_id").isNotNull(), rec)).alias("first")
    )
    own = own.withColumn("n", F.count("*").over(Window.partitionBy("entity"))).where("n > 1").withColumn("block", F.floor(F.col("pid") / block))
    inside = Window.partitionBy("entity", "block").orderBy("pid")
    back = Window.partitionBy("entity", "block").orderBy(F.desc("pid"))
    own = own.withColumn("in_before", F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    own = own.withColumn("in_after", F.min("first").over(back.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = own.groupBy("entity", "block").agg(F.max("last").alias("last"), F.min("first").alias("first"))
    over = Window.partitionBy("entity").orderBy("block")
    over_back = Window.partitionBy("entity").orderBy(F.desc("block"))
    blocks = blocks.select(
        "entity", "block",
        F.max("last").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("out_before"),
        F.min("first").over(over_back.rowsBetween(Window.unboundedPreceding, -1)).alias("out_after"),
    )
    return own.join(blocks, ["entity", "block"]).select(
        F.col("pid").alias("e_pid"), F.col("entity").alias("e_entity"), F.coalesce("in_before", "out_before").alias("e_before"), F.coalesce("in_after", "out_after").alias("e_after")
    )


def nearest(left: DataFrame, right: DataFrame, tolerance_us: int, partitions: int | None = None) -> DataFrame:
    """``left`` and ``right`` are (entity string, t bigint in microseconds, id bigint). Gives (left_id, right_id, distance_us)."""
    spark = left.sparkSession
    known = lambda df: df.where("entity is not null and t is not null and id is not null")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(known(left).count() + known(right).count()) // PARTITION_ROWS))
    r = known(right).groupBy("entity", "t").agg(F.min("id").alias("right_id")).select("entity", "t", F.lit(None).cast("bigint").alias("left_id"), "right_id")
    events = known(left).select("entity", "t", F.col("id").alias("left_id"), F.lit(None).cast("bigint").alias("right_id")).unionByName(r)
    # the ids take part in the range, so that rows of one entity and instant can be split as well
    ranged = events.repartitionByRange(n, "entity", "t", "left_id", "right_id").sortWithinPartitions("entity", "t", "left_id", "right_id")
    kept = kept_in_order(ranged).withColumn("pid", F.spark_partition_id())
    local = kept.mapInArrow(_scan, "entity string, pid int, t bigint, left_id bigint, before_t bigint, before_id bigint, after_t bigint, after_id bigint")
    edges = F.broadcast(_edges(kept, max(2, int(n**0.5))))  # at most two rows a partition
    x = local.join(edges, (F.col("pid") == F.col("e_pid")) & (F.col("entity") == F.col("e_entity")), "left")
    x = x.select(
        "left_id", "t",
        F.coalesce("before_t", "e_before.t").alias("b_t"), F.coalesce("before_id", "e_before.right_id").alias("b_id"),
        F.coalesce("after_t", "e_after.t").alias("a_t"), F.coalesce("after_id", "e_after.right_id").alias("a_id"),
    )
    behind, ahead = F.col("t") - F.col("b_t"), F.col("a_t") - F.col("t")
    back = behind.isNotNull() & (ahead.isNull() | (behind <= ahead))
    x = x.select("left_id", F.when(back, F.col("b_id")).otherwise(F.col("a_id")).alias("right_id"), F.when(back, behind).otherwise(ahead).alias("distance_us"))
    return x.where(F.col("distance_us") <= tolerance_us)
