"""Repeated queries within a time to live.

A query is a hit while no more than `ttl` seconds passed since the entry stored for its key;
a hit does not restart the clock; a miss stores a new entry.  On a stream, an event older than the
stored entry came late: it is no hit and leaves the entry as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..session import materialize


def _fold(keys, micros, stored: dict, ttl: int):
    """One pass over (key, time) in order; `stored` holds the last key's entry between batches."""
    hits = [False] * len(keys)
    key, start = stored.get("key"), stored.get("start")
    for i, (k, t) in enumerate(zip(keys, micros, strict=True)):
        if k == key and t - start <= ttl:
            hits[i] = t >= start
        else:
            key, start = k, t
    stored["key"], stored["start"] = key, start
    return hits


def successors(times: DataFrame, key: str, ttl: int) -> DataFrame:
    """(key, t, next): the first later time of the key that is more than `ttl` after t; times(key, t) are distinct, without nulls.

    Times and the points t + ttl are sorted together and cut into blocks by range, so a hot key spreads over blocks; within a
    block one pass from the end knows the time that follows a point, and past its end the head of the next block does.
    """
    ends = times.select(key, "t", F.lit(None).cast("long").alias("origin")).unionByName(times.select(key, (F.col("t") + ttl).alias("t"), F.col("t").alias("origin")))
    blocks = materialize(ends.repartitionByRange(key, "t").withColumn("block", F.spark_partition_id()), "ttl_blocks")
    node = F.when(F.col("origin").isNull(), F.struct(key, "t"))
    heads = blocks.groupBy("block").agg(F.min(node).alias("head"))  # a row per block
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = heads.select("block", F.last("head", ignorenulls=True).over(later).alias("after"))
    back = Window.partitionBy("block").orderBy(F.desc(key), F.desc("t"), F.desc_nulls_last("origin")).rowsBetween(Window.unboundedPreceding, -1)
    found = blocks.withColumn("found", F.last(node, ignorenulls=True).over(back)).filter("origin is not null").join(F.broadcast(after), "block")
    best = F.coalesce("found", "after")
    return found.select(key, F.col("origin").alias("t"), best["t"].alias("next")).filter(best[key] == F.col(key))


def repeat_within_ttl(log: DataFrame, *, key: str = "query_key", at: str = "ts", row: str = "event_id",
                      ttl: int = R.TTL_SECONDS) -> DataFrame:
    """(row, key, repeat) for a batch; a row without a key or a time is no repeat.

    An entry is followed by the first event more than one TTL later, so the stored entries are the chain of
    successors from a key's first event.  Pointer doubling marks it: after n rounds 2^n entries of every key are known.  All
    joins are on (key, time), so no task goes through the events of a key.
    """
    rows = log.select(row, key, F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
    times = materialize(rows.filter(F.col(key).isNotNull() & F.col("t").isNotNull()).groupBy(key, "t").agg(F.min(row).alias("first")), "ttl_times")
    jump = materialize(successors(times.select(key, "t"), key, ttl * 1_000_000), "ttl_jumps")
    marked = materialize(times.groupBy(key).agg(F.min("t").alias("t")), "ttl_marked")
    known, count = 0, marked.count()
    while count > known:
        more = marked.join(jump, [key, "t"]).select(key, F.col("next").alias("t"))
        marked = materialize(marked.unionByName(more), "ttl_marked")  # the chain does not meet itself: no entry comes twice
        jump = materialize(jump.join(jump.select(key, F.col("t").alias("next"), F.col("next").alias("far")), [key, "next"]).select(key, "t", F.col("far").alias("next")), "ttl_jumps")
        known, count = count, marked.count()
    stored = times.join(marked, [key, "t"], "left_semi").select(key, F.col("first").alias(row), F.lit(True).alias("entry"))
    usable = F.col(key).isNotNull() & F.col("t").isNotNull()
    return rows.join(stored, [key, row], "left").select(row, key, (F.col("entry").isNull() & usable).alias("repeat"))


def repeat_stream(log: DataFrame, *, key: str = "query_key", at: str = "ts", row: str = "event_id",
                  ttl: int = R.TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """The same flags on a stream: the stored entry of each key is its state.

    The watermark trails the newest event by `delay`; an entry is dropped once the watermark has passed its time to
    live, so the state holds only keys seen within that time.
    """
    kinds = dict(log.dtypes)
    rows = log.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay).select(row, key, "_at", F.unix_micros("_at").alias("_t"))
    width = ttl * 1_000_000

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["_t", row])
        stored = {"key": group[0], "start": state.get[0]} if state.exists else {}
        hits = _fold([group[0]] * len(pdf), pdf["_t"].tolist(), stored, width)
        start = int(stored["start"])
        state.update((start,))
        state.setTimeoutTimestamp(max((start + width) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({row: pdf[row].to_numpy(), key: group[0], "repeat": hits})

    return rows.groupBy(key).applyInPandasWithState(
        step, f"{row} {kinds[row]}, {key} {kinds[key]}, repeat boolean", "start long", "append", "EventTimeTimeout")
