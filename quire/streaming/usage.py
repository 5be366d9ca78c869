"""Streams: usage, shares, visits and limits, each the twin of a batch operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.limits import bucket_rule


def rocksdb(spark: SparkSession) -> None:
    """Keyed state outside the heap: it may grow with the number of keys."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def usage_by_day(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls, failures and latency per UTC day; rows later than the watermark are dropped."""
    return log.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "feature", "connection", "model").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.sum("ms").alias("total_ms"), F.max("ms").alias("slowest"),
        F.sum(F.coalesce("tokensIn", F.lit(0))).alias("tokens"))


def visits(uses: DataFrame, key: str, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Visits that end when a link has not been opened for the gap."""
    return uses.withWatermark("at", late).groupBy(key, F.session_window("at", gap).alias("w")).agg(
        F.count("*").alias("uses"), F.min("at").alias("first"), F.max("at").alias("last"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what there is, append it to parquet and return the table."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def merge_share_uses(uses: DataFrame, key: str, stored: str, checkpoint: str) -> None:
    """Counts of each micro-batch merged onto the stored counts by a join.

    `stored` is a folder of numbered versions: a batch reads the newest version
    below its own and writes its own, so a batch that is run again gives the same result.
    """
    spark = uses.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        fresh = batch.groupBy(key).agg(F.count("*").alias("n"), F.max("at").alias("last"))
        old = spark.read.parquet(f"{stored}/v={n}")
        new = old.join(fresh, key, "left").select(
            key, (F.col("use_count") + F.coalesce("n", F.lit(0))).alias("use_count"), F.greatest("last", "last_used").alias("last_used"))
        new.write.mode("overwrite").parquet(f"{stored}/v={n + 1}")

    q = uses.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def limited(events: DataFrame, key: str, capacity: int = 20, period: int = 60_000, late: str = "1 minute") -> DataFrame:
    """The token bucket as keyed state, for events (key, at ms, id, cost) that may come `late` and in any order.

    An event waits in its key's state until the watermark has passed it, so a bucket sees
    its events in order across micro-batches; events later than that are dropped. A bucket
    that has had time to fill again leaves the state.
    """
    step, fresh = bucket_rule(capacity, period)

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last, *lists = state.get if state.exists else (fresh.initial[0], -1, [], [], [])
        waiting = list(zip(*lists, strict=True))
        if not state.hasTimedOut:
            for pdf in frames:
                waiting += zip(pdf["at"].tolist(), pdf["id"].tolist(), pdf["cost"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs()
        waiting.sort()
        due = [e for e in waiting if e[0] <= mark]
        waiting = waiting[len(due):]
        bucket = [tokens, None if last == -1 else last]
        said = [not step(bucket, at, "", cost) for at, _, cost in due]
        tokens, last = bucket[0], -1 if bucket[1] is None else bucket[1]
        if not waiting and last + period <= mark:
            state.remove()
        else:
            state.update((int(tokens), int(last), *([int(e[i]) for e in waiting] for i in range(3))))
            state.setTimeoutTimestamp(int(max(mark + 1, waiting[0][0] if waiting else last + period)))
        if due:
            yield pd.DataFrame({key: k[0], "id": [e[1] for e in due], "ok": said})

    timed = events.withColumn("_ts", F.timestamp_millis("at")).withWatermark("_ts", late)
    return timed.groupBy(key).applyInPandasWithState(
        run, f"{key} long, id long, ok boolean", "tokens long, last long, ats array<long>, ids array<long>, costs array<long>", "append", GroupStateTimeout.EventTimeTimeout)
