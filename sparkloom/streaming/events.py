"""Event streams: idempotent ingest, expiry, delivery to consumers, document versions as state, windows.

Each function takes and returns a streaming DataFrame, and works on a batch one too where no state is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from sparkloom.session import shared_folder


def read_events(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all data now available, exactly once, in files of the shared folder."""
    spark, at = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    if mode == "append":
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).format("parquet").start(f"{at}/out")
    else:  # each batch's changes; the last word on a key is in the highest batch

        def put(df: DataFrame, batch: int) -> None:
            df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{at}/out")

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{at}/out")


def with_expiry(events: DataFrame, queued: str = "queued_at", remote: Column | None = None, local_hours: int = 24, remote_hours: int = 72) -> DataFrame:
    """expires_at: a day after queueing, three for remote events."""
    hours = F.when(F.coalesce(remote, F.lit(False)), remote_hours).otherwise(local_hours) if remote is not None else F.lit(local_hours)
    return events.withColumn("expires_at", F.timestamp_micros(F.unix_micros(queued) + hours.cast("long") * 3_600_000_000))


def idempotent(events: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """One event a key, as long as repeats arrive within the delay; state older than that goes."""
    if events.isStreaming:
        return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def deliver(events: DataFrame, subscriptions: DataFrame, now: Column | None = None) -> DataFrame:
    """Events for each consumer (node, rid_types): broadcasts within its types, others to their target, none to the sender;
    expired ones and types that nobody knows are left out. subscriptions is a small static relation, a row a consumer."""
    joined = events.join(F.broadcast(subscriptions), F.coalesce(F.col("target_node") == F.col("node"), F.lit(True)))
    ok = (F.col("node") != F.col("source_node")) & (F.col("target_node").isNotNull() | F.array_contains("rid_types", F.col("rid_type")))
    return joined.where(ok if now is None else ok & (F.col("expires_at") > now))


def exclusions(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Broadcasts outside a consumer's types: marked as delivered, so that they don't hold up its queue."""
    joined = events.where("target_node IS NULL").join(F.broadcast(subscriptions), F.col("node") != F.col("source_node"))
    return joined.where(~F.array_contains("rid_types", F.col("rid_type")))


VERSIONS = "rid string, version long, content_hash string, valid_from timestamp, change string"


def versions(events: DataFrame) -> DataFrame:
    """The changes that NEW, UPDATE and FORGET events (rid, event_type, content_hash, ts) make to documents, by state a document:
    its last version and hash. Events of one batch are applied in order of time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, current = state.get if state.exists else (0, None)
        rows = []
        given = [b for b in batches if len(b)]
        for e in pd.concat(given).sort_values(["ts", "event_type"]).itertuples() if given else ():
            if e.event_type == "FORGET":
                if current is not None:
                    rows.append((key[0], version, current, e.ts, "superseded"))
                current = None
            elif e.content_hash != current:
                if current is not None:
                    rows.append((key[0], version, current, e.ts, "superseded"))
                version, current = version + 1, e.content_hash
                rows.append((key[0], version, current, e.ts, "written"))
        state.update((version, current))
        if rows:
            yield pd.DataFrame(rows, columns=["rid", "version", "content_hash", "valid_from", "change"])

    return events.groupBy("rid").applyInPandasWithState(run, VERSIONS, "version long, current string", "append", GroupStateTimeout.NoTimeout)


def rate_metrics(events: DataFrame, ts: str, value: str, width: str = "1 hour", watermark: str = "1 day") -> DataFrame:
    """Counts, mean and approximate 95th percentile of a value by window; late events within the watermark still count."""
    e = events.withWatermark(ts, watermark) if events.isStreaming else events
    return e.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile_approx(value, 0.95, 10_000).alias("p95")).select(F.col("w.start").alias("window_start"), "n", "mean", "p95")


def coalesced(events: DataFrame, key: str, ts: str, gap: str = "30 seconds", watermark: str = "1 hour") -> DataFrame:
    """Bursts of a key's events as one row each: session windows that close after a gap."""
    e = events.withWatermark(ts, watermark) if events.isStreaming else events
    return e.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def latest_revisions(changes: DataFrame, page: str, revision: str) -> DataFrame:
    """The last revision of each page: what an incremental poll with an overlap keeps."""
    rest = [c for c in changes.columns if c != page]
    return changes.groupBy(page).agg(F.max_by(F.struct(*rest), F.col(revision)).alias("r")).select(page, "r.*")
