"""Valid and transaction time: points, overlaps, bitemporal views, state logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(t: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Whether [start, end] holds t; an open end holds everything."""
    return (F.col(start).isNull() | (F.col(start) <= t)) & (F.col(end).isNull() | (F.col(end) >= t))


def overlapping(df: DataFrame, start: Column, end: Column, *, valid_from: str = "valid_from", valid_to: str = "valid_to", retracted: str | None = "tx_retracted_at") -> DataFrame:
    """Rows whose validity meets [start, end] and that aren't retracted."""
    out = df.where((F.col(valid_to).isNull() | (F.col(valid_to) >= start)) & (F.col(valid_from).isNull() | (F.col(valid_from) <= end)))
    return out if retracted is None else out.where(F.col(retracted).isNull())


def as_of(df: DataFrame, tx: Column, valid: Column, *, recorded: str = "tx_recorded_at", retracted: str = "tx_retracted_at") -> DataFrame:
    """The rows that at transaction time tx were believed to hold at valid time."""
    known = (F.col(recorded) <= tx) & (F.col(retracted).isNull() | (F.col(retracted) > tx))
    return df.where(known & valid_at(valid))


def latest_act(acts: DataFrame, key: str, order: Sequence[str | Column], status: str = "status", open_: str = "OPEN") -> DataFrame:
    """Each key's latest act, where it isn't an opening: first the latest, then the filter."""
    w = Window.partitionBy(key).orderBy(*order)
    return acts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").where(F.col(status) != open_)


def invalid_transitions(moves: DataFrame, allowed: Mapping[str, Sequence[str]], source: str = "from_state", target: str = "to_state") -> DataFrame:
    """Moves that no rule allows."""
    rules = moves.sparkSession.createDataFrame([(a, b) for a, bs in allowed.items() for b in bs], f"{source} string, {target} string")
    return moves.join(F.broadcast(rules), [source, target], "left_anti")


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, change (added, removed or changed) between a projection and its rebuild."""
    values = [c for c in new.columns if c not in keys]
    both = old.select(*keys, F.struct(*values).alias("o")).join(new.select(*keys, F.struct(*values).alias("n")), list(keys), "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")


def overlap_days(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Days that two ranges share, ends included; 0 if none."""
    return F.greatest(F.lit(0), F.datediff(F.least(a_end, b_end), F.greatest(a_start, b_start)) + 1)


def reduce_versions(events: DataFrame) -> DataFrame:
    """Versions of documents out of NEW, UPDATE and FORGET events (rid, event_type, content_hash, ts, seq), in order of ts, seq:
    rid, version, content_hash, valid_from, superseded_at.

    A repeated hash changes nothing, NEW on a known document with another hash is an update, UPDATE without a document is a
    new one, FORGET ends the current version.
    """
    order = Window.partitionBy("rid").orderBy("ts", "seq")
    e = events.withColumn("gone", F.col("event_type") == "FORGET")
    e = e.withColumns({"before_hash": F.lag("content_hash").over(order), "before_gone": F.lag("gone").over(order)})
    same = ~F.col("gone") & F.coalesce(~F.col("before_gone"), F.lit(False)) & F.col("content_hash").eqNullSafe(F.col("before_hash"))
    idle = F.col("gone") & F.coalesce(F.col("before_gone"), F.lit(True))
    e = e.where(~same & ~idle).withColumn("next_ts", F.lead("ts").over(order)).where(~F.col("gone"))
    return e.select("rid", F.row_number().over(order).cast("long").alias("version"), "content_hash", F.col("ts").alias("valid_from"), F.col("next_ts").alias("superseded_at"))


def append_log(log: DataFrame, acts: DataFrame, keys: Sequence[str], at: str, order: Sequence[str | Column]) -> DataFrame:
    """The log with the acts that it doesn't hold yet, as columns of the log and appended (whether a row is new).

    An act with the keys of an entry, or of an act before it in order, is left out; one without a target state (the last key) is
    no act; one without a time (at) can't be told from others and is always appended.
    """
    whole = [*keys, at]
    known = acts.where(F.col(keys[-1]).isNotNull())
    timed = known.where(F.col(at).isNotNull())
    first = timed.withColumn("_rn", F.row_number().over(Window.partitionBy(*whole).orderBy(*order))).where("_rn = 1").select(*log.columns)
    held = log.select(*whole).distinct()
    fresh = first.join(held, whole, "left_anti").select(*log.columns).unionByName(known.where(F.col(at).isNull()).select(*log.columns))
    return log.withColumn("appended", F.lit(False)).unionByName(fresh.withColumn("appended", F.lit(True)))


def fixed_window_counts(requests: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Requests a key and window, where a window starts at the first request after the last window's end (anchored).

    A key's requests are read in order as a stream, of which only the open window is held; rows without a key or time count for
    nothing.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    kind = next(f.dataType for f in requests.schema if f.name == key)
    schema = T.StructType([T.StructField(key, kind), T.StructField("window_start", T.TimestampType()), T.StructField("requests", T.LongType())])
    width = np.int64(seconds) * 1_000_000

    def run(batches):  # noqa: ANN001, ANN202
        held, start, n = None, 0, 0
        for pdf in batches:
            at = pdf["_us"].to_numpy()
            edges = np.flatnonzero((pdf[key] != pdf[key].shift()).to_numpy())
            out: list[tuple] = []
            for a, b in zip(edges, [*edges[1:], len(pdf)], strict=True):
                own, i = pdf[key].iloc[a], a
                if held is None or own != held:
                    if n:
                        out.append((held, start, n))
                    held, start, n = own, at[a], 0
                while i < b:
                    to = a + int(np.searchsorted(at[a:b], start + width))
                    n += max(0, to - i)
                    i = max(i, to)
                    if i < b:
                        out.append((held, start, n))
                        start, n = at[i], 0
            yield pd.DataFrame({key: [x[0] for x in out], "window_start": pd.to_datetime([x[1] for x in out], unit="us"), "requests": [x[2] for x in out]})
        if n:
            yield pd.DataFrame({key: [held], "window_start": pd.to_datetime([start], unit="us"), "requests": [n]})

    rows = requests.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")).dropna()
    return rows.repartition(key).sortWithinPartitions(key, "_us").mapInPandas(run, schema)


def trailing_counts(requests: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Each request with the number of its key's requests in the seconds up to it."""
    w = Window.partitionBy(key).orderBy(F.col(ts).cast("long")).rangeBetween(-seconds + 1, 0)
    return requests.withColumn("trailing", F.count(F.lit(1)).over(w))
