"""Streams: windows with late data, deduplication, incremental folding."""

from __future__ import annotations

import functools

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessella.operators.similar import SOURCES


def event_time(df: DataFrame, column: str) -> DataFrame:
    """A time without zone as a timestamp, as watermarks need it."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def file_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """A stream of the files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def tumbling(df: DataFrame, time: str, width: str, keys: Sequence[str], aggregates: Sequence[Column], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates per window and keys, of a stream or a table; ``slide`` makes the windows overlap. Columns ``start`` and ``end``."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    df = df.withWatermark(time, late) if df.isStreaming else df
    out = df.groupBy(w.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column], late: str = "10 minutes") -> DataFrame:
    """Aggregates per session: events of a key less than ``gap`` apart."""
    df = df.withWatermark(time, late) if df.isStreaming else df
    out = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def once(df: DataFrame, keys: Sequence[str], time: str, late: str = "7 days") -> DataFrame:
    """Each key once, within the watermark of a stream."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def since(df: DataFrame, column: str, mark: object | None) -> DataFrame:
    """Rows at or after a high-water mark; all without one."""
    return df if mark is None else df.where(F.col(column) >= F.lit(mark))


def high_water(df: DataFrame, column: str) -> object | None:
    """The greatest value of a column, the next run's mark."""
    return df.agg(F.max(column)).first()[0]


# ------------------------------------------------------------------ incremental folding

_WEEK = 7 * 24 * 3600 * 1000
CLUSTER_SCHEMA = "esid string, publish_date bigint, cluster string, is_head boolean"
_STATE_SCHEMA = "ids array<string>, dates array<bigint>, ranks array<string>, clusters array<string>"


def _fold_group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's news against those of the week before: the cluster of the first match, or a new one; the head is the one of the least rank so far.

    A better head that comes later withdraws the one before: that one's row comes out again, without headship.
    """
    if state.hasTimedOut:
        state.remove()
        return
    ids, dates, ranks, clusters = (list(x) for x in state.get) if state.exists else ([], [], [], [])
    seen, out = set(ids), []
    for batch in batches:
        for row in batch.sort_values(["publish_date", "esid"]).itertuples():
            if row.esid in seen:
                continue
            near = [i for i, d in enumerate(dates) if abs(d - row.publish_date) < _WEEK]
            cluster = clusters[near[0]] if near else row.esid
            before = min(((r, x, d) for r, x, c, d in zip(ranks, ids, clusters, dates) if c == cluster), default=None)
            ids.append(row.esid)
            dates.append(int(row.publish_date))
            ranks.append(row.rank)
            clusters.append(cluster)
            seen.add(row.esid)
            leads = before is None or (row.rank, row.esid) < before[:2]
            out.append((row.esid, int(row.publish_date), cluster, leads))
            if leads and before is not None:
                out.append((before[1], before[2], cluster, False))
    # What is two weeks older than the newest can't match again: state stays bounded by a key's fortnight.
    newest = max(dates, default=0)
    kept = [i for i, d in enumerate(dates) if newest - d < 2 * _WEEK]
    state.update(([ids[i] for i in kept], [dates[i] for i in kept], [ranks[i] for i in kept], [clusters[i] for i in kept]))
    state.setTimeoutTimestamp(max(newest + 2 * _WEEK, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["esid", "publish_date", "cluster", "is_head"])


def rank_text(sources: Sequence[str] = SOURCES) -> Column:
    """The order of heads as one string that sorts the same way."""
    lookup = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s), F.lit(i))])
    return F.concat_ws(":", F.when(F.col("is_publish") == "1", "0").otherwise("1"), F.coalesce("is_new", F.lit("1")), F.lpad(F.coalesce(F.try_element_at(lookup, F.col("resource")), F.lit(99)).cast("string"), 2, "0"), F.lpad(F.col("publish_date").cast("string"), 15, "0"), F.col("esid"))


def fold_stream(news: DataFrame, keys: Sequence[str] = ("company", "round", "amount"), late: str = "7 days") -> DataFrame:
    """``(esid, publish_date, cluster, is_head)`` of a stream of news (columns of the folding record): state per key, a week's window, late data up to ``late``.

    Rows are changes: of several of one esid the last counts, as a head that a
    later one outranks comes out again with ``is_head`` false. News that lack
    one of the keys, null or empty, are clusters of their own.
    """
    timed = news.where(F.col("publish_date").isNotNull() & F.col("esid").isNotNull()).withColumn("time", F.timestamp_millis("publish_date")).withColumn("rank", rank_text()).withWatermark("time", late)
    known = functools.reduce(lambda a, b: a & b, [F.coalesce(F.col(k) != "", F.lit(False)) for k in keys])
    group = F.when(known, F.concat_ws("\u0001", *keys)).otherwise(F.concat(F.lit("\u0002"), F.col("esid")))
    return timed.withColumn("key", group).select("key", "esid", "publish_date", "rank", "time").groupBy("key").applyInPandasWithState(_fold_group, CLUSTER_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def each_micro_batch(stream: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Runs a function over every micro-batch; a batch that fails runs again under its number."""
    writer = stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def slices(df: DataFrame, key: str, count: int, run: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """A long job in slices of the key's hash, each kept under its number and skipped when done: it can be taken up again after a failure."""
    from tessella.sources.tables import pulled

    parts = [pulled(df.sparkSession, f"{path}/slice={i}", lambda i=i: run(df.where(F.pmod(F.xxhash64(key), F.lit(count)) == i))) for i in range(count)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def event_log(requests: DataFrame, started: str, finished: str) -> DataFrame:
    """``(request_id, event, at, seconds)``: start and finish of each request as events, with the time it took."""
    took = (F.unix_millis(finished) - F.unix_millis(started)) / 1000.0
    return requests.select("request_id", F.explode(F.array(F.struct(F.lit("start").alias("event"), F.col(started).alias("at"), F.lit(None).cast("double").alias("seconds")), F.struct(F.lit("finish").alias("event"), F.col(finished).alias("at"), took.alias("seconds")))).alias("e")).select("request_id", "e.*")
