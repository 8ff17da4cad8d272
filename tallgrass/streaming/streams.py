"""Streaming forms of the batch operators: bins, dedup, runs, filtered states and incremental merging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def tumbling(events: DataFrame, at: str, keys: list[str], width: str, late: str, value: str, start: str | None = None) -> DataFrame:
    """Counts and sums per key and window, closed ``late`` after the latest event: keys, start, n, total."""
    w = F.window(at, width, None, start) if start else F.window(at, width)
    marked = events.withWatermark(at, late)
    return marked.groupBy(w.alias("_w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*keys, F.col("_w.start").alias("start"), "n", "total")


def weekly(events: DataFrame, at: str, keys: list[str], late: str, value: str) -> DataFrame:
    """Tumbling weeks that begin on Monday."""
    return tumbling(events, at, keys, "7 days", late, value, "4 days")


def sliding(events: DataFrame, at: str, keys: list[str], length: str, slide: str, late: str, value: str) -> DataFrame:
    """Trailing means at every ``slide``: the streaming form of a time-based rolling mean."""
    w = F.window(at, length, slide)
    return events.withWatermark(at, late).groupBy(w.alias("_w"), *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(*keys, F.col("_w.end").alias("at"), "mean", "n")


def once(events: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """First arrival of each key; state is dropped after ``late``."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def runs(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each event with the number of its run of equal values in its key; the state is the last value and its run.

    Events of a key are taken in the order of ``order`` within a micro-batch.
    """
    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, {order} {events.schema[order].dataType.simpleString()}, {value} string, run bigint"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        numbers = []
        for v in rows[value]:
            if run == 0 or v != last:
                last, run = v, run + 1
            numbers.append(run)
        state.update((last, run))
        yield pd.DataFrame({key: rows[key], order: rows[order], value: rows[value], "run": numbers})

    return events.groupBy(key).applyInPandasWithState(step, out, "last string, run bigint", "append", GroupStateTimeout.NoTimeout)


def filtered_level(events: DataFrame, key: str, at_us: str, value: str, drift: float, noise: float) -> DataFrame:
    """Level of a random walk filtered causally: an estimate at t uses what came up to t. State: mean, variance, time."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, var, last = state.get if state.exists else (0.0, 1e6, None)
        rows = pd.concat(list(frames)).sort_values(at_us)
        out = []
        for t, y in zip(rows[at_us], rows[value]):
            var += drift * ((t - last) / 86_400e6 if last is not None else 0.0)
            if pd.notna(y):
                gain = var / (var + noise)
                mean, var = mean + gain * (y - mean), (1 - gain) * var
            last = int(t)
            out.append((mean, var))
        state.update((mean, var, last))
        yield pd.DataFrame({key: rows[key], at_us: rows[at_us], "mean": [m for m, _ in out], "var": [v for _, v in out]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at_us} bigint, mean double, var double", "mean double, var double, last bigint", "append", GroupStateTimeout.NoTimeout)


def trailing_mean(events: DataFrame, key: str, at_us: str, value: str, days: int) -> DataFrame:
    """Each event with the mean over its key's last ``days`` days, left-open, ends in the event's own time. The state of a
    key is what such a window holds, no more; events of a key come in order of time, as micro-batches bring them."""
    kind, width = events.schema[key].dataType.simpleString(), days * 86_400_000_000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values(at_us)
        known = rows[rows[value].notna()]
        t = pd.concat([pd.Series(times, dtype="int64"), known[at_us].astype("int64")]).to_numpy()
        v = pd.concat([pd.Series(values, dtype=float), known[value]]).to_numpy(float)
        total = pd.Series(v).cumsum().to_numpy()
        low, high = t.searchsorted(rows[at_us].to_numpy() - width, "right"), t.searchsorted(rows[at_us].to_numpy(), "right")
        part = lambda i: pd.Series([total[j - 1] if j else 0.0 for j in i]).to_numpy()
        n = high - low
        means = [(a - b) / c if c else None for a, b, c in zip(part(high), part(low), n)]
        keep = t > rows[at_us].max() - width
        state.update((t[keep].tolist(), v[keep].tolist()))
        yield pd.DataFrame({key: rows[key], at_us: rows[at_us], "mean": pd.Series(means, index=rows.index, dtype=float)})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at_us} bigint, mean double", "times array<bigint>, values array<double>", "append", GroupStateTimeout.NoTimeout)


def merge_into(path: str, keys: list[str], sums: list[str], parts: list[str]):
    """A ``foreachBatch`` function that adds a micro-batch's mergeable sums to a partitioned table.

    Only the partitions that the batch touches are read and replaced.
    """

    def write(batch: DataFrame, number: int) -> None:
        from pyspark.errors import AnalysisException

        spark = batch.sparkSession
        own = batch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        try:
            old = spark.read.parquet(path).join(own.select(*parts).distinct(), parts, "left_semi")
            own = own.unionByName(old.select(*own.columns)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        except AnalysisException:
            pass
        from tallgrass.staging import settle

        settle(own).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

    return write


def read_files(spark, folder: str, schema: StructType, names: str = "*", files_per_batch: int = 1) -> DataFrame:
    """The parquet files of a folder whose names fit the glob, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(folder)


def until(events: DataFrame, at: str, end) -> DataFrame:
    """Replay as if the data stopped at ``end``."""
    return events.where(F.col(at) <= F.lit(end))


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, through an in-memory sink: for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
