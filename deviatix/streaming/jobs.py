"""Structured Streaming: incremental arrival, sliding segments, live deviation, episodes, rates, latest responses.

Each function takes a streaming DataFrame; ``run_available`` drives one over what is there and gives its table, and
``run_updates`` one that sends a key's new row whenever it changes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import new_dir


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a folder whose names match, as a stream, with the schema of the table there."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def sliding_segments(events: DataFrame, key: str, ts: str, value: str, length: str = "15 seconds", step: str = "14 seconds", late: str = "1 minute") -> DataFrame:
    """Overlapping windows per key: n, mean, and window start; rows later than the watermark are dropped."""
    t = F.col(ts).cast("timestamp")
    e = events.withColumn("_ts", t).withWatermark("_ts", late)
    g = e.groupBy(key, F.window("_ts", length, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return g.select(key, F.unix_timestamp("w.start").alias("start"), "n", "mean")


def live_deviation(segments: DataFrame, norms: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Stream-static join with the norms (mu, sigma) of the cell."""
    return segments.join(norms, cell, "left").withColumn("z", (F.col(value) - F.col("mu")) / F.col("sigma"))


def episodes(events: DataFrame, key: str, ts: str, firing, gap: str = "30 minutes", late: str = "1 minute") -> DataFrame:
    """Sessions of firing rows: start, end, n."""
    e = events.where(firing).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = e.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("w.end").alias("end"), "n")


def rates(events: DataFrame, ts: str, width: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """Finished units per tumbling window."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return e.groupBy(F.window("_ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("w.start").alias("start"), "n")


def latest(events: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Last value per key, as an update stream."""
    return events.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def latest_within(events: DataFrame, keys: list[str], ts: str, order: str, value: str, keep: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Last value per key of each window of ``keep``, as an update stream: window start, keys, value, order. A window's
    state is dropped when the watermark has passed it, so what is held doesn't grow with the number of keys ever seen.
    ``run_updates(.., keys, order)`` reads the last one of each key."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = e.groupBy(*keys, F.window("_ts", keep).alias("w")).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))
    return g.select(*keys, F.unix_timestamp("w.start").alias("start"), value, order)


def episode_runs(events: DataFrame, key: str, ts: str, order: str, firing: Column, late: str = "10 minutes") -> DataFrame:
    """Per key, as an update stream: seen (the greatest order), rows, longest (rows of its longest run of firing rows) and
    episodes (runs). A gap in ``order`` ends a run; a null flag doesn't fire.

    Rows wait in the key's state until the watermark has passed their time and then join the runs in order, so it doesn't matter
    in which micro-batch or order they come; what still waits counts provisionally in the row that is sent. Rows later
    than the watermark are dropped. A row whose order is not beyond the last joined one is dropped too. State per key: four
    numbers and the rows of the last ``late``.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    state = "joined long, run long, longest long, episodes long, rows long, at array<long>, place array<long>, fires array<boolean>"

    def walk(joined: int | None, run: int, longest: int, episodes: int, rows: int, waiting: list[tuple[int, int, bool]]) -> tuple:
        for _, place, fires in waiting:
            if joined is not None and place <= joined:
                continue
            goes_on = fires and run > 0 and place == joined + 1
            run = (run + 1 if goes_on else 1) if fires else 0
            episodes, longest, joined, rows = episodes + (fires and not goes_on), max(longest, run), place, rows + 1
        return joined, run, longest, episodes, rows

    def update(name: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        *done, at, place, fires = held.get if held.exists else (None, 0, 0, 0, 0, [], [], [])
        waiting = list(zip(at, place, fires, strict=True))
        if not held.hasTimedOut:
            for part in parts:
                waiting += zip((part["_ms"]).tolist(), part["_order"].tolist(), part["_fires"].tolist(), strict=True)
        waiting.sort(key=lambda x: (x[1], x[0]))
        passed = held.getCurrentWatermarkMs()
        # in order, up to the first row whose time may still have company
        ready = next((k for k, x in enumerate(waiting) if x[0] >= passed), len(waiting))
        done, waiting = walk(*done, waiting[:ready]), waiting[ready:]
        held.update((*done, *[list(c) for c in (zip(*waiting, strict=True) if waiting else ([], [], []))]))
        if waiting:
            held.setTimeoutTimestamp(max(passed, min(x[0] for x in waiting)) + 1)
        joined, _, longest, episodes, rows = walk(*done, waiting)
        yield pd.DataFrame({key: [name[0]], "seen": [joined], "rows": [rows], "longest": [longest], "episodes": [episodes]})

    t = F.col(ts).cast("timestamp")
    e = events.select(F.col(key), t.alias("_ts"), F.unix_millis(t).alias("_ms"), F.col(order).cast("long").alias("_order"), F.coalesce(firing, F.lit(False)).alias("_fires")).where("_ts IS NOT NULL AND _order IS NOT NULL")
    kind = events.schema[key].dataType.simpleString()
    return e.withWatermark("_ts", late).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, seen long, rows long, longest long, episodes long", state, "update", GroupStateTimeout.EventTimeTimeout)


def progress(events: DataFrame, totals: DataFrame, source: str, ts: str, total: str, history: int = 300, step: int = 10, late: str = "10 minutes") -> DataFrame:
    """Per source, as an update stream: at (the last unit's time in steps of so many seconds), done, rate (units a minute) and
    eta (minutes until ``total``, of the static ``totals``).

    The rate is over the time since the last unit that is ``history`` seconds or more older than the last one; without such a
    unit, or without units since, rate and eta are null, and eta too where the total is unknown. State per source: units by step
    of the last ``history`` seconds and of the lateness allowed; rows later than that are dropped.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(name: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        older, at, n, whole = held.get if held.exists else (0, [], [], None)
        units = dict(zip(at, n, strict=True))
        for part in parts:
            for k, v in part.groupby("_step").size().items():
                units[int(k)] = units.get(int(k), 0) + int(v)
            known = part["_total"].dropna()
            whole = float(known.iloc[0]) if len(known) else whole
        steps = sorted(units)
        last = steps[-1]
        before = [k for k in steps if k <= last - history]
        done = older + sum(units.values())
        rate = None
        if before and (since := sum(v for k, v in units.items() if k > before[-1])):
            rate = since * 60 / (last - before[-1])
        # steps that no later unit can ask for become a number; the one before the history stays
        passed = held.getCurrentWatermarkMs() // 1000 - history
        gone = [k for k in before[:-1] if k < passed]
        held.update((older + sum(units.pop(k) for k in gone), sorted(units), [units[k] for k in sorted(units)], whole))
        yield pd.DataFrame({source: [name[0]], "at": [last], "done": [done], "rate": [rate], "eta": [None if rate is None or whole is None else (whole - done) / rate]}, columns=[source, "at", "done", "rate", "eta"]).astype({"rate": "float64", "eta": "float64"})

    t = F.col(ts).cast("timestamp")
    known = totals.select(source, F.col(total).cast("double").alias("_total"))
    e = events.select(source, t.alias("_ts"), (F.floor(F.unix_timestamp(t) / step) * step).alias("_step")).where("_ts IS NOT NULL").join(known, source, "left")
    kind = events.schema[source].dataType.simpleString()
    return e.withWatermark("_ts", late).groupBy(source).applyInPandasWithState(update, f"{source} {kind}, at long, done long, rate double, eta double", "older long, at array<long>, n array<long>, whole double", "update", GroupStateTimeout.NoTimeout)


def run_updates(stream: DataFrame, keys: list[str], order: str, on_batch=None) -> DataFrame:
    """Runs an update stream over all that is available, appends each batch's rows under its number, and returns the last row
    of each key: that of the greatest ``order``, of equal ones of the last batch. A batch that is run again replaces its rows.
    ``on_batch`` gets the query's progress when all is done."""
    spark = stream.sparkSession
    place = new_dir(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/_batch={number}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    if on_batch:
        on_batch(q.recentProgress)
    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    rows = spark.read.schema(schema).option("basePath", f"{place}/out").parquet(f"{place}/out")
    others = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(order, "_batch")).alias("_last"))
    return last.select(*keys, "_last.*").select(*stream.columns)


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs the stream over all that is available and returns its last result, written in the shared folder."""
    spark = stream.sparkSession
    place = new_dir(spark, "stream")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{place}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def incremental(stream: DataFrame, out: str, ledger: str, key: str, checkpoint: str):
    """Exactly once by key: each batch appends only keys that the ledger lacks, under its own number, so a batch that is
    run again after a crash replaces what it had written. ``sinks.appended`` reads the result."""
    from ..sources.sinks import append_new

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, k: append_new(b, b.sparkSession, out, ledger, key, f"stream-{k}")).start()
