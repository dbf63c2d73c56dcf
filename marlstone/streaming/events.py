"""Structured Streaming over event tables: windows, sessions, dedup, running progress."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import scratch_folder


def event_stream(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """A file stream of an event table. Parquet files that arrive in the folder are read once each."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(df: DataFrame, keys: list[str], width: str, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Counts and sums per window and key; rows later than ``late`` are left out once the watermark has passed."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, keys: list[str], width: str, step: str, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.window(time, width, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(df: DataFrame, key: str, gap: str, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def deduplicated(df: DataFrame, keys: list[str], late: str = "10 minutes", time: str = "ts") -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def progress(df: DataFrame, key: str, done: str, total: float, time: str = "ts") -> DataFrame:
    """Per key the highest progress so far and the seconds left at its rate, as state that outlives batches.

    Progress never falls: a lower report changes nothing.
    """

    def update(keys, batches: Iterator, state) -> Iterator:
        import pandas as pd

        first, last, best = state.get if state.exists else (None, None, 0.0)
        for pdf in batches:
            for t, v in sorted(zip(pdf[time], pdf[done])):
                t = t.timestamp()
                first = t if first is None else first
                if v > best:
                    best, last = float(v), t
        state.update((first, last, best))
        rate = best / (last - first) if last is not None and last - first >= 1 else None
        left = (total - best) / rate if rate else None
        yield pd.DataFrame({key: [keys[0]], "progress": [best], "seconds_left": [left]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, progress double, seconds_left double", "first double, last double, best double", "update", "NoTimeout")


def run_once(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Process what is there and return the result table, for batch use of a streaming plan.

    Every batch is written as Parquet beside the stream's own checkpoint, in the shared scratch
    folder; a batch that is run again overwrites its rows. In complete mode the last batch is the
    result, otherwise all batches together.
    """
    spark = stream.sparkSession
    root = scratch_folder(spark, name)
    seen: list[int] = []

    def keep(rows: DataFrame, i: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={i}")
        seen.append(i)

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    last = f"{root}/rows/batch={max(seen)}" if mode == "complete" else f"{root}/rows/batch=*"
    return spark.read.schema(stream.schema).parquet(last)


def watch(df: DataFrame, key: str, done: str, total: float, every: float = 0.25, stall: float = 120.0, budget: float = 3600.0, late: str = "10 seconds", time: str = "ts") -> DataFrame:
    """``key, at, event, progress, seconds_left``: reports thinned out, and the ends that nobody reports.

    Per key and in the order of time, a report is passed on (``progress``) if it comes ``every`` seconds
    or more after the last one passed on; the one that completes the work (``done``) always is. Progress
    is the share done, 0 to 1. ``seconds_left`` is what remains at the rate since the first report, null
    in the first second. Timers on the event time end a key whose share has not grown for ``stall``
    seconds (``stalled``) or that still runs ``budget`` seconds after its first report (``over budget``):
    they fire as the watermark passes, without a report of the key, and outlive a restart with the
    state. A key that has ended stays so: later reports of it are passed over.
    """

    def step(keys, batches: Iterator, state) -> Iterator:
        import pandas as pd

        first, wrote, moved, best, ended = state.get if state.exists else (None, None, None, -1.0, False)
        out: list[tuple] = []

        def close(at: float) -> bool:
            """End the key if a limit had passed by ``at``."""
            limit, name = min((first + budget, "over budget"), (moved + stall, "stalled"))
            if limit <= at:
                out.append((limit, name, max(best, 0.0), None))
            return limit <= at

        if state.hasTimedOut:
            ended = ended or close(state.getCurrentWatermarkMs() / 1000)
        else:
            reports = sorted((t / 1e6, v) for pdf in batches for t, v in zip(pdf["__us"], pdf[done]) if t == t and v == v)
            for at, v in reports:
                if ended:
                    break
                if first is None:
                    first = moved = at
                elif close(at):
                    ended = True
                    break
                share = min(1.0, max(0.0, v / total))
                if share > best:
                    best, moved = share, at
                ended = share >= 1.0
                if ended or wrote is None or at - wrote >= every:
                    rate = v / (at - first) if at - first >= 1 and v > 0 else None
                    out.append((at, "done" if ended else "progress", share, max(0.0, (total - v) / rate) if rate else None))
                    wrote = at
        if first is not None:
            state.update((first, wrote, moved, best, ended))
            if not ended:
                # A timer may not lie at or before the watermark: what is due already fires with the next batch.
                due = min(first + budget, moved + stall) * 1000
                state.setTimeoutTimestamp(int(max(due, state.getCurrentWatermarkMs() + 1)))
        columns = {key: [keys[0]] * len(out), "at": [round(o[0] * 1e6) for o in out], "event": [o[1] for o in out], "progress": [o[2] for o in out]}
        if out:
            yield pd.DataFrame(columns | {"seconds_left": pd.Series([o[3] for o in out], dtype="float64")})

    kind = df.schema[key].dataType.simpleString()
    # Times go as microseconds, so that the session's time zone plays no part.
    held = df.filter(F.col(time).isNotNull()).withWatermark(time, late).withColumn("__us", F.unix_micros(time)).groupBy(key)
    found = held.applyInPandasWithState(step, f"{key} {kind}, at long, event string, progress double, seconds_left double", "first double, wrote double, moved double, best double, ended boolean", "append", "EventTimeTimeout")
    return found.withColumn("at", F.timestamp_micros("at"))
