"""Event operators on streams: windowed counts, sessions, deduplication, onset-aligned counts and running interval statistics.

Each takes a streaming frame with ts (timestamp) and gives one; ``drained`` runs it over all that a source holds and returns the final
rows as a table, so that a stream can be compared with its batch query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from intervale.sources.scratch import folder

#: How late an event may come, unless a query says otherwise.
LATE = "2 days"


def whole_span(spark: SparkSession, path: str, more: str = "1 hour") -> str:
    """A delay for which no event of the table under ``path`` is late, in whatever order its files come."""
    low, high = spark.read.parquet(path).agg(F.min(F.col("ts").cast("timestamp")), F.max(F.col("ts").cast("timestamp"))).first()
    seconds = int((high - low).total_seconds()) + 1 if low else 0
    return f"{seconds} seconds {more}"


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1, late: str = LATE) -> DataFrame:
    """The events under ``path`` as a stream, with ts as a timestamp and a watermark that waits for events up to ``late`` late.

    The state of an operator holds what can still change for as long. Files come in the order of their modification, not of their events.
    """
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rpartition("/")
    pattern = f"{parent}/[{name[0]}]{name[1:]}"  # a pattern for this one name: a source's plain path must be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def window_counts(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events and values by window and type; tumbling unless ``slide`` is given."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Runs of a user's events with gaps below ``gap``."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "max_value")


def deduplicated(events: DataFrame) -> DataFrame:
    """Events whose id has not come before within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def after_onsets(events: DataFrame, onset_type: str, hours: int) -> DataFrame:
    """Each event with the onsets of its user in the ``hours`` before it: a stream-stream join with a bound on time."""
    onsets = events.where(F.col("event_type") == onset_type).select(F.col("user_id").alias("o_user"), F.col("event_id").alias("onset_id"), F.col("ts").alias("o_ts"))
    within = (F.col("user_id") == F.col("o_user")) & (F.col("ts") >= F.col("o_ts")) & (F.col("ts") <= F.col("o_ts") + F.expr(f"INTERVAL {hours} HOURS"))
    return events.where(F.col("event_type") != onset_type).join(onsets, within).select("onset_id", "user_id", "event_id", "event_type")


STATE = "last double, n long, total double, squares double, late long, waiting array<double>"
RUNNING = "user_id long, n long, mean_gap double, cv double, n_late long"


def _folded(last: float | None, n: int, total: float, squares: float, times: list[float]) -> tuple[float | None, int, float, float]:
    for t in times:
        if last is not None and t > last:
            n, total, squares = n + 1, total + (t - last), squares + (t - last) ** 2
        last = t
    return last, n, total, squares


def _running(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    *sums, late, waiting = state.get if state.exists else (None, 0, 0.0, 0.0, 0, [])
    new = [t.timestamp() for pdf in batches for t in pdf["ts"]]
    in_time = [t for t in new if sums[0] is None or t >= sums[0]]
    late += len(new) - len(in_time)
    times = sorted([*(waiting if waiting is not None else []), *in_time])
    # what the watermark has passed is folded for good; the rest waits for events that belong before it
    settled = state.getCurrentWatermarkMs() / 1000
    cut = sum(t < settled for t in times)
    sums = _folded(*sums, times[:cut])
    state.update((*sums, late, times[cut:]))
    _, n, total, squares = _folded(*sums, times[cut:])
    mean = total / n if n else None
    spread = max(squares / n - mean * mean, 0.0) ** 0.5 if n else None
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean_gap": [mean], "cv": [spread / mean if mean else None], "n_late": [late]})


def running_intervals(events: DataFrame) -> DataFrame:
    """Number, mean and coefficient of variation of each user's intervals so far, in whatever order the events come.

    The state is four numbers per user and the times that the watermark has not passed. An event before those that are folded already
    counts in n_late only.
    """
    return events.select("user_id", "ts").groupBy("user_id").applyInPandasWithState(_running, RUNNING, STATE, "update", GroupStateTimeout.NoTimeout)


def keeper(path: str):
    """A writer of batches under ``path``, each to a folder of its own number: a batch that a restart repeats takes its own place."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/{number:09d}")

    return keep


def drained(spark: SparkSession, result: DataFrame, mode: str, keys: list[str] | None = None, path: str | None = None) -> DataFrame:
    """All rows that ``result`` gives until its source is empty, through a table in the shared folder.

    In update mode the latest row of each of ``keys`` counts, in complete mode the last batch. With the ``path`` of an earlier run, that
    run is taken up where it ended.
    """
    path = path or folder(spark)
    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(keeper(path)).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(result.withColumn("_batch", F.lit(0)).schema).parquet(f"{path}/rows/*")
    if mode == "complete":
        rows = rows.where(F.col("_batch") == (rows.agg(F.max("_batch")).first()[0] or 0))
    elif keys:
        rest = [c for c in rows.columns if c not in keys and c != "_batch"]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    return rows.drop("_batch")
