"""Event streams: windows with watermarks, deduplication, and stateful counts per key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brightloom.runtime import ensure_checkpoint_dir


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A parquet table, a file or a folder of files, as a stream of its rows."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # a stream reads folders: that of the file, of which only the file
        return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return reader.parquet(path)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over everything that is there and reads what it wrote, from the folder executors share."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def final_state(stream: DataFrame) -> DataFrame:
    """Runs a stream of aggregates over everything that is there and reads its last complete state.

    Each batch writes its state to a folder of its own, so that a batch that is run again replaces only itself.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    batches = []

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/{batch}")
        batches.append(batch)

    run = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(store).start()
    run.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows/{max(batches)}")


def windowed(events: DataFrame, at: str, kind: str, value: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """window_start, window_end, <kind>, n, total of tumbling or sliding windows; later rows than the watermark are dropped."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(at, late)
    w = F.window(at, length, slide) if slide else F.window(at, length)
    out = timed.groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n", "total")


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """<user>, session_start, session_end (of the last event), n; two events exactly one gap apart are one session."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(at, late)
    out = timed.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("session_end"))
    return out.select(user, F.col("w.start").alias("session_start"), "session_end", "n")


def once(events: DataFrame, at: str, id_col: str, late: str = "1 hour") -> DataFrame:
    """Every id once, within the watermark."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).dropDuplicatesWithinWatermark([id_col]) if timed.isStreaming else timed.dropDuplicates([id_col])


def summary_triggers(messages: DataFrame, session: str, threshold: int = 20) -> DataFrame:
    """session, trigger_no: one row each time another ``threshold`` messages of a session have come in.

    The state of a session is its number of messages, so that it stays small however long the session is.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        n = before + sum(len(b) for b in batches)
        state.update((n,))
        fired = range(before // threshold + 1, n // threshold + 1)
        yield pd.DataFrame({session: [key[0]] * len(fired), "trigger_no": list(fired)})

    kind = messages.schema[session].dataType.simpleString()
    return (
        messages.select(session).groupBy(session)
        .applyInPandasWithState(count, f"`{session}` {kind}, trigger_no bigint", "n bigint", "append", GroupStateTimeout.NoTimeout)
    )


def breaker_states(outcomes: DataFrame, key: str, failed: str, threshold: int = 5) -> DataFrame:
    """key, n_opened: how often a run of ``threshold`` failures has opened the key's breaker; a success closes it.

    outcomes must arrive in order within a batch by their column ``seq``.
    """

    def walk(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, opened = state.get if state.exists else (0, 0)
        for batch in batches:
            for bad in batch.sort_values("seq")[failed]:
                run = run + 1 if bad else 0
                opened += run == threshold
        state.update((run, opened))
        yield pd.DataFrame({key: [k[0]], "n_opened": [opened]})

    kind = outcomes.schema[key].dataType.simpleString()
    return outcomes.groupBy(key).applyInPandasWithState(
        walk, f"`{key}` {kind}, n_opened bigint", "run bigint, opened bigint", "update", GroupStateTimeout.NoTimeout
    )
