"""Stateful streams that must see the events of a key in time order.

Each key buffers its events until the watermark has passed them, then applies them in
order. So the result is that of the batch operators over all events up to the
watermark, in whatever order they arrive. Rows older than the watermark are dropped by
Spark and counted in the query's progress (``numRowsDroppedByWatermark``); ``late_events`` sets them aside.

A stream over a bounded source has an end. ``run_closed`` tells it: a marker row at the end of time
follows the last event, moves the watermark past all of them, and so fires every timer and closes every window.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadloom.session import shared_dir

#: The time of the end marker; rows of this time are no events. Later ones do not fit in nanoseconds.
END = "2250-01-01 00:00:00"
END_MICROS = int(datetime.fromisoformat(f"{END}+00:00").timestamp()) * 1_000_000
STATE = "name array<string>, at array<bigint>, id array<bigint>, kind array<string>, memo string"


def replay(
    events: DataFrame,
    key: str,
    step: Callable[[Any, int, str], tuple[Any, list[tuple]]],
    output: str,
    delay: str = "1 hour",
    due: Callable[[Any, int], tuple[Any, list[tuple], int | None]] | None = None,
    groups: int = 1024,
) -> DataFrame:
    """Applies ``step(memo, ts, kind) -> (memo, rows)`` to the events of each key in order.

    ``events`` has the key (a string), ts, event_id and kind. ``memo`` is any JSON value, None at
    first. ``due(memo, watermark) -> (memo, rows, next)`` handles a timer: ``next`` is
    the microsecond at which the key wants to be called again.

    Keys share ``groups`` groups by their hash, since Spark's call of a group costs far more than the few events
    of a key. Inside a group each key has its own events, memo and timer. ``groups`` belongs to the checkpoint.
    """
    columns = [part.strip().split(" ")[0] for part in output.split(",")]

    def handle(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        import json

        names, at, ids, kinds, memo = state.get if state.exists else ([], [], [], [], "[]")
        waiting: dict[str | None, list[tuple]] = {}
        # By key: its memo, the watermark it was last called at, and its timer.
        known = {key: tuple(rest) for key, *rest in json.loads(memo)}
        for key, *event in zip(names, at, ids, kinds):
            waiting.setdefault(key, []).append(tuple(event))
        called = set()
        for batch in batches:
            for key, *event in zip(
                batch["name"].tolist(), batch["at"].tolist(), batch["event_id"].tolist(), batch["kind"].tolist()
            ):
                called.add(key)
                waiting.setdefault(key, []).append(tuple(event))
        mark = state.getCurrentWatermarkMs() * 1000
        called.update(key for key, more in waiting.items() if more[0][0] <= mark)
        called.update(key for key, (_, _, timer) in known.items() if timer is not None and timer <= mark)
        rows = []
        for key in called:
            value, done, _ = known.get(key, (None, None, None))
            # Spark judges lateness by the watermark of the batch before; what this key has passed is late here.
            mine = sorted(e for e in waiting.pop(key, []) if e[0] < END_MICROS and (done is None or e[0] > done))
            if not mine and key not in known:
                continue
            n_ready = bisect_right(mine, mark, key=lambda e: e[0])
            for when, _, kind in mine[:n_ready]:
                value, more = step(value, when, kind)
                rows += [(key, *r) for r in more]
            timer = None
            if due is not None:
                value, more, timer = due(value, mark)
                rows += [(key, *r) for r in more]
            known[key] = (value, mark, timer)
            if mine[n_ready:]:
                waiting[key] = mine[n_ready:]
        if not known:
            return
        left = [(key, *e) for key, more in waiting.items() for e in more]
        calls = [more[0][0] for more in waiting.values()] + [t for _, _, t in known.values() if t is not None]
        state.update(
            (
                [e[0] for e in left], [e[1] for e in left], [e[2] for e in left], [e[3] for e in left],
                json.dumps([[key, *rest] for key, rest in known.items()]),
            )
        )
        if calls:
            state.setTimeoutTimestamp(max(min(calls) // 1000 + 1, mark // 1000 + 1))
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return (
        events.withColumn("ts", F.col("ts").cast("timestamp_ltz"))  # watermarks need a zone
        .withWatermark("ts", delay)
        .select(F.col(key).alias("name"), "ts", "event_id", "kind", F.unix_micros("ts").alias("at"))
        .withColumn("group", F.pmod(F.xxhash64("name"), F.lit(groups)))
        .groupBy("group")
        .applyInPandasWithState(
            handle, output, STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def is_end(ts: str = "ts") -> Column:
    return F.col(ts) == F.lit(END).cast("timestamp_ntz")


def _run(stream: DataFrame, base: str, output: str) -> None:
    query = (
        stream.writeStream.format("parquet")
        .outputMode(output)
        .option("checkpointLocation", f"{base}/state")
        .option("path", f"{base}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_available(stream: DataFrame, output: str = "append") -> DataFrame:
    """Runs a stream over what its source holds now and returns what it wrote.

    Rows go from the executors to files in the shared folder, not through the driver.
    """
    spark: SparkSession = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _run(stream, base, output)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], output: str = "append") -> None:
    """Hands what the source holds now to ``write``, batch after batch."""
    state = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}/state"
    query = stream.writeStream.outputMode(output).foreachBatch(write).option("checkpointLocation", state)
    query.trigger(availableNow=True).start().awaitTermination()


def run_closed(flow: Callable[[DataFrame], DataFrame], events: DataFrame, ts: str = "ts", output: str = "append") -> DataFrame:
    """Runs a flow over what its source holds now, then closes it, and returns what it wrote.

    ``events`` is a stream with the event time ``ts``. When all of it has been read, a row that holds nothing but the end of time
    is put into a source beside it and the same query goes on from its checkpoint: its timers fire, its
    windows close, and the rows are those of the batch operator over all events.
    """
    spark: SparkSession = events.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    marker = spark.createDataFrame([], events.schema)
    marker.write.parquet(f"{base}/end")
    stream = flow(events.unionByName(spark.readStream.schema(events.schema).parquet(f"{base}/end")))
    _run(stream, base, output)
    columns = [F.lit(END if f.name == ts else None).cast(f.dataType).alias(f.name) for f in events.schema.fields]
    spark.range(1).select(*columns).write.mode("append").parquet(f"{base}/end")
    _run(stream, base, output)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def late_events(events: DataFrame, applied: DataFrame, *keys: str) -> DataFrame:
    """Events that came after the watermark had passed them: those that a replay has given no row for.

    ``events`` is what the source holds, ``applied`` the replay's rows, and ``keys`` name an event in both.
    """
    return events.join(applied.select(*keys).distinct(), list(keys), "left_anti")


__all__ = ["is_end", "late_events", "replay", "run_available", "run_batches", "run_closed"]
