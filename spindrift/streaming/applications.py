"""Streams of moves and requests. The batch operators in ``operators.events``
and ``operators.metrics`` give the same results over finished tables; event
time, watermarks and late rows are additions of this engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.events import CLOSED, STAGES

_OUT = "application_id long, event_id long, occurred_at timestamp, status string, stage_reached int, reopened boolean"
_STATE = "status string, stage_reached int"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    status, reached = state.get if state.exists else (None, 1)
    rows = pd.concat(list(batches)).sort_values(["occurred_at", "event_id"])
    out = []
    for r in rows.itertuples():
        if r.status == status:
            continue
        if r.status in STAGES:
            reached = max(reached, STAGES.index(r.status) + 1)
        out.append((key[0], r.event_id, r.occurred_at, r.status, reached, status in CLOSED and r.status not in CLOSED))
        status = r.status
    if status is not None:
        state.update((status, reached))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])


def stage_stream(moves: DataFrame) -> DataFrame:
    """ST1 on a stream of moves (application_id, event_id, occurred_at, status):
    accepted moves with the stage reached. State is one row an application."""
    return moves.groupBy("application_id").applyInPandasWithState(_fold, _OUT, _STATE, "append", "NoTimeout")


def counter_stream(requests: DataFrame, at: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """ST7: requests per key and minute; minutes close when the watermark passes."""
    rows = requests.withWatermark(at, late).groupBy(F.window(at, "1 minute"), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), *keys, "n")


def session_stream(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Beyond the inventory: sessions of a key with a gap between them."""
    rows = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def sync_sink(path: str, apply: Callable[[DataFrame, DataFrame | None], DataFrame]) -> Callable[[DataFrame, int], None]:
    """ST6: foreachBatch function that keeps a table as numbered versions under
    ``path``: each batch is applied to the last version and written as the
    next. A batch that is run again writes the same version again."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v={number - 1}") if number > 0 else None
        apply(batch, old).write.mode("overwrite").parquet(f"{path}/v={number}")

    return run
