"""Keyed state machines on streams: the step functions of the batch folds inside a stateful processor."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from relaywright.operators.folds import LIFECYCLE_SCHEMA, RELEASE_SCHEMA, Step, lifecycle_step, release_step

#: The store that state of any size needs.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Fold(StatefulProcessor):
    """Applies `step` to a key's rows in `order`, batch by batch; the state is one value."""

    def __init__(self, step: Step, order: list[str], start: Callable = lambda: None):
        self.step, self.order, self.start = step, order, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else self.start()
        out = []
        # missing values are None, as in the folds
        arrived = pd.concat(rows).sort_values(self.order).astype(object)
        for row in arrived.where(arrived.notna(), None).to_dict("records"):
            state, result = self.step(state, row)
            out.extend(result if isinstance(result, list) else [] if result is None else [result])
        self.state.update((pickle.dumps(state),))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Fold(step, order), outputStructType=schema, outputMode="Update", timeMode="None")


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """Verdicts for message_id, event_id, status, ts in the order of arrival, and of ts inside a batch."""
    return fold_stream(events, "message_id", ["ts", "event_id"], lifecycle_step, LIFECYCLE_SCHEMA)


def release_stream(rows: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """What the lanes of the stages release; `rows` as `release_step` takes them. A clock stream joins ticks to holds and control records."""
    return fold_stream(rows, "stage", ["t", "later", "item", "scope"], release_step(capacity, per_second), RELEASE_SCHEMA)
