"""The sequential models over Structured Streaming: one state per stream, the same rows as in batch."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class ModelProcessor(StatefulProcessor):
    """Keeps a model's state between micro-batches; items of a batch are taken in order of seq."""

    def __init__(self, model: Callable[[], Any], key: str, names: list[str]):
        self.model, self.key, self.names = model, key, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("model", "state binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        m = self.model()
        if self.state.exists():
            m.__dict__.update(pickle.loads(self.state.get()[0]))
        out: list[tuple] = []
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, t, a in zip(frame["seq"].tolist(), frame["ts"].astype("Int64").tolist(), frame["arrival"].astype("Int64").tolist(), strict=True):
            out += m.push(seq, None if t is pd.NA else t, None if a is pd.NA else a)
        self.state.update((pickle.dumps(m.__dict__),))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[self.key, *self.names])

    def close(self) -> None:
        pass


def replay_stream(items: DataFrame, model: Callable[[], Any], ts: str = "pts_us", arrival: str = "arrival_us", key: str = "stream_id") -> DataFrame:
    """The streaming form of sequential.replay. Needs the RocksDB state store."""
    fields = model().fields
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    kind = items.schema[key].dataType.simpleString()
    given = items.selectExpr(key, "seq", f"{ts} as ts", f"{arrival} as arrival")
    processor = ModelProcessor(model, key, names)
    return given.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {fields}", "Append", "None")


def report_stream(packets: DataFrame, interval: str, late: str) -> DataFrame:
    """Packets and bytes per stream and interval; later ones than the watermark allows go. packets has a timestamp column `at`."""
    return packets.withWatermark("at", late).groupBy("stream_id", F.window("at", interval)).agg(F.count("*").alias("packets"), F.sum("size").alias("bytes")).select("stream_id", F.col("window.start").alias("start"), "packets", "bytes")
