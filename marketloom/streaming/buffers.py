"""Rewards measured against the last rewards of their own key, with the buffers in the state store."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heappushpop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from .streams import MIN_COUNT

SMALL = 1e-6


class RewardBuffers(StatefulProcessor):
    """Per key a list state of its last `size` rewards; keys that are idle for longer than the time to live are dropped.

    For each batch of a key, the number, mean and deviation of its buffer once the whole batch is in it. Only the last
    `size` rewards of a batch are held while its rows pass, so that a hot key costs no more memory than others.
    """

    def __init__(self, size: int, live_ms: int | None):
        self.size, self.live_ms = size, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "reward double", self.live_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last: dict[int, list[tuple]] = {}
        for pdf in rows:
            for batch, i, reward in zip(pdf["batch_id"].tolist(), pdf["id"].tolist(), pdf["reward"].tolist(), strict=True):
                heap = last.setdefault(batch, [])
                heappush(heap, (i, reward)) if len(heap) < self.size else heappushpop(heap, (i, reward))
        buffer = deque((r[0] for r in self.held.get()), maxlen=self.size)
        out = []
        for batch in sorted(last):
            buffer.extend(reward for _, reward in sorted(last[batch]))
            out.append((key[0], batch, len(buffer), float(np.mean(buffer)), float(np.std(buffer))))
        self.held.put([(x,) for x in buffer])
        yield pd.DataFrame(out, columns=["key", "batch_id", "n", "mean", "std"])

    def close(self) -> None:
        pass


SCHEMA = "key long, batch_id long, n long, mean double, std double"


def buffer_stream(rewards: DataFrame, size: int = 32, live_ms: int | None = None) -> DataFrame:
    """key, batch_id, n, mean, std: each key's buffer after each of its batches, from a stream of (batch_id, key, id, reward).

    A batch arrives whole, in one micro-batch, and batches arrive in their order; ids order the rewards of a batch. Null
    rewards take no part.
    """
    d = rewards.where("reward IS NOT NULL").select("key", "batch_id", "id", "reward")
    mode = "None" if live_ms is None else "ProcessingTime"
    return d.groupBy("key").transformWithStateInPandas(RewardBuffers(size, live_ms), outputStructType=SCHEMA, outputMode="append", timeMode=mode)


def buffers(rewards: DataFrame, size: int = 32) -> DataFrame:
    """The same table from a table of rewards: window frames over a key's rows, of which the last of each batch counts."""
    w = Window.partitionBy("key").orderBy("batch_id", "id").rowsBetween(1 - size, 0)
    d = rewards.where("reward IS NOT NULL").select("key", "batch_id", "id", F.count("reward").over(w).alias("n"), F.avg("reward").over(w).alias("mean"), F.stddev_pop("reward").over(w).alias("std"))
    last = d.groupBy("key", "batch_id").agg(F.max_by(F.struct("n", "mean", "std"), "id").alias("x"))
    return last.select("key", "batch_id", "x.*")


def advantages(rewards: DataFrame, held: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """batch_id, key, id, advantage: how many deviations a reward lies above the mean of its key's buffer, or of its whole
    batch where the buffer holds fewer than `least`. held: what buffers or buffer_stream gives."""
    d = rewards.where("reward IS NOT NULL")
    whole = d.groupBy("batch_id").agg(F.avg("reward").alias("_mean"), F.stddev_pop("reward").alias("_std"))
    j = d.join(held, ["key", "batch_id"]).join(whole, "batch_id")
    few = F.col("n") < least
    z = (F.col("reward") - F.when(few, F.col("_mean")).otherwise(F.col("mean"))) / (F.when(few, F.col("_std")).otherwise(F.col("std")) + SMALL)
    return j.select("batch_id", "key", "id", z.alias("advantage"))
