"""Error reuse as a stateful stream: the decisions of the batch form, made region by region as timesteps complete.

The stream has judged cells (t, gid, block_id, value, taken). State of a region: its last complete timestep, whether that one
reused, the samples taken of it, and the cells of timesteps that are still arriving. All of it is bounded by the region's size
and the timesteps open at once. A complete timestep waits for earlier ones that have begun to arrive, and if the first timestep's
number is given for every one from that on, so that files may come in any order; otherwise one of which nothing has come is a
gap, after which nothing is reused. A timestep that doesn't complete within a time limit is given up by a timer: its
row says so, and it counts as a gap. Cells of timesteps that are done or given up are late; they change nothing and are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..config import GridConfig

#: Rows of a decision: n_reference and rmse as in the batch form; late is the number of late cells so far.
OUTPUT = "t int, block_id int, n_reference long, rmse double, reused boolean, complete boolean, late long"
_LAST = "t int, reused boolean, gids array<long>, vals array<double>, late long"
#: until is when an open timestep is given up, in milliseconds; 0 for never.
_OPEN = "gids array<long>, vals array<double>, taken array<boolean>, until long"


class ErrorDecisions(StatefulProcessor):
    """The state of one region. limit_ms: how long after its first cells a timestep may be waited for; None waits for ever."""

    def __init__(self, volume: int, threshold: float, limit_ms: int | None, first: int | None):
        self.volume, self.threshold, self.limit_ms, self.first = volume, threshold, limit_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _LAST)
        self.open = handle.getMapState("open", "t int", _OPEN)

    def _last(self) -> tuple:
        return tuple(self.last.get()) if self.last.exists() else (None if self.first is None else self.first - 1, False, [], [], 0)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        done, reused, gids, vals, late = self._last()
        cells = pd.concat(list(rows)).sort_values("t", kind="stable")
        if done is not None:
            late += int((cells["t"] <= done).sum())
            cells = cells[cells["t"] > done]
        t, columns = cells["t"].to_numpy(), [cells[c].to_numpy() for c in ("gid", "value", "taken")]
        edges = [0, *(np.flatnonzero(np.diff(t)) + 1).tolist(), len(t)] if len(t) else [0]
        held, fresh = {k[0] for k in self.open.keys()}, {}
        for a, b in zip(edges, edges[1:], strict=False):
            own = [c[a:b] for c in columns]
            if (at := int(t[a])) in held:
                *old, until = self.open.getValue((at,))
                own = [np.concatenate([np.array(o, n.dtype), n]) for o, n in zip(old, own, strict=True)]
            else:
                until = 0 if self.limit_ms is None else timerValues.getCurrentProcessingTimeInMs() + self.limit_ms
            fresh[at] = (*own, until)
        frame = self._decided(key, (done, reused, gids, vals, late), 0, held, fresh)
        # what is decided at once never goes into the state
        for at, (*own, until) in fresh.items():
            if until and at not in held:
                self.handle.registerTimer(until)
            self.open.updateValue((at,), (*(c.tolist() for c in own), until))
        yield frame

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._decided(key, self._last(), expiredTimerInfo.getExpiryTimeInMs(), {k[0] for k in self.open.keys()}, {})

    def _decided(self, key: tuple, state: tuple, now: int, held: set[int], fresh: dict[int, tuple]) -> pd.DataFrame:
        """What is complete or given up by now, in order, up to the first timestep that is still waited for; that is taken out of fresh and of the state.

        held are the timesteps in the state; those in fresh are as they are there. The others are read all at once, if one is needed.
        """
        done, reused, gids, vals, late = state
        out, stored = [], None
        for t in sorted(held | fresh.keys()):
            if t not in fresh and stored is None:
                stored = {k[0]: value for k, value in self.open.iterator()}
            *columns, until = fresh[t] if t in fresh else stored[t]
            own_gids, own_vals, taken = (np.array(x) for x in columns)
            complete = len(own_gids) >= self.volume
            awaited = not complete or (self.first is not None and t > done + 1)
            if awaited and not 0 < until <= now:
                break
            n, rmse = 0, None
            if complete and done == t - 1 and len(gids):
                place = np.argsort(own_gids)
                at = place[np.searchsorted(own_gids[place], gids)]  # a complete region has all its cells
                n, rmse = len(gids), float(np.sqrt(np.mean((own_vals[at] - np.array(vals)) ** 2)))
            reused = complete and rmse is not None and rmse <= self.threshold and not reused
            out.append((t, key[0], n, rmse, reused, complete, late))
            done, gids, vals = t, own_gids[taken].tolist() if complete else [], own_vals[taken].tolist() if complete else []
            fresh.pop(t, None)
        gone = held & {row[0] for row in out}
        if gone and gone == held:
            self.open.clear()
        else:
            for t in gone:
                self.open.removeKey((t,))
        self.last.update((done, reused, list(gids), list(vals), late))
        frame = pd.DataFrame(out, columns=["t", "block_id", "n_reference", "rmse", "reused", "complete", "late"])
        return frame.astype({"t": "int32", "block_id": "int32", "n_reference": "int64", "rmse": "float64", "reused": "bool", "complete": "bool", "late": "int64"})

    def close(self) -> None:
        pass


def error_stream(judged: DataFrame, cfg: GridConfig, limit_ms: int | None = None, first: int | None = None) -> DataFrame:
    """Decisions (OUTPUT) over a stream of judged cells. State is kept by RocksDB, which this way of state asks for; see stateful().

    With a time limit the stream has to run by a trigger of its own, as one over what is available goes on for as long as timers may fire.
    """
    processor = ErrorDecisions(cfg.block_volume, cfg.error_threshold, limit_ms, first)
    cells = judged.select("block_id", "t", "gid", "value", "taken")
    return cells.groupBy("block_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode="None" if limit_ms is None else "ProcessingTime")


def stateful(spark: SparkSession) -> None:
    """Let streams that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
