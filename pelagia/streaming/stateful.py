"""R1 with state: frames and telemetry that both keep arriving, matched by deployment as soon as the answer is final.

The state of a deployment holds its start, the frames that wait and the telemetry of the last ``keep_s`` seconds; what
a batch costs follows its own rows and that state, not what was written before. Time is the deployment's own: its
newest telemetry less ``delay_s``, the time by which rows may be out of order. So one deployment that is uploaded after
a newer one loses nothing. A frame's answer is final once a telemetry row at or after it is older than that time, or the
time is past the frame by more than ``patience_s``, or the deployment has ended: by a marker, or ``idle`` without rows.

Within ``delay_s`` late telemetry gives the rows of the batch job. A frame from before the telemetry that is still kept
is not answered from what is left: it gets the status ``late``, for the batch job to match against the whole table.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pelagia.functions.normalize import elapsed_milliseconds
from pelagia.operators.frames import frame_rows
from pelagia.operators.timeline import DEP

FRAME, ROW, END = 0, 1, 2
_STATE = "start bigint, fixed boolean, newest bigint, pruned bigint, t binary, no binary, v binary, w_no array<bigint>, w_name array<string>, w_path array<string>, w_ms array<bigint>"
_OUT = "row_no bigint, filename string, path string, elapsed_ms bigint, frame_us bigint, match_row_no bigint, match_us bigint, v array<double>, status string"


def events(frames: DataFrame, telemetry: DataFrame, columns: Sequence[str], ends: DataFrame | None = None) -> DataFrame:
    """Frames (deployment_id, row_no, filename, maybe path), telemetry (deployment_id, row_no, ts and the columns) and
    end markers (deployment_id) as one stream."""
    none = lambda kind: F.lit(None).cast(kind)
    path = F.col("path") if "path" in frames.columns else F.col("filename")
    asks = frames.select(DEP, F.lit(FRAME).alias("side"), F.col("row_no").cast("bigint").alias("row_no"), none("bigint").alias("us"), "filename", path.alias("path"), elapsed_milliseconds(F.col("filename")).alias("elapsed_ms"), none("array<double>").alias("v"))
    rows = telemetry.where("ts IS NOT NULL").select(DEP, F.lit(ROW), F.col("row_no").cast("bigint"), F.unix_micros("ts"), none("string"), none("string"), none("bigint"), F.array(*(F.col(c).cast("double") for c in columns)))
    both = asks.union(rows)
    if ends is None:
        return both
    return both.union(ends.select(DEP, F.lit(END), none("bigint"), none("bigint"), none("string"), none("string"), none("bigint"), none("array<double>")))


class _Deployment:
    """The state of one deployment: telemetry sorted by time and row, and the frames that wait."""

    def __init__(self, stored: tuple | None):
        self.start, self.fixed, self.newest, self.pruned, t, no, v, *waiting = stored or (None, False, None, None, b"", b"", b"", [], [], [], [])
        times = np.frombuffer(t, np.int64).tolist()
        values = np.frombuffer(v, np.float64).reshape(len(times), -1).tolist() if times else []
        self.rows = list(zip(times, np.frombuffer(no, np.int64).tolist(), values, strict=True))
        self.waiting = list(zip(*waiting, strict=True)) if waiting[0] is not None and len(waiting[0]) else []

    def stored(self) -> tuple:
        """The state as one row; telemetry as bytes of its numbers, a missing one as NaN."""
        t, no, v = zip(*self.rows, strict=True) if self.rows else ((), (), ())
        waiting = list(zip(*self.waiting, strict=True)) or [(), (), (), ()]
        return (self.start, self.fixed, self.newest, self.pruned, np.array(t, np.int64).tobytes(), np.array(no, np.int64).tobytes(), np.array(v, np.float64).tobytes(), *map(list, waiting))

    def add(self, batch: pd.DataFrame) -> bool:
        """Take rows in; whether the deployment has ended."""
        ended, names = False, {w[1] for w in self.waiting}
        for side, n, us, name, path, ms, v in zip(*(batch[c].tolist() for c in ("side", "row_no", "us", "filename", "path", "elapsed_ms", "v")), strict=True):
            if side == ROW:
                us = int(us)
                self.rows.append((us, int(n), [math.nan if x is None else float(x) for x in v]))
                self.newest = us if self.newest is None else max(self.newest, us)
                if not self.fixed:
                    self.start = us if self.start is None else min(self.start, us)
            elif side == END:
                ended = True
            elif name not in names:
                names.add(name)
                self.waiting.append((int(n), name, path, None if ms is None or ms != ms else int(ms)))
        return ended

    def answered(self, ended: bool, delay: int, keep: int, patience: int) -> list[tuple]:
        """The frames whose answers are final now."""
        self.rows.sort(key=lambda r: r[:2])
        time = None if self.newest is None else self.newest - delay
        self.fixed = self.fixed or (self.start is not None and (ended or self.start <= time))
        t = [r[0] for r in self.rows]
        out, left = [], []
        for n, name, path, ms in self.waiting:
            if ms is None:
                out.append((n, name, path, None, None, None, None, None, "no time"))
            elif not self.fixed:
                if ended:
                    out.append((n, name, path, ms, None, None, None, None, "no telemetry"))
                else:
                    left.append((n, name, path, ms))
            else:
                at = self.start + 1000 * ms
                i = bisect_left(t, at)
                final = ended or (i < len(t) and t[i] <= time) or time - at > patience
                if self.pruned is not None and at < self.pruned:
                    out.append((n, name, path, ms, at, None, None, None, "late"))
                elif not final:
                    left.append((n, name, path, ms))
                else:
                    near = [self.rows[k] for k in (i - 1, i) if 0 <= k < len(t)]
                    best = min(near, key=lambda r: (abs(r[0] - at), r[0] >= at)) if near else (None, None, None)
                    out.append((n, name, path, ms, at, best[1], best[0], best[2] and [None if x != x else x for x in best[2]], "found"))
        self.waiting = left
        if self.fixed and self.rows:
            horizon = min([time - keep, *(self.start + 1000 * w[3] for w in left if w[3] is not None)])
            first = max(bisect_left(t, horizon) - 1, 0)  # the row before may be the nearest
            if first:
                self.rows, self.pruned = self.rows[first:], t[first]
        return out


def _matched(delay: int, keep: int, patience: int, idle_ms: int | None):
    names = [DEP, *(c.split()[0] for c in _OUT.split(", "))]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        deployment = _Deployment(state.get if state.exists else None)
        ended = state.hasTimedOut
        if not ended:
            for batch in batches:
                ended |= deployment.add(batch)
        out = deployment.answered(ended, delay, keep, patience)
        state.update(deployment.stored())
        if idle_ms and not ended:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(dict(zip(names, ([key[0]] * len(out), *map(list, zip(*out, strict=True))), strict=True)), dtype=object)

    return run


def matched_stream(frames: DataFrame, telemetry: DataFrame, tolerance_s: float, columns: Sequence[str] = ("x", "y", "z", "heading", "pitch", "roll"), ends: DataFrame | None = None, delay_s: float = 60.0, keep_s: float = 86400.0, patience_s: float = 86400.0, idle: str | None = None, camera_id: int = 1, crs: int = 4326) -> DataFrame:
    """The frame table of streams of frames and telemetry, as it becomes final: the columns of the batch job, without
    object ids (these follow the order of all names), and ``status``: ``found``, ``no time`` (none in the name), ``no
    telemetry``, or ``late``. An unmatched frame has its difference from the nearest row within ``patience_s``."""
    us = lambda s: round(s * 1e6)
    idle_ms = round(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    kind = f"{DEP} {frames.schema[DEP].dataType.simpleString()}, {_OUT}"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    found = events(frames, telemetry, columns, ends).groupBy(DEP).applyInPandasWithState(_matched(us(delay_s), us(keep_s), us(patience_s), idle_ms), kind, _STATE, "append", timeout)
    delta = (F.col("match_us") - F.col("frame_us")) / F.lit(1e6)
    near = found.select(
        DEP, F.lit(None).cast("bigint").alias("_id"), "filename", "path", "elapsed_ms", F.timestamp_micros("frame_us").alias("ts"), delta.alias("delta_s"), F.coalesce(F.abs(delta) <= tolerance_s, F.lit(False)).alias("matched"), "status",
        *(F.get("v", F.lit(i)).alias(f"m_{c}") for i, c in enumerate(columns)),
    )
    return frame_rows(near, camera_id, crs, ["status"]).drop("ObjectID")
