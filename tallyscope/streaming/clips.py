"""Stateful streams over clips (G1, G12, F1, F7): each keeps its state by clip and agrees with its batch form.

Frames arrive in any batches, but within a batch they are put in frame order; a frame not later than the last one processed
is late and is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyscope.operators import tracking


def track_stream(detections: DataFrame, least: float = 0.3, max_age: int = 30, only_active: bool = True) -> DataFrame:
    """The greedy tracker over a stream of detections."""
    state_schema = "tracks array<struct<id:bigint,x1:double,y1:double,x2:double,y2:double,class_id:int,conf:double,last_seen:bigint,hits:bigint>>, next_id bigint, last_frame bigint"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, next_id, last = state.get if state.exists else ([], 1, -1)
        now = tracking.State.unpack([tuple(r) for r in rows], next_id)
        frames = pd.concat(list(batches))
        frames = frames[frames["frame"] > last]
        if len(frames):
            last = int(frames["frame"].max())
            yield tracking.run_frames(now, key[0], frames, least, max_age, only_active)
        state.update((now.pack(), now.next_id, last))

    columns = ["clip", "frame", "det_idx", "class_id", "conf", *tracking.BOX]
    return detections.select(*columns).groupBy("clip").applyInPandasWithState(run, tracking.SCHEMA, state_schema, "append", GroupStateTimeout.NoTimeout)


def window_stream(frames: DataFrame, length: int, stride: int) -> DataFrame:
    """Maximum of each complete sliding window (`clip`, `window_index`, `first_frame`, `last_frame`, `value`) of a stream of
    scored frames; state is the last `length` scores."""
    start = max(length, stride) - 1

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, last = state.get if state.exists else ([], -1)
        kept, out = list(kept), []
        rows = pd.concat(list(batches)).sort_values("frame")
        for frame, p in zip(rows["frame"].tolist(), rows["p"].tolist(), strict=True):
            if frame <= last:
                continue
            last = frame
            kept = [*kept, p][-length:]
            if frame >= start and (frame - start) % stride == 0:
                out.append((key[0], (frame - start) // stride, frame - length + 1, frame, max(kept)))
        state.update((kept, last))
        yield pd.DataFrame(out, columns=["clip", "window_index", "first_frame", "last_frame", "value"])

    return frames.select("clip", "frame", "p").groupBy("clip").applyInPandasWithState(run, "clip bigint, window_index bigint, first_frame bigint, last_frame bigint, value double", "scores array<double>, last_frame bigint", "append", GroupStateTimeout.NoTimeout)


def alarm_stream(windows: DataFrame, threshold: float) -> DataFrame:
    """First alarm of each clip under the max rule (`clip`, `window_index`, `last_frame`), emitted once."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else False
        rows = pd.concat(list(batches))
        over = rows[rows["score"] >= threshold]
        out = []
        if not done and len(over):
            first = over.sort_values("window_index").iloc[0]
            out.append((key[0], int(first["window_index"]), int(first["last_frame"])))
        state.update((done or bool(out),))
        yield pd.DataFrame(out, columns=["clip", "window_index", "last_frame"])

    return windows.select("clip", "window_index", "last_frame", "score").groupBy("clip").applyInPandasWithState(run, "clip bigint, window_index bigint, last_frame bigint", "done boolean", "append", GroupStateTimeout.NoTimeout)
