"""Greedy overlap tracker (G1, D6): one step function for batch and stream.

Association depends on the frame before, so a clip is processed in frame order by one task; clips run in parallel. A task
reads sorted rows batch by batch and holds one frame and the open tracks, which `max_age` bounds, however long a clip is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import batched, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "clip bigint, frame bigint, track_id bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double, last_seen bigint, hits bigint"
BOX = ["x1", "y1", "x2", "y2"]
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [{"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in SCHEMA.split(", ")]
#: Rows in a batch of results.
BATCH = 10_000


@dataclass
class State:
    """Open tracks of a clip in order of creation: id -> [box, class, confidence, last seen, hits]."""

    tracks: dict = field(default_factory=dict)
    next_id: int = 1

    def pack(self) -> list[tuple]:
        return [(k, *map(float, t[0]), int(t[1]), float(t[2]), int(t[3]), int(t[4])) for k, t in self.tracks.items()]

    @staticmethod
    def unpack(rows: list, next_id: int) -> State:
        return State({r[0]: [list(r[1:5]), r[5], r[6], r[7], r[8]] for r in rows}, next_id)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of intersection over union of two lists of boxes."""
    w = np.clip(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
    h = np.clip(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0, None)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - w * h
    return np.divide(w * h, union, out=np.zeros_like(union), where=union > 0)


def step(state: State, frame: int, found: list[tuple], least: float, max_age: int) -> None:
    """One frame of detections (class, confidence, box): the best overlap of all is matched first (ties: oldest track, then
    first detection) until none reaches `least`; other detections open tracks in their order; tracks unseen for more than
    `max_age` frames close."""
    ids, matched, used = list(state.tracks), set(), set()
    if found and ids:
        grid = overlaps(np.array([state.tracks[k][0] for k in ids], float), np.array([d[2] for d in found], float))
        i, j = np.nonzero(grid >= least)
        order = np.argsort(-grid[i, j], kind="stable")
        for row, col in zip(i[order].tolist(), j[order].tolist()):
            if row not in matched and col not in used:
                matched.add(row)
                used.add(col)
                kind, conf, box = found[col]
                state.tracks[ids[row]] = [box, kind, conf, frame, state.tracks[ids[row]][4] + 1]
    for col, (kind, conf, box) in enumerate(found):
        if col not in used:
            state.tracks[state.next_id] = [box, kind, conf, frame, 1]
            state.next_id += 1
    for k in [k for k, t in state.tracks.items() if frame - t[3] > max_age]:
        del state.tracks[k]


def follow(state: State, clip, rows: Iterable[tuple], least: float, max_age: int, only_active: bool) -> Iterator[tuple]:
    """Open tracks after each frame of a clip, from rows (frame, class, confidence, box) in order; one whose box is null is an
    empty frame."""
    for frame, group in groupby(rows, key=lambda r: r[0]):
        step(state, frame, [(kind, conf, box) for _, kind, conf, box in group if box[0] is not None and box[0] == box[0]], least, max_age)
        for tid, (box, kind, conf, seen, hits) in state.tracks.items():
            if not only_active or seen == frame:
                yield clip, frame, tid, kind, conf, *box, seen, hits


def _rows(frame: list, kind: list, conf: list, *box: list) -> Iterator[tuple]:
    return zip(frame, kind, conf, map(list, zip(*box)))


def run_frames(state: State, clip, rows: pd.DataFrame, least: float, max_age: int, only_active: bool) -> pd.DataFrame:
    """Feed a clip's frames (detections in `det_idx` order) and list open tracks."""
    rows = rows.sort_values(["frame", "det_idx"], kind="stable")
    ordered = _rows(*[rows[c].tolist() for c in ("frame", "class_id", "conf", *BOX)])
    return pd.DataFrame(follow(state, clip, ordered, least, max_age, only_active), columns=COLUMNS)


def track(detections: DataFrame, spine: DataFrame | None = None, least: float = 0.3, max_age: int = 30, only_active: bool = True) -> DataFrame:
    """Tracks of all clips. With a `spine` (`clip`, `frame`) frames without detections age the tracks too; `only_active` keeps
    those matched in the frame (retained ones must not reach rules)."""
    rows = detections.select("clip", "frame", F.col("det_idx").cast("bigint").alias("det_idx"), "class_id", "conf", *BOX)
    if spine is not None:
        rows = spine.select("clip", "frame").join(rows, ["clip", "frame"], "left").fillna({"det_idx": 0})
    rows = rows.fillna({"class_id": -1, "conf": 0.0})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in batches for row in zip(batch.column(0).to_pylist(), _rows(*[c.to_pylist() for c in batch.columns[1:]])))
        tracks = (t for clip, rows in groupby(flat, key=lambda r: r[0]) for t in follow(State(), clip, (r for _, r in rows), least, max_age, only_active))
        for part in batched(tracks, BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), TYPES)], names=COLUMNS)

    placed = rows.repartition("clip").sortWithinPartitions("clip", "frame", "det_idx")
    return placed.select("clip", "frame", "class_id", "conf", *BOX).mapInArrow(run, SCHEMA)
