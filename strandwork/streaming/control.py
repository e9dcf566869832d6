"""The same kernels over Structured Streaming: state per file, frames in order.

Frames of a file must arrive in order of their numbers; a gap ends the file's stream with status `gap` rather than
guessing. Rows of one micro-batch are sorted, so only the order between batches matters.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import control
from ..operators.render import Shaper

FOUND = "file_id bigint, session int, base bigint, offset bigint, type int, bits bigint, status string"


class Scanner:
    """Finds the channel, then keeps the bits since its start and gives each packet once."""

    def __init__(self) -> None:
        self.next, self.k, self.given, self.ended = 0, -1, 0, False
        self.bits = np.empty(0, np.uint8)
        self.tail = np.empty(0, np.int64)
        self.sync_frame = -1

    def feed(self, frame: np.ndarray, difference: np.ndarray) -> list[tuple]:
        if self.ended or not len(frame):
            return []
        if frame[0] != self.next or (np.diff(frame) != 1).any():
            self.ended = True
            return [(None, None, None, None, None, "gap")]
        self.next += len(frame)
        if self.k < 0:
            self.tail = np.concatenate([self.tail, difference])
            magic = bytes(control.MAGIC >> i & 1 for i in range(control.MAGIC_BITS))
            hits = [(at, k) for k in control.BITS if (at := (self.tail >> k & 1).astype(np.uint8).tobytes().find(magic)) >= 0]
            if not hits:
                self.tail = self.tail[-(control.MAGIC_BITS - 1) :]
                return []
            at, self.k = min(hits)
            self.sync_frame = self.next - len(self.tail) + at
            difference, self.tail = self.tail[at:], np.empty(0, np.int64)
        self.bits = np.concatenate([self.bits, (difference >> self.k & 1).astype(np.uint8)])
        found = [p for p in control.parse_packets(self.bits) if p["type"] >= 0]
        new, self.given = found[self.given :], len(found)
        return [(p["session"], p["base"], p["offset"], p["type"], p["bits"], "ok") for p in new]


def _restored(kernel, state: GroupState):
    """A fresh kernel with the fields that the state holds, if it holds any."""
    if state.exists:
        vars(kernel).update(pickle.loads(state.get[0]))
    return kernel


def streaming_packets(frames: DataFrame) -> DataFrame:
    """Packets of a streaming DataFrame of frames (file_id, frame, l, r), each given once, when its last bit is in."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scanner = _restored(Scanner(), state)
        frame = pd.concat(list(batches)).sort_values("frame")
        rows = scanner.feed(frame["frame"].to_numpy(), (frame["l"] ^ frame["r"]).to_numpy())
        state.update((pickle.dumps(vars(scanner)),))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["file_id", "session", "base", "offset", "type", "bits", "status"]).astype({"session": "Int32", "base": "Int64", "offset": "Int64", "type": "Int32", "bits": "Int64"})

    return frames.groupBy("file_id").applyInPandasWithState(step, FOUND, "state binary", "append", GroupStateTimeout.NoTimeout)


def streaming_requantise(frames: DataFrame, ratio: int) -> DataFrame:
    """Requantised frames of a streaming DataFrame (file_id, out_frame, l, r); what the shaper feeds back is the state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shaper = _restored(Shaper(ratio), state)
        frame = pd.concat(list(batches)).sort_values("out_frame")
        left, right = shaper.run(frame["l"].tolist(), frame["r"].tolist())
        state.update((pickle.dumps(vars(shaper)),))
        yield frame.assign(l=left, r=right)[["file_id", "out_frame", "l", "r"]]

    return frames.groupBy("file_id").applyInPandasWithState(step, "file_id bigint, out_frame bigint, l bigint, r bigint", "state binary", "append", GroupStateTimeout.NoTimeout)


class Sniffer:
    """Decides after `patience` frames without an opening that a file is plain."""

    def __init__(self, patience: int = control.SCAN_FRAMES) -> None:
        self.scanner, self.patience, self.state = Scanner(), patience, "SNIFFING"

    def feed(self, frame: np.ndarray, difference: np.ndarray) -> str:
        if self.state == "SNIFFING":
            self.scanner.feed(frame, difference)
            if self.scanner.k >= 0 and self.scanner.sync_frame < self.patience:
                self.state = "DECODING"
            elif self.scanner.next >= self.patience:
                self.state = "PLAIN"
        return self.state
