"""Streaming twins of the frame operators.

A stream of samples (track, ch, i, x) is cut into frames by a stateful operator that keeps
the samples of unfinished frames and the last level of each channel. A frame comes out once
it is complete, or once samples of ``patience`` later frames have come; what it lacks then
counts as zero, so that a lost sample stops no channel and the state stays bounded.
Samples of frames that are out already are late and dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PATIENCE = 16
_SAMPLE = np.dtype([("i", np.int64), ("x", np.float64)])


def _held(data: bytes, batches: Iterator[pd.DataFrame], first: int) -> np.ndarray:
    """Samples in order from number ``first`` on: those of the state, then new ones; of repeated numbers the first."""
    parts = [np.frombuffer(data, _SAMPLE)]
    for b in batches:
        new = np.empty(len(b), _SAMPLE)
        new["i"], new["x"] = b["i"].to_numpy(), b["x"].fillna(0.0).to_numpy()
        parts.append(new)
    rows = np.concatenate(parts)
    rows = rows[rows["i"] >= first]
    return rows[np.unique(rows["i"], return_index=True)[1]]


def _frames(rows: np.ndarray, following: int, size: int, patience: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Frames from number ``following`` on that are complete or overdue, and the samples that are left."""
    out, done = [], 0
    while done < len(rows):
        end = done + int(np.searchsorted(rows["i"][done:], (following + 1) * size))
        if end - done < size and rows["i"][-1] < (following + 1 + patience) * size:
            break
        x = np.zeros(size)
        x[rows["i"][done:end] - following * size] = rows["x"][done:end]
        out.append(x)
        done, following = end, following + 1
    return out, rows[done:]


def frame_levels(samples: DataFrame, size: int = 64, decay: float = 0.98, start: float = 0.006, patience: int = PATIENCE) -> DataFrame:
    """(track, ch, frame, rms, peak, energy, level) of frames in order; level is the exponential mean of the energies."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, data, level = state.get if state.exists else (0, b"", start)
        frames, rest = _frames(_held(data, batches, following * size), following, size, patience)
        out = []
        for x in frames:
            energy = float((x * x).sum())
            level = decay * level + (1 - decay) * energy
            out.append((*key, following, float(np.sqrt(energy / size)), float(np.abs(x).max()), energy, level))
            following += 1
        state.update((following, rest.tobytes(), level))
        yield pd.DataFrame(out, columns=["track", "ch", "frame", "rms", "peak", "energy", "level"])

    return _stateful(samples, run, "track string, ch int, frame long, rms double, peak double, energy double, level double", "next long, held binary, level double", None)


def look_ahead(samples: DataFrame, size: int = 64, patience: int = PATIENCE, idle_ms: int | None = None) -> DataFrame:
    """(track, ch, frame, energy, next): a frame waits for the one after it.

    The last frame of a channel waits in the state; with ``idle_ms`` it comes out, with 0
    as the next energy, when the channel has had no samples for so long.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, data, before = state.get if state.exists else (0, b"", -1.0)
        out = []
        if state.hasTimedOut:
            if before >= 0:
                out.append((*key, following - 1, before, 0.0))
            state.update((following, data, -1.0))
        else:
            frames, rest = _frames(_held(data, batches, following * size), following, size, patience)
            for x in frames:
                energy = float((x * x).sum())
                if before >= 0:
                    out.append((*key, following - 1, before, energy))
                before, following = energy, following + 1
            state.update((following, rest.tobytes(), before))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["track", "ch", "frame", "energy", "next"])

    return _stateful(samples, run, "track string, ch int, frame long, energy double, next double", "next long, held binary, before double", idle_ms)


def _stateful(samples: DataFrame, run: Callable, out: str, state: str, idle_ms: int | None) -> DataFrame:
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return samples.groupBy("track", "ch").applyInPandasWithState(run, out, state, "append", timeout)
