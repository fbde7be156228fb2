"""Audio for tables without any: each vector is rendered as a melody, whose recording op3 then fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tramline.llm.chroma import RATE

#: Of a rendered vector: seconds of a note, and semitones for a step of one in a value.
NOTE_SECONDS = 0.125
SEMITONES = 24


def melody(values: list[float] | None, rate: int = RATE) -> bytes:
    """PCM of a note for each value: a sine and its octave, so many semitones from 440 Hz, three octaves at most."""
    if not values:
        return b""
    steps = np.clip(np.round(np.nan_to_num(np.array([np.nan if v is None else v for v in values], float), nan=0.0, posinf=3.0, neginf=-3.0) * SEMITONES), -36, 36)
    step, size, last = 2 * np.pi * (440.0 * 2 ** (steps / 12)) / rate, round(NOTE_SECONDS * rate), 0.0
    out = np.empty(len(step) * size, "<i2")
    for at in range(0, len(step), 8):  # so few notes stay in a core's cache
        turn = np.repeat(step[at : at + 8], size)
        turn[0] += last
        np.cumsum(turn, out=turn)
        last = turn[-1]
        # the remainder of whole turns in two exact steps, as np.mod is slow
        whole, most = np.floor(turn / (2 * np.pi)), float(np.float32(2 * np.pi))
        turn = (turn - whole * most - whole * (2 * np.pi - most)).astype(np.float32)
        out[at * size : at * size + len(turn)] = np.round((np.sin(turn) + 0.5 * np.sin(2 * turn)) * 16000)
    return out.tobytes()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # small batches, as a row's audio is about a thousand times its vector
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([melody(v.as_py()) for v in part.column("values")], pa.binary())], ["id", "audio"])


def recordings(vectors: DataFrame) -> DataFrame:
    """(id, audio) rendered from vectors(id, values), for data without an audio column."""
    return vectors.select("id", "values").mapInArrow(_render, "id long, audio binary")
