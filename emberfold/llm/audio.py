"""Audio features of media columns.

`wave_of` stores samples of eight bits as a WAVE file and `samples_of` reads one back, without loss. Features of a file:
polyphase resampling by `UP` / `DOWN` with a windowed-sinc filter, one filter phase per output phase so no sample is
computed that is thrown away; overlapped, windowed frames; a mel filterbank of their power spectra, in logs; and
segments by hysteresis: one opens where the frame energy rises over the high limit and closes where it falls under the
low one. Log-mel frames are cut into tensors of one fixed shape, the last padded with the floor, and stored as an Arrow
IPC stream of a fixed-shape tensor column with the time span of each tensor.

Every document is computed by itself, with shapes that depend on its length alone, so equal texts give equal values.
Frames go through the transform in blocks, so memory is a few bytes per byte of the longest text in a batch.

Defined results: a null or empty text is 192 blanks; one that is no file of this kind raises ValueError.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame

from .common import with_computed

UNIT, BLANK = 192, b" "
RATE, UP, DOWN, TAPS = 8000, 3, 4, 16
FRAME, HOP, FFT, MELS = 96, 48, 128, 20
TENSOR_FRAMES, BLOCK_FRAMES, FLOOR = 32, 4096, 1e-6
#: Hysteresis limits in decibels about the file's mean frame energy.
HIGH_DB, LOW_DB = 1.0, -1.0
NEW_RATE = RATE * UP // DOWN
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
OUT = "struct<media:binary,payload:binary,tensors:binary,segments:array<struct<start:double,end:double>>,frames:bigint,mean_db:double>"


def padded(payload: bytes) -> bytes:
    return payload + BLANK * ((-len(payload)) % UNIT or (UNIT if not payload else 0))


def wave_of(payload: bytes, rate: int = RATE) -> bytes:
    """Mono, unsigned samples of eight bits."""
    n = len(payload)
    return _HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def samples_of(media: bytes) -> tuple[int, bytes]:
    riff, _, wave, fmt, _, kind, channels, rate, _, _, bits, data, n = _HEADER.unpack_from(media)
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(media) < _HEADER.size + n:
        raise ValueError("not a mono WAVE file of eight-bit samples")
    return rate, media[_HEADER.size : _HEADER.size + n]


@lru_cache(maxsize=1)
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The low-pass filter by phase, the frame window, and the mel filterbank."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    low_pass = np.sinc(n / max(UP, DOWN)) * np.hamming(UP * TAPS)
    low_pass *= UP / low_pass.sum()
    phases = low_pass.reshape(TAPS, UP).T[:, ::-1].astype(np.float32)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(NEW_RATE / 2), MELS + 2) / 2595) - 1)
    at = np.arange(FFT // 2 + 1) * NEW_RATE / FFT
    up = (at[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - at[:, None]) / (edges[2:] - edges[1:-1])
    return phases, np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """len(x) * UP / DOWN samples; output n takes the filter phase n * DOWN mod UP over the inputs up to n * DOWN / UP."""
    phases, _, _ = _filters()
    n = len(x) * UP // DOWN
    reach = sliding_window_view(np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)]), TAPS)
    out = np.empty(n, dtype=np.float32)
    for first in range(min(UP, n)):
        start, phase = divmod(first * DOWN, UP)
        count = (n - first + UP - 1) // UP
        out[first::UP] = reach[start::DOWN][:count] @ phases[phase]
    return out


def log_mels(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and frame energies in decibels."""
    _, window, bank = _filters()
    y = y if len(y) >= FRAME else np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    frames, mels, energy = sliding_window_view(y, FRAME)[::HOP], [], []
    for i in range(0, len(frames), BLOCK_FRAMES):
        some = frames[i : i + BLOCK_FRAMES]
        power = np.abs(np.fft.rfft(some * window, FFT)) ** 2
        mels.append(np.log(power.astype(np.float32) @ bank + FLOOR))
        energy.append(10 * np.log10((some * some).mean(axis=1) + FLOOR))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> np.ndarray:
    """Rows (first frame, frame after the last). Between the limits the state is that of the frame before."""
    about = energy - energy.mean()
    switch = np.where(about > high, 1, np.where(about < low, 0, -1))
    last = np.maximum.accumulate(np.where(switch >= 0, np.arange(len(switch)), -1))
    on = np.where(last >= 0, switch[last], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return edges.reshape(-1, 2)


def tensors_of(mels: np.ndarray) -> bytes:
    """An Arrow IPC stream: tensor (fixed shape, half precision), start and end in seconds."""
    n = -(-len(mels) // TENSOR_FRAMES)
    whole = np.full((n * TENSOR_FRAMES, MELS), np.log(FLOOR), dtype=np.float16)
    whole[: len(mels)] = mels
    start = np.arange(n) * TENSOR_FRAMES
    end = np.minimum(start + TENSOR_FRAMES, len(mels))
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(whole.reshape(n, TENSOR_FRAMES, MELS))
    spans = [pa.array(start * HOP / NEW_RATE), pa.array(((end - 1) * HOP + FRAME) / NEW_RATE)]
    batch = pa.RecordBatch.from_arrays([column, *spans], ["tensor", "start", "end"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The tensors, and their spans."""
    table = pa.ipc.open_stream(stream).read_all()
    return table["tensor"].combine_chunks().to_numpy_ndarray(), np.column_stack([table["start"].to_numpy(), table["end"].to_numpy()])


def analyse(text: str) -> dict:
    media = wave_of(padded(text.encode()))
    _, payload = samples_of(media)
    x = (np.frombuffer(payload, dtype=np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mels(resample(x))
    spans = segments(energy)
    seconds = [{"start": a * HOP / NEW_RATE, "end": ((b - 1) * HOP + FRAME) / NEW_RATE} for a, b in spans.tolist()]
    return {"media": media, "payload": payload, "tensors": tensors_of(mels), "segments": seconds, "frames": len(mels), "mean_db": float(energy.mean())}


def with_audio(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """Add the column __ef_audio, a struct of the kind OUT."""
    seconds = pa.struct([("start", pa.float64()), ("end", pa.float64())])
    kind = pa.struct([("media", pa.binary()), ("payload", pa.binary()), ("tensors", pa.binary()), ("segments", pa.list_(seconds)), ("frames", pa.int64()), ("mean_db", pa.float64())])
    return with_computed(docs, "__ef_audio", OUT, lambda texts: pa.array(list(map(analyse, texts)), kind), text)
