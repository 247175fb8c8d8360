import io
import math
import wave

import numpy as np
import pytest

from emberfold.llm import audio as A


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000])
def test_payload_round_trip(n):
    data = bytes(i % 256 for i in range(n))
    padded = A.padded(data)
    assert len(padded) % 192 == 0 and len(padded) > 0 and len(padded) - n < 192 + (n == 0) and padded[n:] == b" " * (len(padded) - n)
    media = A.wave_of(padded)
    assert A.samples_of(media) == (A.RATE, padded)
    with wave.open(io.BytesIO(media)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(len(padded))) == (1, 1, A.RATE, padded)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        A.samples_of(b"x" * 60)


def test_resampling_matches_its_definition():
    rng = np.random.default_rng(1)
    x = rng.normal(size=384).astype(np.float32)
    phases, _, _ = A._filters()
    taps = phases[:, ::-1].T.reshape(-1)  # the whole low-pass filter
    up = np.zeros(len(x) * A.UP)
    up[:: A.UP] = x
    want = np.convolve(up, taps)[: len(up) : A.DOWN]
    assert np.allclose(A.resample(x), want, atol=1e-4)


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / A.RATE
    y = A.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(y) == 6000 and np.argmax(np.abs(np.fft.rfft(y))) == 440


def test_segments_by_hysteresis():
    e = np.array([0, 0, 5, 1.2, 1.2, 0, 5, 0, 1.2, 0.0])
    state, want = False, []
    about = e - e.mean()
    for x in about:
        state = True if x > A.HIGH_DB else False if x < A.LOW_DB else state
        want.append(state)
    got = np.zeros(len(e), dtype=bool)
    for a, b in A.segments(e):
        got[a:b] = True
    assert got.tolist() == want


def test_tensors_have_one_shape_and_spans():
    mels, _ = A.log_mels(A.resample(np.zeros(19_200, np.float32)))
    tensors, spans = A.read_tensors(A.tensors_of(mels))
    assert tensors.shape[1:] == (A.TENSOR_FRAMES, A.MELS) and len(tensors) == -(-len(mels) // A.TENSOR_FRAMES)
    assert np.allclose(tensors.reshape(-1, A.MELS)[: len(mels)], mels, atol=0.02)
    assert (spans[:, 1] > spans[:, 0]).all() and (np.diff(spans[:, 0]) > 0).all()


def test_odd_documents(odd_docs, no_docs):
    seen = {}
    for r in A.with_audio(odd_docs).collect():
        a, text = r["__ef_audio"], (r["text"] or "").encode()
        assert a["payload"] == A.padded(text) and A.samples_of(a["media"])[1] == a["payload"]
        assert seen.setdefault(text, a) == a
    assert A.with_audio(no_docs).count() == 0


def slow_mels(n, rate, size):
    """Triangles on the mel scale, from their definition."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    back = lambda m: 700 * (10 ** (m / 2595) - 1)
    top = mel(rate / 2)
    points = [back(top * i / (n + 1)) for i in range(n + 2)]
    bins = np.arange(size // 2 + 1) * rate / size
    out = np.zeros((n, len(bins)))
    for i in range(n):
        low, middle, high = points[i : i + 3]
        for j, f in enumerate(bins):
            if low < f < high:
                out[i, j] = (f - low) / (middle - low) if f <= middle else (high - f) / (high - middle)
    return out


def test_log_mels_match_their_definition():
    rng = np.random.default_rng(12)
    y = rng.normal(size=700).astype(np.float32)
    mels, _ = A.log_mels(y)
    bank = slow_mels(A.MELS, A.NEW_RATE, A.FFT)
    assert A._filters()[2].T == pytest.approx(bank, abs=1e-4)
    window = A._filters()[1]
    for i in (0, 3, len(mels) - 1):
        frame = np.zeros(A.FFT)
        frame[: A.FRAME] = y[i * A.HOP : i * A.HOP + A.FRAME] * window
        k = np.arange(A.FFT // 2 + 1)
        spectrum = np.exp(-2j * np.pi * np.outer(k, np.arange(A.FFT)) / A.FFT) @ frame
        assert mels[i] == pytest.approx(np.log(bank @ np.abs(spectrum) ** 2 + A.FLOOR), abs=1e-3)
