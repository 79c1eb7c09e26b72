"""Waveform kernels on arrays, and the frames that apply them by Arrow batch: one row is one waveform."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Half the taps of a fractional delay beside the middle one, and the shape of its Kaiser window.
HALF, BETA = 16, 6.0


class SignalError(ValueError):
    """A waveform or response that a kernel can't take."""


def _wave(x, least: int = 1) -> np.ndarray:
    x = np.asarray(x, float)
    if x.ndim != 1 or len(x) < least or not np.isfinite(x).all():
        raise SignalError(f"needs one dimension of at least {least} finite samples")
    return x


def fast_length(n: int) -> int:
    """The power of two from n on."""
    return 1 << max(0, int(n - 1).bit_length())


def hann(n: int) -> np.ndarray:
    """Periodic."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def impulse_response(delays, amplitudes, rate: float, seconds: float, origin: float = 0.0, fractional: bool = True) -> np.ndarray:
    """The sum of impulses; a fractional delay spreads over 33 taps of a windowed sinc. What falls outside is cut off."""
    n = max(1, round(seconds * rate))
    at = (np.asarray(delays, float) - origin) * rate
    amp = np.asarray(amplitudes, float)
    if fractional:
        base = np.floor(at)
        taps = np.arange(-HALF, HALF + 1)
        index = base[:, None].astype(np.int64) + taps
        values = amp[:, None] * np.sinc(taps - (at - base)[:, None]) * np.kaiser(2 * HALF + 1, BETA)
    else:
        index, values = np.rint(at).astype(np.int64), amp
    inside = (index >= 0) & (index < n)
    return np.bincount(index[inside], values[inside], minlength=n)


def convolve(wave, response) -> np.ndarray:
    """As long as the wave; an empty or all-zero response is an error, not silence."""
    wave, response = _wave(wave), _wave(response)
    if not response.any():
        raise SignalError("the response is zero")
    n = fast_length(len(wave) + len(response) - 1)
    return np.fft.irfft(np.fft.rfft(wave, n) * np.fft.rfft(response, n), n)[: len(wave)]


def convolve_by_frequency(wave, frequencies, responses, rate: float) -> np.ndarray:
    """Each bin's response lies linearly between those of the solved frequencies around it; beyond them, the nearest one's."""
    wave = _wave(wave)
    responses = [_wave(r) for r in responses]
    if not responses:
        raise SignalError("no responses")
    order = np.argsort(frequencies, kind="stable")
    f = np.asarray(frequencies, float)[order]
    n = fast_length(len(wave) + max(map(len, responses)) - 1)
    bins = np.fft.rfftfreq(n, 1 / rate)
    spectra = np.stack([np.fft.rfft(responses[k], n) for k in order])
    # np.interp is clamped at both ends
    mixed = sum(np.interp(bins, f, np.eye(len(f))[k]) * spectra[k] for k in range(len(f))) if len(f) > 1 else spectra[0]
    return np.fft.irfft(np.fft.rfft(wave, n) * mixed, n)[: len(wave)]


def _one_sided(power: np.ndarray, nfft: int) -> np.ndarray:
    power[..., 1 : nfft // 2 if nfft % 2 == 0 else None] *= 2
    return power


def spectrogram(wave, rate: float, length: int, hop: int, nfft: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Frequencies, times, one-sided power [time, frequency] and equivalent noise bandwidth; zeros stand before and behind the wave."""
    wave = _wave(wave, length)
    nfft, window, half = nfft or length, hann(length), length // 2
    padded = np.concatenate([np.zeros(half), wave, np.zeros(half)])
    padded = np.concatenate([padded, np.zeros(-(len(padded) - length) % hop)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, length)[::hop]
    power = _one_sided(np.abs(np.fft.rfft(frames * window / window.sum(), nfft)) ** 2, nfft)
    times = np.arange(len(frames)) * hop / rate + (half + (length % 2) / 2 - length / 2) / rate
    keep = times <= len(wave) / rate + 1e-12
    return np.fft.rfftfreq(nfft, 1 / rate), times[keep], power[keep], float(rate * (window**2).sum() / window.sum() ** 2)


def welch(wave, rate: float, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean power density of half-overlapping frames, each without its mean."""
    length = length or min(int(rate), len(wave))
    wave, window = _wave(wave, max(8, length)), hann(length)
    frames = np.lib.stride_tricks.sliding_window_view(wave, length)[:: length - length // 2]
    frames = frames - frames.mean(1, keepdims=True)
    power = _one_sided(np.abs(np.fft.rfft(frames * window)) ** 2 / (rate * (window**2).sum()), length)
    return np.fft.rfftfreq(length, 1 / rate), power.mean(0)


def band_centroid(frequencies, density, top: float) -> float:
    """Mean frequency up to top, weighted by density; silence is an error."""
    f, p = _wave(frequencies, 2), _wave(density, 2)
    step = np.diff(f)
    if f[0] != 0 or f[-1] < top or step[0] <= 0 or not np.allclose(step, step[0], rtol=1e-10, atol=1e-12) or (p < 0).any():
        raise SignalError("needs evenly spaced bins from 0 over the band, with no negative density")
    p = np.where(f <= top, p, 0)
    if not p.sum() > 0:
        raise SignalError("no power in the band")
    return float((f * p).sum() / p.sum())


def decibels(power, reference: float, floor: float = -60.0) -> np.ndarray:
    return 10 * np.log10(np.maximum(np.asarray(power, float) / reference, 10 ** (floor / 10)))


def apply(df: DataFrame, key: str, value: str, kernel: Callable[[np.ndarray], object], kind: str) -> DataFrame:
    """key, result, error: kernel(value) of each row; what it refuses, or a null value, gives a null result and says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, said = [], []
            for v in b[value]:
                try:
                    if v is None:
                        raise SignalError("null")
                    out.append(kernel(np.asarray(v, float)))
                    said.append(None)
                except SignalError as e:
                    out.append(None)
                    said.append(str(e))
            yield pd.DataFrame({key: b[key], "result": out, "error": said})

    return df.select(key, value).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, result {kind}, error string")
