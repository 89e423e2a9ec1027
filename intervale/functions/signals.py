"""Signal kernels on rows of samples (numpy), run inside tasks on batches of segments."""

from __future__ import annotations

import numpy as np


def butterworth(order: int, low: float, high: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Band-pass coefficients (b, a) by the bilinear transform of the analogue prototype; 0 < low < high < rate / 2."""
    if not 0 < low < high < rate / 2:
        raise ValueError(f"band {low} to {high} is not inside 0 to {rate / 2}")
    warp = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, centre2 = warp[1] - warp[0], warp[0] * warp[1]
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * width / 2
    root = np.sqrt(half**2 - centre2 + 0j)
    poles = np.concatenate([half + root, half - root])
    digital = (2 * rate + poles) / (2 * rate - poles)
    zeros = np.concatenate([np.ones(order), -np.ones(order)])
    gain = width**order * (2 * rate) ** order / np.prod(2 * rate - poles)
    return (np.poly(zeros) * gain).real, np.poly(digital).real


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The recursive filter along the rows of ``x``, from ``state`` (rows x order)."""
    out, z = np.empty_like(x), state.copy()
    b, a = b / a[0], a / a[0]
    for i in range(x.shape[1]):
        out[:, i] = b[0] * x[:, i] + z[:, 0]
        z[:, :-1] = z[:, 1:] + np.outer(x[:, i], b[1:-1]) - np.outer(out[:, i], a[1:-1])
        z[:, -1] = b[-1] * x[:, i] - a[-1] * out[:, i]
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd reflections at both ends and steady starting states."""
    order = max(len(a), len(b)) - 1
    pad = min(3 * (order + 1), x.shape[1] - 1)
    wide = np.hstack([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]])
    companion = np.zeros((order, order))
    companion[:, 0] = -a[1:] / a[0]
    companion[:-1, 1:] = np.eye(order - 1)
    steady = np.linalg.solve(np.eye(order) - companion, b[1:] / a[0] - a[1:] / a[0] * b[0] / a[0])
    once = filtered(b, a, wide, np.outer(wide[:, 0], steady))[:, ::-1]
    return filtered(b, a, once, np.outer(once[:, 0], steady))[:, ::-1][:, pad : pad + x.shape[1]]


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal of each row."""
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1)


def band(x: np.ndarray, low: float, high: float, rate: float, order: int = 4) -> np.ndarray:
    """The analytic signal of the band-passed rows."""
    return analytic(zero_phase(*butterworth(order, low, high, rate), x))


def notch(frequency: float, quality: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a second-order notch."""
    w = 2 * np.pi * frequency / rate
    gain = 1 / (1 + np.tan(w / (2 * quality)))
    return gain * np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * gain * np.cos(w), 2 * gain - 1])


def without_line(x: np.ndarray, line: float, rate: float, quality: float = 30.0) -> np.ndarray:
    """Rows without a line frequency and its harmonics below half the rate."""
    for k in range(1, int((rate / 2 - 1e-9) // line) + 1):
        x = zero_phase(*notch(k * line, quality, rate), x)
    return x


def spectrogram(x: np.ndarray, size: int, step: int) -> np.ndarray:
    """Power (rows x windows x frequencies) of Hann windows."""
    starts = range(0, x.shape[1] - size + 1, step)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = np.stack([x[:, s : s + size] for s in starts], axis=1)
    parts = parts - parts.mean(axis=2, keepdims=True)
    return np.abs(np.fft.rfft(parts * w, axis=2)) ** 2 / (w**2).sum()


def wavelet_power(x: np.ndarray, frequencies: np.ndarray, rate: float, cycles: float = 5.0, real: bool = True) -> np.ndarray:
    """Power (rows x frequencies x samples) by Morlet wavelets; a real wavelet's power swings within each cycle."""
    n = x.shape[1]
    spectrum = np.fft.fft(x, 2 * n, axis=1)
    out = np.empty((len(x), len(frequencies), n))
    for i, f in enumerate(frequencies):
        t = (np.arange(2 * n) - n) / rate
        shape = np.exp(2j * np.pi * f * t) * np.exp(-0.5 * (t * 2 * np.pi * f / cycles) ** 2) * np.sqrt(f / rate)
        found = np.fft.ifft(spectrum * np.fft.fft(np.fft.ifftshift(shape.real if real else shape)), axis=1)[:, :n]
        out[:, i] = np.abs(found) ** 2
    return out


def coupling(phase: np.ndarray, amplitude: np.ndarray, bins: int = 18) -> np.ndarray:
    """Modulation index of each row's amplitude by its phase."""
    k = np.minimum(((phase % (2 * np.pi)) / (2 * np.pi / bins)).astype(int), bins - 1)
    rows = np.repeat(np.arange(len(k)), k.shape[1])
    total = np.bincount(rows * bins + k.ravel(), weights=amplitude.ravel(), minlength=len(k) * bins).reshape(-1, bins)
    count = np.bincount(rows * bins + k.ravel(), minlength=len(k) * bins).reshape(-1, bins)
    mean = np.where(count > 0, total / np.maximum(count, 1), 0)
    p = mean / np.maximum(mean.sum(axis=1, keepdims=True), 1e-300)
    return (p * np.log((p + 1e-10) / (1 / bins + 1e-10))).sum(axis=1) / np.log(bins)
