"""IIR filter design with NumPy: Butterworth and Chebyshev filters of the least order for given losses, as second-order sections."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("butter", "cheby1", "cheby2")


@dataclass(frozen=True)
class Preset:
    """Settings of a zero-phase filter; ``fl`` or ``fh`` None leaves that side open."""

    fs: float = 30000.0
    fl: float | None = None
    fh: float | None = None
    gpass: float = 0.1
    gstop: float = 30.0
    buffer_len: int = 1 << 24
    overlap_len: int | None = 1 << 16


SPIKE = Preset(fl=600.0, fh=6000.0)
#: A template: it needs ``fl`` or ``fh``.
LFP = Preset()


def edges(fs: float, fl: float | None, fh: float | None) -> tuple[list[float], list[float], str]:
    """Pass and stop edges as shares of half the sampling rate, and the band: stops lie at 0.8 of ``fl`` and 1.4 of ``fh``."""
    fl = None if fl is None or fl == 0 else fl
    fh = None if fh is None or np.isinf(fh) else fh
    half = fs / 2
    if fl is None and fh is None:
        raise ValueError("a filter needs a lower or an upper edge")
    if fh is not None and 1.4 * fh >= half:
        raise ValueError(f"1.4 * fh must lie below half the sampling rate, {half}")
    if fl is None:
        return [fh / half], [1.4 * fh / half], "low"
    if fh is None:
        return [fl / half], [0.8 * fl / half], "high"
    return [fl / half, fh / half], [0.8 * fl / half, 1.4 * fh / half], "band"


def _prototype(kind: str, n: int, gpass: float, gstop: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the analogue low-pass filter: edge 1 is the pass edge (cheby2: the stop edge)."""
    m = np.arange(-n + 1, n, 2)
    circle = -np.exp(1j * np.pi * m / (2 * n))
    if kind == "butter":
        return np.array([]), circle, 1.0
    if kind == "cheby1":
        eps = np.sqrt(10 ** (gpass / 10) - 1)
        mu = np.arcsinh(1 / eps) / n
        p = np.sinh(mu) * circle.real + 1j * np.cosh(mu) * circle.imag
        k = np.prod(-p).real
        return np.array([]), p, k / np.sqrt(1 + eps**2) if n % 2 == 0 else k
    z = 1j / np.sin(m[m != 0] * np.pi / (2 * n))
    mu = np.arcsinh(np.sqrt(10 ** (gstop / 10) - 1)) / n
    p = 1 / (np.sinh(mu) * circle.real + 1j * np.cosh(mu) * circle.imag)
    return z, p, (np.prod(-p) / np.prod(-z)).real


def _to_band(z: np.ndarray, p: np.ndarray, k: float, band: str, w: list[float]) -> tuple[np.ndarray, np.ndarray, float]:
    degree = len(p) - len(z)
    if band == "low":
        return z * w[0], p * w[0], k * w[0] ** degree
    if band == "high":
        gain = k * (np.prod(-z) / np.prod(-p)).real
        return np.append(w[0] / z, np.zeros(degree)), w[0] / p, gain
    bw, w0 = w[1] - w[0], np.sqrt(w[0] * w[1])

    def two(x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, complex) * bw / 2
        root = np.sqrt(x**2 - w0**2)
        return np.concatenate([x + root, x - root])

    return np.append(two(z), np.zeros(degree)), two(p), k * bw**degree


def _digital(z: np.ndarray, p: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray, float]:
    degree = len(p) - len(z)
    gain = k * (np.prod(1 - np.asarray(z, complex)) / np.prod(1 - p)).real
    return np.append((1 + z) / (1 - z), -np.ones(degree)), (1 + p) / (1 - p), gain


def _pairs(x: np.ndarray) -> list[np.ndarray]:
    """Conjugates together, then real values two by two; a last one stands alone."""
    x = np.asarray(x, complex)
    upper = x[x.imag > 1e-12 * np.maximum(1, np.abs(x))]
    real = np.sort(x[np.abs(x.imag) <= 1e-12 * np.maximum(1, np.abs(x))].real)
    return [np.array([c, np.conj(c)]) for c in upper] + [real[i : i + 2].astype(complex) for i in range(0, len(real), 2)]


def sections(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    """Second-order sections: poles nearest the unit circle take the zeros nearest to them and come last."""
    poles = sorted(_pairs(p), key=lambda c: abs(1 - np.abs(c).max()))
    zeros = _pairs(z)
    out = []
    for pair in poles:
        fits = [c for c in zeros if len(c) == len(pair)] or zeros
        at = min(fits, key=lambda c: abs(c[0] - pair[0])) if fits else None
        if at is not None:
            zeros = [c for c in zeros if c is not at]
        b, a = np.poly(at).real if at is not None else np.ones(1), np.poly(pair).real
        out.append(np.concatenate([np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))]))
    out = out[::-1]
    out[0][:3] *= k
    return np.array(out)


def design(wp: list[float], ws: list[float], band: str, gpass: float = 0.1, gstop: float = 30.0, kind: str = "cheby2") -> np.ndarray:
    """Sections of the filter of least order with at most ``gpass`` dB loss at ``wp`` and at least ``gstop`` dB at ``ws``."""
    if kind not in KINDS:
        raise ValueError(f"{kind} filters have no least order here; known: {', '.join(KINDS)}")
    P, S = np.tan(np.pi * np.array(wp) / 2), np.tan(np.pi * np.array(ws) / 2)
    if band == "low":
        nat = S[0] / P[0]
    elif band == "high":
        nat = P[0] / S[0]
    else:
        nat = np.abs((S**2 - P[0] * P[1]) / (S * (P[1] - P[0]))).min()
    ratio = (10 ** (gstop / 10) - 1) / (10 ** (gpass / 10) - 1)
    if kind == "butter":
        n = int(np.ceil(np.log10(ratio) / (2 * np.log10(nat))))
        scale = (10 ** (gpass / 10) - 1) ** (-1 / (2 * n))  # edge at which the loss is 3 dB
    else:
        v = np.arccosh(np.sqrt(ratio))
        n = int(np.ceil(v / np.arccosh(nat)))
        scale = np.cosh(v / n) if kind == "cheby2" else 1.0
    if band == "low":
        w = [P[0] * scale]
    elif band == "high":
        w = [P[0] / scale]
    else:
        half, mid = scale * (P[1] - P[0]) / 2, P[0] * P[1]
        w = [-half + np.sqrt(half**2 + mid), half + np.sqrt(half**2 + mid)]
    return sections(*_digital(*_to_band(*_prototype(kind, n, gpass, gstop), band, w)))


def butter_band(low: float, high: float, rate: float, poles: int = 3) -> np.ndarray:
    """Sections of a band-pass Butterworth filter of given order; ``high`` is held below half the rate."""
    high = min(high, rate / 2 - 1)
    w = np.tan(np.pi * np.array([low, high]) / rate)
    return sections(*_digital(*_to_band(*_prototype("butter", poles, 0, 0), "band", list(w))))


def response(sos: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Complex response at angular frequencies ``w`` (radians a sample)."""
    x = np.exp(-1j * np.asarray(w))
    out = np.ones(len(x), complex)
    for s in sos:
        out *= (s[0] + s[1] * x + s[2] * x**2) / (s[3] + s[4] * x + s[5] * x**2)
    return out


def settle_length(sos: np.ndarray, tol: float = 1e-6) -> int:
    """Samples after which the slowest pole has decayed to ``tol``."""
    r = max(np.abs(np.roots(s[3:])).max(initial=0) for s in sos)
    return int(np.ceil(np.log(tol) / np.log(r))) if 0 < r < 1 else 0
