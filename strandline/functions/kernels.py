"""NumPy kernels on one bounded group: filters, spectra, small solvers and prefix codes.

Each takes and returns arrays of one series, trace or batch; Spark deals the groups out.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np


def lowpass_coefficients(cutoff: float, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(b, a) of the sections of a Butterworth low-pass; ``cutoff`` is a share of the sampling rate, below 0.5.

    The poles lie evenly on a circle; the bilinear transform takes them to discrete time.
    """
    w = 2 * np.tan(np.pi * cutoff)
    sections = []
    for k in range((order + 1) // 2):
        pole = w * np.exp(1j * np.pi * (2 * k + 1 + order) / (2 * order))
        alone = order % 2 and k == order // 2
        poles = [pole.real] if alone else [pole, pole.conjugate()]
        a, b = np.ones(1), np.ones(1)
        for p in poles:
            a, b = np.convolve(a, [1, -((2 + p) / (2 - p))]), np.convolve(b, [1, 1])
        a = a.real
        sections.append((b * a.sum() / b.sum(), a))
    return sections


def recursive(v: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One section in transposed form, and the state for the block after; without a state it starts from a steady first value."""
    n = len(a) - 1
    if state is None:
        state = np.array([sum(b[k + 1 :]) - sum(a[k + 1 :]) for k in range(n)]) * (v[0] if len(v) else 0.0)
    z, out = np.append(state, 0.0), np.empty(len(v))
    for i, x in enumerate(v):
        y = b[0] * x + z[0]
        z[:n] = z[1:] + b[1:] * x - a[1:] * y
        out[i] = y
    return out, z[:n]


def zero_phase(v: np.ndarray, cutoff: float, order: int = 5) -> np.ndarray:
    """Forward and backward low-pass, the ends continued as odd mirror images."""
    pad = min(3 * (order + 1), len(v) - 1)
    if pad < 1:
        return v.copy()
    wide = np.concatenate((2 * v[0] - v[pad:0:-1], v, 2 * v[-1] - v[-2 : -pad - 2 : -1]))
    for _ in range(2):
        for b, a in lowpass_coefficients(cutoff, order):
            wide = recursive(wide, b, a)[0]
        wide = wide[::-1]
    return wide[pad : pad + len(v)]


def analytic(v: np.ndarray) -> np.ndarray:
    """The signal with its Hilbert transform as imaginary part: positive frequencies twice, negative ones dropped."""
    n = len(v)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(v) * gain)


def rotate_phase(v: np.ndarray, phase: float) -> np.ndarray:
    spectrum = np.fft.rfft(v)
    spectrum[1:] *= np.exp(1j * phase)
    return np.fft.irfft(spectrum, len(v))


def spectral_lowpass(v: np.ndarray, bins: int) -> np.ndarray:
    spectrum = np.fft.rfft(v)
    spectrum[bins:] = 0
    return np.fft.irfft(spectrum, len(v))


def fourier_resample(v: np.ndarray, length: int) -> np.ndarray:
    spectrum = np.fft.rfft(v)
    kept = np.zeros(length // 2 + 1, complex)
    n = min(len(spectrum), len(kept))
    kept[:n] = spectrum[:n]
    return np.fft.irfft(kept, length) * length / len(v)


def haar_packet(v: np.ndarray, levels: int) -> np.ndarray:
    """Energies of the bands of a Haar wavelet packet, in natural order."""
    bands = [v[: len(v) >> levels << levels]]
    for _ in range(levels):
        bands = [(b[::2] + s * b[1::2]) / np.sqrt(2) for b in bands for s in (1, -1)]
    return np.array([(b**2).sum() for b in bands])


def gaussian_smooth(v: np.ndarray, sigma: float) -> np.ndarray:
    half = int(3 * sigma)
    weight = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    mass = np.convolve(np.ones(len(v)), weight)[half : half + len(v)]
    return np.convolve(v, weight)[half : half + len(v)] / mass


def low_rank(m: np.ndarray, rank: int) -> np.ndarray:
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    return (u[:, :rank] * s[:rank]) @ vt[:rank]


def krige(at: np.ndarray, samples: np.ndarray, values: np.ndarray, variogram: Callable, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Ordinary kriging: weights that sum to one from the variogram of all distances; values and standard deviations."""
    n = len(samples)
    far = lambda a, b: np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    left = np.ones((n + 1, n + 1))
    left[:n, :n] = variogram(far(samples, samples)) + ridge * np.eye(n)
    left[n, n] = 0
    right = np.vstack((variogram(far(samples, at)), np.ones(len(at))))
    weight = np.linalg.solve(left, right)
    return weight[:n].T @ values, np.sqrt(np.maximum(0.0, (weight * right).sum(axis=0)))


def smooth_polynomial(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    return np.polynomial.Polynomial.fit(x, y, min(degree, len(x) - 1))(x)


def fista(h: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 100) -> np.ndarray:
    """Sparse x with small |hx - y|: gradient steps, soft threshold, momentum."""
    bound = np.linalg.norm(h, 2) ** 2
    x = look = np.zeros(h.shape[1])
    momentum = 1.0
    for _ in range(rounds):
        step = look - h.T @ (h @ look - y) / bound
        new = np.sign(step) * np.maximum(np.abs(step) - 0.5 * penalty / bound, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look, x, momentum = new + (momentum - 1) / after * (new - x), new, after
    return x


def matching_pursuit(h: np.ndarray, y: np.ndarray, atoms: int) -> np.ndarray:
    """Orthogonal matching pursuit: the atom of largest correlation, then a refit of all chosen."""
    chosen: list[int] = []
    rest, x = y.copy(), np.zeros(h.shape[1])
    for _ in range(atoms):
        best = int(np.argmax(np.abs(h.T @ rest)))
        if best in chosen:
            break
        chosen.append(best)
        fit = np.linalg.lstsq(h[:, chosen], y, rcond=None)[0]
        rest = y - h[:, chosen] @ fit
    if chosen:
        x[chosen] = fit
    return x


def block_weights(at: np.ndarray, samples: np.ndarray, reach: float, nugget: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (at, samples) that add up to one, and standard deviations, for all of ``at`` at once.

    The covariance falls as a Gaussian of ``reach``; ``nugget`` on its diagonal keeps the system well posed.
    """
    near = lambda a, b: np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2) / reach**2)
    n = len(samples)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = near(samples, samples) + nugget * np.eye(n)
    system[n, n] = 0
    right = np.vstack([near(samples, at), np.ones(len(at))])
    solved = np.linalg.solve(system, right)
    variance = 1 + nugget - (solved * right).sum(axis=0)
    return solved[:n].T, np.sqrt(np.maximum(0.0, variance))


def total_least_squares_parabola(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """(c0, c1, c2) of z = c0 + c1 x + c2 x^2 from the least right singular vector of [1 x x^2 z]."""
    v = np.linalg.svd(np.column_stack((np.ones(len(x)), x, x**2, z)), full_matrices=False)[2][-1]
    return -v[:3] / v[3]


def newton(x: np.ndarray, gradient: Callable, curvature: Callable, rounds: int = 20, small: float = 1e-6) -> np.ndarray:
    """Diagonal Newton steps until none exceeds ``small``."""
    for _ in range(rounds):
        step = gradient(x) / curvature(x)
        x = x - step
        if np.abs(step).max() <= small:
            break
    return x


def quasi_newton(x: np.ndarray, f: Callable, gradient: Callable, rounds: int = 100, small: float = 1e-8) -> np.ndarray:
    """Minimum by the rank-two update of the inverse curvature, with halving line search."""
    inverse, g = np.eye(len(x)), gradient(x)
    for _ in range(rounds):
        if np.abs(g).max() <= small:
            break
        way, t = -inverse @ g, 1.0
        while f(x + t * way) > f(x) + 1e-4 * t * (g @ way) and t > 1e-10:
            t /= 2
        step = t * way
        turned = gradient(x + step) - g
        x, g = x + step, g + turned
        along = step @ turned
        if along > 1e-14:
            part = np.eye(len(x)) - np.outer(step, turned) / along
            inverse = part @ inverse @ part.T + np.outer(step, step) / along
    return x


def bisect(f: Callable, low: float, high: float, target: float = 1e-9) -> float:
    """A zero between ``low`` and ``high``, whose signs must differ."""
    if f(low) * f(high) > 0:
        raise ValueError("no change of sign")
    while True:
        middle = (low + high) / 2
        if abs(f(middle)) <= target or high - low < 1e-15:
            return middle
        low, high = (middle, high) if f(low) * f(middle) > 0 else (low, middle)


def zero_forcing(h: np.ndarray, noise: float = 0.0) -> np.ndarray:
    """Beamforming weights, one unit column for each user: the regularised inverse of the channel."""
    w = h.conj().T @ np.linalg.inv(h @ h.conj().T + noise * np.eye(len(h)))
    return w / np.linalg.norm(w, axis=0)


def prefix_code(counts: dict[str, int]) -> dict[str, str]:
    """A Huffman code; equal counts merge by symbol, so the code is the same on every run. One symbol alone gets "0"."""
    heap = [(n, s, {s: ""}) for s, n in counts.items()]
    heapq.heapify(heap)
    if len(heap) == 1:
        return {heap[0][1]: "0"}
    while len(heap) > 1:
        (n, s, zero), (m, t, one) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (n + m, min(s, t), {k: "0" + c for k, c in zero.items()} | {k: "1" + c for k, c in one.items()}))
    return heap[0][2] if heap else {}


def decode_prefix(bits: str, code: dict[str, str]) -> str:
    back, out, at = {c: s for s, c in code.items()}, [], ""
    for bit in bits:
        at += bit
        if at in back:
            out.append(back[at])
            at = ""
    return "".join(out)
