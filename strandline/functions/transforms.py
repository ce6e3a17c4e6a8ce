"""NumPy kernels of transforms and fits on one bounded group: filter bank, wavelets, components, variogram fit, tracking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Earlier blocks that a block of the filter bank depends on: a delay and two lifts.
MEMORY = 3


@dataclass(frozen=True)
class LowDelayBank:
    """A low-delay cosine-modulated filter bank of ``size`` bands: fold, half a block of delay, two lifts, DCT-IV.

    ``outer``, ``inner`` and ``cross`` are three of the four weights of the fold, half a
    block each; the fourth makes the determinant -1. ``lifts`` holds the weights of the
    lifts. Both directions take blocks as rows and treat what lies before the first as
    zero, so a run over MEMORY blocks and one more gives the last of them exactly.
    """

    outer: np.ndarray
    inner: np.ndarray
    cross: np.ndarray
    lifts: tuple[np.ndarray, ...]

    @classmethod
    def sine(cls, size: int, lift: float = 0.1) -> LowDelayBank:
        """Fold weights of the sine window and even lifts."""
        window = np.sin(np.pi / (2 * size) * (np.arange(3 * size // 2) + 0.5))
        half = size // 2
        return cls(window[:half], window[half:size], window[size:], (np.full(half, lift), np.full(half, -lift)))

    def _pairs(self) -> np.ndarray:
        """The fold as one 2 x 2 matrix for each pair of samples that meet: (mirrored first half, second half)."""
        a, c = self.outer[::-1], self.cross[::-1]
        return np.array([[a, self.inner], [c, (self.inner * c - 1) / a]]).transpose(2, 0, 1)

    def _fold(self, x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        half = x.shape[1] // 2
        return np.einsum("pij,bpj->bpi", pairs, np.stack((x[:, half - 1 :: -1], x[:, half:]), axis=2))

    def analyse(self, x: np.ndarray) -> np.ndarray:
        both = self._fold(x, self._pairs())
        y = np.hstack((earlier(both[:, :, 0]), both[:, ::-1, 1]))
        for weights in self.lifts:
            y = lift(y, weights)
        return y @ cosines(x.shape[1])

    def synthesise(self, y: np.ndarray) -> np.ndarray:
        """The blocks again, one block late."""
        n, half = y.shape[1], y.shape[1] // 2
        x = y @ cosines(n) * 2 / n
        for weights in self.lifts[::-1]:
            x = unlift(x, weights)
        pairs = np.stack((x[:, :half], earlier(x[:, half:])[:, ::-1]), axis=2)
        both = np.einsum("pij,bpj->bpi", np.linalg.inv(self._pairs()), pairs)
        return np.hstack((both[:, ::-1, 0], both[:, :, 1]))


def earlier(x: np.ndarray) -> np.ndarray:
    """Every block's predecessor; zeros before the first."""
    return np.vstack((np.zeros_like(x[:1]), x[:-1]))


def lift(x: np.ndarray, weights: np.ndarray, late: bool = False) -> np.ndarray:
    """Mirrors the block and adds a weighted half of the block before; ``late`` mirrors the one before and adds of this one."""
    half = x.shape[1] // 2
    mirrored, added = (earlier(x), x) if late else (x, earlier(x))
    y = mirrored[:, ::-1].copy()
    y[:, :half] += added[:, :half] * weights
    return y


def unlift(y: np.ndarray, weights: np.ndarray, late: bool = False) -> np.ndarray:
    """Undoes lift(); a late one comes back two blocks late."""
    return lift(y[:, ::-1], -weights, late)[:, ::-1]


def cosines(n: int) -> np.ndarray:
    """The DCT-IV, its own inverse but for the factor n / 2."""
    at = np.arange(n) + 0.5
    return np.cos(np.pi / n * at[:, None] * at)


def morlet(v: np.ndarray, widths: np.ndarray, w: float = 5.0) -> np.ndarray:
    """Continuous wavelet transform [width, sample] by complex Morlet wavelets of unit energy."""
    out = np.empty((len(widths), len(v)), complex)
    for i, width in enumerate(widths):
        half = int(min(5 * width, (len(v) - 1) / 2))
        t = np.arange(-half, half + 1) / width
        out[i] = np.convolve(v, np.exp(1j * w * t - t**2 / 2) / (np.pi**0.25 * np.sqrt(width)), "same")
    return out


def daubechies_packet(v: np.ndarray, levels: int) -> np.ndarray:
    """Energies of the bands of a wavelet packet by the four-tap Daubechies filter, ends joined; natural order."""
    r = np.sqrt(3)
    low = np.array([1 + r, 3 + r, 3 - r, 1 - r]) / (4 * np.sqrt(2))
    high = low[::-1] * [1, -1, 1, -1]
    bands = [v[: len(v) >> levels << levels]]
    for _ in range(levels):
        bands = [sum(f[k] * np.roll(b, -k) for k in range(4))[::2] for b in bands for f in (low, high)]
    return np.array([(b**2).sum() for b in bands])


def independent(x: np.ndarray, components: int, rounds: int = 200, small: float = 1e-9) -> np.ndarray:
    """Independent components [sample, component] of the columns of ``x``, unit variance, by the symmetric fixed point on tanh.

    The start is the identity, and a component's largest swing is positive, so reruns agree.
    """
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    kept = min(components, int((s > 1e-10 * max(s[0], 1e-300)).sum()))
    z = u[:, :kept] * np.sqrt(len(x))
    w = np.eye(kept)
    for _ in range(rounds if kept else 0):
        g = np.tanh(z @ w.T)
        new = g.T @ z / len(z) - (1 - g**2).mean(axis=0)[:, None] * w
        left, _, right = np.linalg.svd(new)
        turned = left @ right
        done = np.abs(np.abs((turned * w).sum(axis=1)) - 1).max() < small
        w = turned
        if done:
            break
    out = z @ w.T
    return out * np.where(out.max(axis=0) >= -out.min(axis=0), 1, -1) if kept else np.zeros((len(x), 1))


def denoise_cycles(v: np.ndarray, cycles: int = 3) -> np.ndarray:
    """The first of two independent components of successive cycles as channels, its largest modulus one."""
    n = len(v) // cycles
    v = v - v.mean()
    if n < 2 or not np.abs(v).max():
        return np.zeros(n)
    out = independent((v[: n * cycles] / np.abs(v).max()).reshape(cycles, n).T, 2)[:, 0]
    peak = np.abs(out).max()
    return out / peak if peak else out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def fit_gaussian_variogram(places: np.ndarray, values: np.ndarray, bins: int, reach: float) -> tuple[float, float, float]:
    """(nugget, sill above it, range): least squares over the mean half squared differences of equal bins of distance.

    The range is the best of a ladder; for each, nugget and sill are linear and held at zero or above.
    """
    i, j = np.triu_indices(len(places), 1)
    h, half = distances(places, places)[i, j], 0.5 * (values[i] - values[j]) ** 2
    which = np.minimum((h / reach * bins).astype(int), bins)
    n = np.bincount(which, minlength=bins + 1)[:bins]
    used = n > 0
    lag, gamma = (np.bincount(which, x, minlength=bins + 1)[:bins][used] / n[used] for x in (h, half))
    best = (np.inf, 0.0, float(values.var()), reach / 2)
    for span in reach * np.linspace(0.1, 1.5, 29):
        shape = 1 - np.exp(-((lag / span) ** 2))
        for columns in ((np.ones_like(lag), shape), (shape,)):
            a = np.column_stack(columns) * np.sqrt(n[used])[:, None]
            x = np.linalg.lstsq(a, gamma * np.sqrt(n[used]), rcond=None)[0]
            loss = float(((a @ x - gamma * np.sqrt(n[used])) ** 2).sum())
            if (x >= 0).all() and loss < best[0]:
                best = (loss, float(x[0]) if len(x) == 2 else 0.0, float(x[-1]), float(span))
    return best[1:]


def inverse_distance(at: np.ndarray, places: np.ndarray, values: np.ndarray, reach: float) -> np.ndarray:
    """Mean of the samples within ``reach`` by inverse distance; a sample's own place keeps its value, none near gives zero."""
    d = distances(at, places)
    weight = np.where(d <= reach, 1 / np.maximum(d, 1e-12), 0.0)
    total = weight.sum(axis=1)
    return np.where(total > 0, weight @ values / np.where(total > 0, total, 1), 0.0)


def track(model: Callable, x: np.ndarray, y: np.ndarray, largest: np.ndarray, enough: float = 0.01, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Parameters of ``model`` that fit ``y`` by repeated linear least squares, and the squared error over that of zero.

    Columns are differences of the model. A step beyond ``largest`` of its start, or one that
    makes the fit worse after halvings, is rejected; it stops once the error is small ``enough``.
    """
    power = float((y**2).sum()) or 1.0
    start, error = x.copy(), float(((model(x) - y) ** 2).sum()) / power
    for _ in range(rounds):
        if error <= enough:
            break
        small = 1e-5
        columns = np.column_stack([(model(x + small * e) - model(x - small * e)) / (2 * small) for e in np.eye(len(x))])
        step = np.linalg.lstsq(columns, y - model(x), rcond=None)[0]
        for _ in range(6):
            new = x + step
            after = float(((model(new) - y) ** 2).sum()) / power
            if after < error and (np.abs(new - start) <= largest).all():
                break
            step = step / 2
        else:
            break
        x, error = new, after
    return x, error
