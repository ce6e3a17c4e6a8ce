import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from strandline.functions import kernels as k


def test_lowpass_keeps_slow_and_stops_fast():
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * 0.01 * t), np.sin(2 * np.pi * 0.4 * t)
    out = k.zero_phase(slow + fast, 0.1)
    assert np.abs(out - slow)[20:-20].max() < 0.01
    assert k.zero_phase(np.array([3.0]), 0.1).tolist() == [3.0]


def test_blocks_with_state_equal_one_run():
    v = np.random.default_rng(0).normal(size=50)
    b, a = k.lowpass_coefficients(0.1, 2)[0]
    whole, _ = k.recursive(v, b, a)
    first, state = k.recursive(v[:20], b, a)
    second, _ = k.recursive(v[20:], b, a, state)
    assert np.allclose(whole, np.concatenate((first, second)))


def test_envelope_and_phase_of_a_tone():
    t = np.arange(64)
    v = np.cos(2 * np.pi * 4 * t / 64)
    assert np.allclose(np.abs(k.analytic(v)), 1)
    assert np.allclose(k.rotate_phase(v, np.pi / 2), -np.sin(2 * np.pi * 4 * t / 64))
    assert np.allclose(k.spectral_lowpass(v, 4), 0)
    assert np.allclose(k.fourier_resample(v, 128)[::2], v)


def test_wavelet_packet_keeps_energy():
    v = np.random.default_rng(1).normal(size=64)
    assert np.isclose(k.haar_packet(v, 3).sum(), (v**2).sum())


def test_kriging_meets_samples_and_constants():
    rng = np.random.default_rng(2)
    at = rng.uniform(0, 10, (12, 2))
    gram = lambda h: 1 - np.exp(-((h / 4) ** 2))
    v, s = k.krige(at, at, np.arange(12.0), gram, 1e-9)
    assert np.allclose(v, np.arange(12.0), atol=1e-3) and s.max() < 1e-2
    assert np.allclose(k.krige(rng.uniform(0, 10, (5, 2)), at, np.full(12, 7.0), gram)[0], 7)


def test_sparse_recovery():
    rng = np.random.default_rng(3)
    h = rng.normal(size=(50, 220)) / np.sqrt(50)
    x = np.zeros(220)
    x[[50, 130]] = 1.0, -0.7
    assert np.allclose(k.matching_pursuit(h, h @ x, 2), x)
    found = k.fista(h, h @ x, 0.02, 1500)
    assert set(np.argsort(-np.abs(found))[:2]) == {50, 130}


def test_solvers():
    assert np.allclose(k.newton(np.ones(1), lambda x: 2 * (x - 3), lambda x: np.full(1, 2.0)), 3)
    f = lambda x: np.cosh(x[0] - 1) + 0.5 * (x[1] + 2) ** 2 + 0.1 * (x[0] - 1) * (x[1] + 2)
    g = lambda x: np.array([np.sinh(x[0] - 1) + 0.1 * (x[1] + 2), x[1] + 2 + 0.1 * (x[0] - 1)])
    assert np.allclose(k.quasi_newton(np.array([0.5, -1.0]), f, g), [1, -2], atol=1e-5)
    assert np.isclose(k.bisect(lambda x: x * x - 2, 0, 2), np.sqrt(2))
    with pytest.raises(ValueError):
        k.bisect(lambda x: x * x + 1, 0, 2)
    x = np.linspace(-1, 1, 20)
    assert np.allclose(k.total_least_squares_parabola(x, 1 + 2 * x - 3 * x**2), [1, 2, -3])
    h = np.random.default_rng(4).normal(size=(3, 8))
    leak = h @ k.zero_forcing(h)
    assert np.allclose(leak - np.diag(np.diag(leak)), 0)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abcdé ", max_size=60))
def test_prefix_code_round_trip(text):
    counts = {c: text.count(c) for c in set(text)}
    code = k.prefix_code(counts)
    assert k.decode_prefix("".join(code[c] for c in text), code) == text
    if len(code) > 1:
        assert np.isclose(sum(2.0 ** -len(c) for c in code.values()), 1)
