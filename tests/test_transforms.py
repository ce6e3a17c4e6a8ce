import numpy as np
import pytest

from strandline.functions import transforms as tr


@pytest.mark.parametrize("size", [4, 8, 16])
def test_bank_gives_the_blocks_again_one_late(size):
    x = np.random.default_rng(size).normal(size=(12, size))
    bank = tr.LowDelayBank.sine(size)
    y = bank.analyse(x)
    assert np.allclose(bank.synthesise(y)[1:], x[:-1])
    assert np.allclose(bank.analyse(x[4 : 5 + tr.MEMORY])[-1], y[4 + tr.MEMORY])


@pytest.mark.parametrize("late, delay", [(False, 0), (True, 2)])
def test_lift_is_undone(late, delay):
    x = np.random.default_rng(1).normal(size=(9, 6))
    back = tr.unlift(tr.lift(x, np.array([0.3, -2.0, 1.0]), late), np.array([0.3, -2.0, 1.0]), late)
    assert np.allclose(back[delay:], x[: len(x) - delay])


def test_wavelets():
    v = np.random.default_rng(2).normal(size=64)
    assert np.isclose(tr.daubechies_packet(v, 4).sum(), (v**2).sum())
    assert np.allclose(tr.daubechies_packet(np.ones(64), 3)[1:], 0)
    widths = 5 / (2 * np.pi * np.array([0.05, 0.1, 0.2]))
    tone = np.cos(2 * np.pi * 0.1 * np.arange(200))
    assert np.abs(tr.morlet(tone, widths)).sum(axis=1).argmax() == 1


def test_components_come_apart():
    t = np.arange(600)
    sources = np.column_stack((np.sign(np.sin(t / 9.0)), np.random.default_rng(3).uniform(-1, 1, 600)))
    mixed = sources @ np.array([[1.0, 0.5, 0.3], [0.4, 1.0, -0.6]])
    found = tr.independent(mixed, 2)
    match = np.abs(np.corrcoef(found.T, sources.T)[:2, 2:])
    assert (match.max(axis=0) > 0.97).all()
    assert tr.denoise_cycles(np.ones(9)).tolist() == [0, 0, 0]


def test_variogram_fit_and_inverse_distance():
    places = np.array([(x, y) for x in range(12) for y in range(12)], float)
    values = np.sin(places[:, 0] / 3) + np.cos(places[:, 1] / 4)
    nugget, sill, span = tr.fit_gaussian_variogram(places, values, 8, 6.0)
    assert nugget >= 0 and sill > 0 and 0 < span <= 9
    assert np.allclose(tr.inverse_distance(places, places, values, 2.0), values)
    assert tr.inverse_distance(np.array([[99.0, 99.0]]), places, values, 2.0) == 0


def test_tracking_finds_the_pulse_and_rejects_long_steps():
    t = np.arange(64)
    pulse = lambda p: p[1] * np.exp(-(((t - p[0]) / 2) ** 2))
    x, error = tr.track(pulse, np.array([30.0, 1.0]), pulse(np.array([31.3, 2.0])), np.array([3.0, 5.0]), 1e-10)
    assert np.allclose(x, [31.3, 2.0], atol=1e-3) and error < 1e-6
    x, _ = tr.track(pulse, np.array([30.0, 1.0]), pulse(np.array([50.0, 2.0])), np.array([3.0, 5.0]))
    assert abs(x[0] - 30) <= 3
