"""Classes, regions, the pulse dictionary and its searches against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import classes, pulses as pl, regions, relational as rel

BINS = f"scheme string, class_id int, class string, {classes.BIN}"
INF = float("inf")


def test_bins_that_overlap_or_are_empty_raise(spark):
    make = lambda *rows: spark.createDataFrame([("a", i, str(i), *r) for i, r in enumerate(rows)], BINS)
    fine = make((0.0, True, 1.0, False), (1.0, True, 1.0, True), (1.0, False, INF, False))
    assert classes.checked_bins(fine, ["scheme"]).count() == 3
    for bad in (make((0.0, True, 1.0, True), (1.0, True, 2.0, True)), make((0.0, True, 5.0, False), (1.0, True, 2.0, True)), make((2.0, True, 1.0, True)), make((1.0, True, 1.0, False))):
        with pytest.raises(Exception, match="bin"):
            classes.checked_bins(bad, ["scheme"]).collect()


def test_values_at_edges_beyond_all_bins_and_not_numbers(spark):
    bins = spark.createDataFrame([("a", 0, "low", -INF, False, 0.0, False), ("a", 1, "zero", 0.0, True, 0.0, True), ("a", 2, "mid", 0.0, False, 1.0, True), ("b", 0, "one", 5.0, True, 6.0, False)], BINS)
    rows = [("a", v) for v in (-1e300, -0.5, 0.0, 1e-300, 1.0, 1.0000001, None, float("nan"), INF)] + [("b", 5.0), ("b", 6.0), ("c", 1.0), ("c", None)]
    got = [(r["scheme"], r["v"], r["class_id"], r["class"]) for r in classes.classify(spark.createDataFrame(rows, "scheme string, v double"), bins, ["scheme"], "v").collect()]
    named = {(s, repr(v)): (i, c) for s, v, i, c in got}
    assert len(got) == len(rows)
    assert [named["a", repr(v)] for v in (-1e300, -0.5, 0.0, 1e-300, 1.0)] == [(0, "low"), (0, "low"), (1, "zero"), (2, "mid"), (2, "mid")]
    assert named["a", "1.0000001"] == named["a", "inf"] == named["b", "6.0"] == named["c", "1.0"] == named["c", "None"] == (None, None)
    assert named["a", "None"] == named["a", "nan"] == (3, "noise") and named["b", "5.0"] == (0, "one")


def test_regions_equal_a_flood_along_lines(spark):
    rng = np.random.default_rng(4)
    cells = [(k, x, y, float(rng.random())) for k in range(3) for x in range(25) for y in range(18) if rng.random() < 0.95]
    seeds = [(k, int(rng.integers(25)), int(rng.integers(18))) for k in range(3) for _ in range(12)] + [(0, 3, 5), (0, 3, 6), (0, 3, 5), (9, 0, 0)]
    got = {tuple(r) for r in regions.grow(spark.createDataFrame(cells, "k long, x long, y long, v double"), spark.createDataFrame(seeds, "k long, x long, y long"), ["k"], threshold=0.4).collect()}
    v, want = {c[:3]: c[3] for c in cells}, set()
    for k, x, y in seeds:
        for dx, dy in ((1, 0), (0, 1)):
            line = [w for (a, b, c), w in v.items() if a == k and (c == y if dx else b == x)]
            for sign in (1, -1):
                at = (k, x, y)
                while at in v and v[at] >= 0.4 * max(line):
                    want.add(at)
                    at = (k, at[1] + sign * dx, at[2] + sign * dy)
    assert got == want


def test_latest_start_equals_a_search(spark):
    starts = [3, 4, 50, 51, 400, 401, 2000]
    rows = [*range(0, 900, 7), 2000, 2500]
    found = rel.latest_start(spark.createDataFrame([(i,) for i in rows], "at long"), spark.createDataFrame([(i,) for i in starts], "start long"), "at", "start", 64)
    assert sorted(map(tuple, found.collect())) == [(i, max(s for s in starts if s <= i)) for i in rows if i >= 3]


@pytest.mark.parametrize("pulse", [pl.Pulse(), pl.Pulse(phase=0.4, reach=14, fading=True)])
def test_dictionary_equals_plain_sums_and_its_slope_a_difference(spark, pulse):
    scans, defects = [(0, 1.3), (1, 4.0), (2, 9.75)], [(0, 2.0, 5.0, 1.0), (1, 6.0, 9.0, 0.5), (2, 6.0, 14.0, 2.0), (3, 30.0, 4.0, 1.0)]
    de = spark.createDataFrame(defects, "defect long, gx double, gz double, amplitude double")
    edge = math.tan(math.radians(pulse.opening))

    def model(x, n):
        out = 0.0
        for _, gx, gz, a in defects:
            if abs(x - gx) <= edge * gz:
                u = n - 2 / pulse.speed * math.hypot(x - gx, gz)
                if abs(u) <= pulse.reach:
                    fade = (1 - ((x - gx) / (edge * gz)) ** 2) ** 2 if pulse.fading else 1.0
                    out += a * fade * math.exp(-pulse.bandwidth * u * u) * math.cos(2 * math.pi * pulse.frequency * u + pulse.phase)
        return out

    sc = spark.createDataFrame(scans, "scan long, x double")
    matrix = pl.dictionary(sc, de, pulse, 14.0)
    got = {(r["scan"], r["n"]): (r["model"], r["slope"]) for r in pl.forward(matrix, de.select("defect", "amplitude")).collect()}
    for i, x in scans:
        for n in range(pulse.samples):
            m, s = got.get((i, n), (0.0, 0.0))
            assert m == pytest.approx(model(x, n), abs=1e-9)
            if abs(model(x + 1e-6, n) - model(x - 1e-6, n)) < 1e-3:  # no sample enters or leaves the reach
                assert s == pytest.approx((model(x + 1e-6, n) - model(x - 1e-6, n)) / 2e-6, abs=1e-4)
    traces = [(i, n, float((i + 1) * math.sin(n))) for i, _ in scans for n in range(pulse.samples)]
    image = {r["defect"]: r["image"] for r in pl.adjoint(matrix, spark.createDataFrame(traces, "scan long, n int, v double")).collect()}
    rows = matrix.collect()
    assert image == pytest.approx({d: sum(r["value"] * (r["scan"] + 1) * math.sin(r["n"]) for r in rows if r["defect"] == d) for d in image})


def test_positions_are_found_and_finished_scans_leave(spark):
    pulse = pl.Pulse(fading=True, reach=12)
    de = spark.createDataFrame([(i, 2.0 * i, 6.0 + (5 * i) % 11, 1.0 + i % 3) for i in range(8)], "defect long, gx double, gz double, amplitude double")
    true = [(i, 1.5 + 0.8 * i) for i in range(15)]
    traces = pl.forward(pl.dictionary(spark.createDataFrame(true, "scan long, x double"), de, pulse, 17.0), de.select("defect", "amplitude")).select("scan", "n", F.col("model").alias("v"))
    # less than 0.4 of a wavelength, some not off at all
    tracked = spark.createDataFrame([(i, x + (0 if i % 5 == 0 else 0.6 * math.sin(i))) for i, x in true], "scan long, x double")
    found = {r["scan"]: r for r in pl.corrected_positions(tracked, traces, de, pulse, 17.0, 0.5, rounds=20, gain=1e-9, enough=1e-12, starts=(-0.4, 0.0, 0.4)).collect()}
    assert len(found) == 15
    for i, x in true:
        assert found[i]["position"] == pytest.approx(x, abs=1e-4)
    assert all(found[i]["rounds"] == 1 for i in (0, 5, 10)) and max(r["rounds"] for r in found.values()) > 2


def test_pulse_search_keeps_within_its_ranges(spark):
    u = np.arange(64) - 30.0
    rows = [(1, (np.exp(-0.05 * u**2) * np.cos(0.4 * np.pi * u + 0.01 * u**2 + 0.3)).tolist()), (2, (np.exp(-0.05 * u**2) * np.cos(0.4 * np.pi * u + 3.0)).tolist())]
    got = {r["k"]: r for r in pl.fitted_pulses(spark.createDataFrame(rows, "k long, v array<double>"), "k", {"phase": (-1.0, 1.0), "bandwidth": (0.01, 0.1), "chirp": (-0.05, 0.05)}, 0.2, rounds=9).collect()}
    assert (got[1]["phase"], got[1]["bandwidth"], got[1]["chirp"]) == pytest.approx((0.3, 0.05, 0.01), abs=5e-3) and got[1]["error"] < 1e-3
    assert -1 <= got[2]["phase"] <= 1 and got[2]["error"] > 0.1


def test_block_kriging_equals_plain_systems(spark):
    from strandline.operators import kriging as kr

    rng = np.random.default_rng(8)
    cells = [(b, int(c) // 5, int(c) % 5, rng.normal(size=16).tolist()) for b in (3, 4) for c in rng.permutation(25)[: 6 + b]]
    reach = lambda k: 3.0 / (1 + k / 4)
    traces, errors = kr.block_kriging(spark.createDataFrame(cells, "b int, x long, y long, v array<double>"), "b", 5, 16, reach)
    got = {(r["b"], r["x"], r["y"]): r["v"] for r in traces.collect()}
    error = {(r["b"], r["x"], r["y"], r["k"]): r["sigma"] for r in errors.collect()}
    for b in (3, 4):
        at = np.array([(x, y) for c, x, y, _ in cells if c == b], float)
        spectra = np.fft.rfft([v for c, _, _, v in cells if c == b], axis=1)
        for x, y in {(x, y) for x in range(5) for y in range(5)} - {(int(p), int(q)) for p, q in at}:
            found = np.zeros(9, complex)
            for k in range(9):
                c = lambda p, q: np.exp(-(np.hypot(*(p - q)) / reach(k)) ** 2)  # noqa: B023, E731
                n = len(at)
                m = np.block([[np.array([[c(p, q) for q in at] for p in at]) + 1e-3 * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
                right = np.append([c(p, np.array([x, y], float)) for p in at], 1.0)
                w = np.linalg.lstsq(m, right, rcond=None)[0]
                found[k] = w[:n] @ spectra[:, k]
                assert error[b, x, y, k] == pytest.approx(math.sqrt(max(0.0, 1.001 - w @ right)), abs=1e-6)
            assert np.allclose(got[b, x, y], np.fft.irfft(found, 16), atol=1e-8)
    assert len(got) == 50 - len(cells)


def test_pulse_search_shuffles_traces_alone(spark):
    """The search of a trace stays where the trace lies: one shuffle of the traces and no step table."""
    traces = spark.createDataFrame([(1, [float(x) for x in np.exp(-0.05 * (np.arange(64) - 30.0) ** 2)])], "k long, v array<double>")
    found = pl.fitted_pulses(traces, "k", {"phase": (-1.0, 1.0), "bandwidth": (0.01, 0.1), "chirp": (-0.05, 0.05)}, 0.2, rounds=9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan


def test_dictionary_products_go_by_position(spark):
    """Scans of one position share its rows: none of the dictionary's joins has the scans' ids."""
    from strandline.plans import registry
    from tests.oracle import DATA

    plan = registry.queries()["k23_dictionary_adjoint"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "vec_id" not in plan[: plan.index("Aggregate", plan.index("Join"))]
    plan = registry.queries()["k23_dictionary_forward"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
