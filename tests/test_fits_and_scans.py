"""Refits of laws, budgets and greedy bins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import laws, scans


def test_refit_recovers_a_law_off_the_grid(spark):
    rng = random.Random(1)
    law = lambda n, d, a: 1.5 + 3.0 * n**-a + 2.0 * d**-0.45
    rows = [(g, n, d, law(n, d, 0.31 + 0.1 * g) + rng.gauss(0, 1e-4) + (4 if rng.random() < 0.02 else 0)) for g in (0, 1) for _ in range(600) for n, d in [(rng.uniform(0.05, 80), rng.uniform(0.5, 900))]]
    points = spark.createDataFrame([*rows, (0, None, 1.0, 2.0), (1, 0.0, 1.0, 2.0), (2, 1.0, 1.0, None)], "g int, N_params_B double, D_tokens_B double, val_loss double")
    fits = {r.g: r for r in laws.refit_law(points, laws.fit_law(points, [0.2, 0.6], [0.2, 0.6], ["g"]), ["g"]).collect()}
    assert set(fits) == {0, 1}
    for g, r in fits.items():
        assert (r.E, r.A, r.alpha, r.B, r.beta) == pytest.approx((1.5, 3.0, 0.31 + 0.1 * g, 2.0, 0.45), abs=0.01)


def test_best_within_budget_is_the_best_of_all(spark):
    rng = random.Random(2)
    grid = sorted({(rng.choice([0.1, 0.5, 1.0, 7.0, 70.0]), rng.choice([1.0, 2.0, 20.0, 300.0, 1000.0])) for _ in range(40)}) + [(0.0, 5.0)]
    budgets = sorted({10 ** rng.uniform(16, 24) for _ in range(60)} | {6e18 * 0.5 * 20.0, -1.0, 0.0})
    loss = lambda n, d: 1.69 + 406.4 / (n * 1e9) ** 0.34 + 410.7 / (d * 1e9) ** 0.28
    want = {b: min((loss(n, d), 6e18 * n * d, n, d) for n, d in grid if 0 < 6e18 * n * d <= b)[2:] for b in budgets if any(0 < 6e18 * n * d <= b for n, d in grid)}
    got = laws.best_within_budget(spark.createDataFrame(grid, "N_params_B double, D_tokens_B double"), spark.createDataFrame([(b,) for b in budgets], "flops double"), fine=2)
    assert {r.flops: (r.N_params_B, r.D_tokens_B) for r in got.collect()} == want


def test_greedy_bins(spark):
    rng = random.Random(3)
    rows = [(f"s{k % 3}", k, rng.choice([0, 1, 7, 30, 99, 250])) for k in range(300)]
    df = spark.createDataFrame([*rows, ("s0", 1000, None)], "s string, k int, n int").repartition(4)
    got = {(r.s, r.k): (r.chunk, r.bin, r.start) for r in scans.greedy_bins(df, ["s"], "k", F.col("n"), 100, chunk=50).collect()}
    want, state = {}, {}
    for s, k, n in [*rows, ("s0", 1000, 0)]:
        number, used = state.get((s, k // 50), (1, 0))
        if used and used + n > 100:
            number, used = number + 1, 0
        want[s, k] = k // 50, number, used
        state[s, k // 50] = number, used + n
    assert got == want
    assert scans.greedy_bins(df.limit(0), ["s"], "k", F.col("n"), 100).collect() == []
