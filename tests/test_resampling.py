"""Cluster bootstraps against NumPy on the same draws."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import resampling as R

DRAWS, SEED = 60, 11


def used(cluster, draw):
    u = (int(hashlib.md5(f"{cluster}-{draw}-{SEED}".encode()).hexdigest()[:7], 16) + 0.5) / (1 << 28)
    return sum(u > p for p in R.POISSON)


def sample(seed):
    rng = random.Random(seed)
    events, controls = [], []
    for g in range(40):
        day, x, z = g % 7, rng.gauss(0, 1), rng.gauss(0, 2)
        events.append((g, day, x, z, 1 + 2 * x - z + rng.gauss(0, 0.1) if g != 5 else None))
        for _ in range(rng.randint(0, 6)):
            a, b = rng.gauss(0, 1), rng.gauss(0, 2)
            controls.append((g, a, b if rng.random() < 0.95 else float("nan"), 2 * a - b + rng.gauss(0, 0.1)))
    return events, controls


def estimate(groups, weight):
    s, v, effects, w = np.zeros((2, 2)), np.zeros(2), [], []
    for day, mean_x, mean_y, sxx, sxy, ex, ey in groups:
        s += weight(day) * sxx
        v += weight(day) * sxy
    beta = np.linalg.lstsq(s, v, rcond=1e-9)[0]
    for day, mean_x, mean_y, sxx, sxy, ex, ey in groups:
        effects.append(ey - mean_y - (ex - mean_x) @ beta)
        w.append(weight(day))
    return beta, np.average(effects, weights=w)


def check_regression(spark, events, controls):
    ev = spark.createDataFrame(events, "g long, day long, x double, z double, y double")
    co = spark.createDataFrame(controls, "g long, x double, z double, y double")
    r = R.within_group_regression(ev, co, [], "g", "day", "x", "z", "y", DRAWS, SEED, comparisons=4).first()
    groups = []
    for g, day, x, z, y in events:
        mine = np.array([c[1:] for c in controls if c[0] == g and not np.isnan(c[1:]).any()])
        if y is None or not len(mine):
            continue
        centred = mine - mine.mean(axis=0)
        groups.append((day, mine[:, :2].mean(axis=0), mine[:, 2].mean(), centred[:, :2].T @ centred[:, :2] / len(mine), centred[:, :2].T @ centred[:, 2] / len(mine), np.array([x, z]), y))
    beta, point = estimate(groups, lambda d: 1)
    assert r.n_events == len(groups) and np.allclose([r.beta_x, r.beta_z, r.estimate], [*beta, point])
    draws = [estimate(groups, lambda d, k=k: used(d, k))[1] for k in range(1, DRAWS + 1)]
    assert np.allclose([r.ci_low, r.ci_high, r.bonferroni_low], np.quantile(draws, [0.025, 0.975, 0.025 / 4]))
    return r


def test_regression_within_groups(spark):
    events, controls = sample(1)
    assert check_regression(spark, events, controls).rank == 2
    flat = [(g, a, 2 * a, y) for g, a, _, y in controls]  # x and z say the same: the solution of least norm
    assert check_regression(spark, events, flat).rank == 1


def test_difference_of_arms_and_too_few_clusters(spark):
    rng = random.Random(4)
    rows = [(d, arm, rng.gauss(arm, 1)) for d in range(6) for arm in (0, 1) for _ in range(rng.randint(1, 5))] + [(9, 1, 50.0), (2, 0, None), (2, 1, float("nan"))]
    df = spark.createDataFrame(rows, "day long, arm int, v double")
    r = R.bootstrap_difference(df, [], "day", F.col("arm") == 1, "v", DRAWS, SEED).first()
    per = {d: [[v for e, a, v in rows if (e, a) == (d, arm) and v is not None and v == v] for arm in (1, 0)] for d in range(6)}
    mean = lambda w: [sum(w(d) * sum(per[d][k]) for d in per) / sum(w(d) * len(per[d][k]) for d in per) for k in (0, 1)]
    assert r.n_clusters == 6 and np.isclose(r.mean_diff, np.subtract(*mean(lambda d: 1)))
    draws = [np.subtract(*mean(lambda d, k=k: used(d, k))) for k in range(1, DRAWS + 1)]
    assert np.allclose([r.ci_low, r.ci_high], np.quantile(draws, [0.025, 0.975])) and r.ci_holds_zero == (r.ci_low <= 0 <= r.ci_high)
    few = R.bootstrap_difference(df, [], "day", F.col("arm") == 1, "v", DRAWS, SEED, min_clusters=7).first()
    assert few.ci_low is None and few.mean_diff == r.mean_diff
