"""Two-level scans against windows, and exact quantiles against numpy, with one key that holds nearly all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from intervale.operators import quantiles as Q
from intervale.operators import relational as R
from intervale.operators import scans as S
from intervale.sources.scratch import saved

KINDS = {"rank": None, "sum": "v", "min": "v", "max": "v", "suffix_min": "v", "last": "v", "before": "v", "lag": "v"}


@pytest.fixture(scope="module")
def rows(spark):
    """90 % of the rows have key 1; a few have none; a third of the values is null."""
    dice = random.Random(5)
    data = [(None if i % 97 == 0 else 1 if i % 10 else i % 7, dice.randrange(500), i, None if dice.random() < 1 / 3 else dice.randrange(100)) for i in range(3000)]
    return spark.createDataFrame(data, "k long, t long, id long, v long").repartition(5)


@pytest.mark.parametrize("keys", [["k"], []])
def test_scans_equal_windows(rows, keys):
    placed = S.dealt(rows, keys, ["t", "id"], saved, parts=16)
    assert placed.where("k = 1").select("_part").distinct().count() > 8
    found = S.scanned(placed, keys, ["t", "id"], {f"x_{kind}": (kind, F.col(v) if v else None) for kind, v in KINDS.items()})
    by = Window.partitionBy(*keys).orderBy("t", "id")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("id", F.row_number().over(by).alias("x_rank"), F.sum("v").over(upto).alias("x_sum"), F.min("v").over(upto).alias("x_min"), F.max("v").over(upto).alias("x_max"), F.min("v").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("x_suffix_min"), F.last("v", True).over(upto).alias("x_last"), F.last("v", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("x_before"), F.lag("v").over(by).alias("x_lag"))
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert found.count() == 3000


def test_false_discovery_rates(spark):
    dice = random.Random(1)
    p = [(i, None if i % 11 == 0 else dice.choice([0.001, 0.04, dice.random()])) for i in range(400)]
    found = {r["id"]: r["q"] for r in R.benjamini_hochberg(spark.createDataFrame(p, "id long, p double"), "p", "id", saved, parts=12).collect()}
    tested = sorted((x, i) for i, x in p if x is not None)
    best, want = 1.0, {i: None for i, x in p if x is None}
    for rank in range(len(tested), 0, -1):
        best = min(best, tested[rank - 1][0] * len(tested) / rank)
        want[tested[rank - 1][1]] = best
    assert found.keys() == want.keys()
    assert all((found[i] is None) == (want[i] is None) and (want[i] is None or math.isclose(found[i], want[i])) for i in want)
    assert R.benjamini_hochberg(spark.createDataFrame([], "id long, p double"), "p", "id", saved).count() == 0


VALUES = {
    "uniform": lambda d, n: d.random(n),
    "far ends": lambda d, n: np.concatenate([d.random(n - 4), [1e300, -1e300, math.inf, -math.inf]]),
    "powers": lambda d, n: np.exp2(d.integers(-1000, 1000, n).astype(float)) * d.choice([-1, 1], n),
    "mostly one": lambda d, n: np.where(d.random(n) < 0.9, 7.25, d.random(n) * 20),
    "few": lambda d, n: d.integers(0, 4, n).astype(float),
    "near": lambda d, n: 1 + d.integers(0, 1000, n) * 2.0**-52,
    "tiny": lambda d, n: d.integers(-9, 9, n) * 5e-324,
}
SHARES = {"low": 0.05, "q1": 0.25, "mid": 0.5, "q3": 0.75, "top": 1.0, "p": 0.333}


@pytest.mark.parametrize("name", VALUES)
def test_quantiles_are_exact(spark, name):
    """With few cells and hardly any sorting, so that all is settled by passes."""
    x = VALUES[name](np.random.default_rng(2), 700)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "v double").repartition(6)
    found = Q.quantiles(df, [], F.col("v"), SHARES, saved, cells=8, sorted_rows=5).first()
    assert found["n"] == len(x)
    ordered = np.sort(x)
    for key, q in SHARES.items():
        a, b = ordered[math.floor((len(x) - 1) * q)], ordered[math.ceil((len(x) - 1) * q)]
        want = a if a == b else a + (b - a) * ((len(x) - 1) * q - math.floor((len(x) - 1) * q))
        assert found[key] == want or math.isclose(found[key], want, rel_tol=1e-15), key


@pytest.mark.parametrize("sent", [Q.SENT, 0])
def test_quantiles_by_key(spark, monkeypatch, sent):
    """Bounds sent to all tasks, and bounds joined by key."""
    monkeypatch.setattr(Q, "SENT", sent)
    dice = np.random.default_rng(3)
    data = [(None if i % 50 == 0 else "hot" if i % 10 else f"k{i % 7}", float(v)) for i, v in enumerate(dice.integers(0, 300, 2000))] + [("empty", None), ("one", 4.5)]
    found = {r["k"]: r for r in Q.quantiles(spark.createDataFrame(data, "k string, v double").repartition(5), ["k"], F.col("v"), SHARES, saved, cells=8, sorted_rows=20).collect()}
    for k in {k for k, _ in data}:
        x = [v for key, v in data if key == k and v is not None]
        assert found[k]["n"] == len(x)
        for key, q in SHARES.items():
            assert found[k][key] == (pytest.approx(np.quantile(x, q), rel=1e-14) if x else None)
    assert Q.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], F.col("v"), SHARES, saved).count() == 0
    none = Q.quantiles(spark.createDataFrame([], "k string, v double"), [], F.col("v"), SHARES, saved).first()
    assert none["n"] == 0 and none["mid"] is None


def test_statistics_of_a_unit_with_most_points(spark):
    """Intervals and runs of a unit with nine tenths of the points, over many parts, against one pass in order."""
    from intervale.operators import pointprocess as P

    dice = random.Random(8)
    data = [(1 if i % 10 else 2, dice.randrange(4000), i, dice.random()) for i in range(2000)]
    p = spark.createDataFrame(data, "unit long, t long, point_id long, value double").repartition(4)
    found = {r["unit"]: r for r in P.interval_metrics(p, 1, 2.0, 1.5, saved, parts=16).collect()}
    runs = sorted((r["unit"], r["start"], r["end"], r["n"]) for r in P.bursts(p, F.col("value") > 0.4, 2, saved, parts=16).collect())
    want_runs = []
    for unit in (1, 2):
        own = sorted((t, i, v) for u, t, i, v in data if u == unit)
        gaps = [b[0] - a[0] for a, b in zip(own, own[1:]) if b[0] > a[0]]
        ratios = [(b - a) / (b + a) for a, b in zip(gaps, gaps[1:])]
        r = found[unit]
        assert r["n"] == len(own) and r["median_gap"] == np.median(gaps)
        assert r["cv"] == pytest.approx(np.std(gaps) / np.mean(gaps)) and r["cv2"] == pytest.approx(np.mean([2 * abs(x) for x in ratios])) and r["lv"] == pytest.approx(np.mean([3 * x * x for x in ratios]))
        assert r["burst_share"] == pytest.approx(np.mean([g < 2 for g in gaps])) and r["violation_share"] == pytest.approx(np.mean([g < 1.5 for g in gaps]))
        run = []
        for t, _, v in own:
            if v > 0.4:
                run.append(t)
            else:
                want_runs += [(unit, run[0], run[-1], len(run))] if len(run) >= 2 else []
                run = []
    assert runs == sorted(want_runs)
