"""Hard negatives against all inner products, with ties, null and ragged rows."""

import math
import random

import numpy as np
import pytest

from intervale.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, score double, rank string, _row string"


def frame(spark, rows):
    """(vec_id, label, embedding) with columns that clash with results."""
    return spark.createDataFrame([(*r, 1.0, "x", "y") for r in rows], SCHEMA).repartition(3)


def brute(rows, every=50, positives=5, negatives=3, scale=256):
    use = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        use.append((i, label, [math.floor(scale * float(np.float32(c))) for c in v]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for n, (a, label, x) in enumerate(use):
        if a % every:
            continue
        scored = [(-dot(x, y), i, other) for m, (i, other, y) in enumerate(use) if m != n]
        for s, p, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            hard = sorted(r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s)[:negatives]
            out += [(a, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(hard)]
    return sorted(out)


def vectors(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(4)), (rng.standard_normal(d) * spread + 0.05).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("cells", [negatives.ANCHOR_CELLS, 30])
def test_equals_all_products(spark, monkeypatch, cells):
    """With all anchors at once, and with a few a block."""
    monkeypatch.setattr(negatives, "ANCHOR_CELLS", cells)
    monkeypatch.setattr(negatives, "SCAN_ROWS", 64)
    rows = vectors(400, 20, 1) + [(1000 + i, 1, [0.5] * 20) for i in range(120)]  # equal vectors: ties by id
    found = negatives.hard_negatives(frame(spark, rows), "vec_id", "label", "embedding").collect()
    assert sorted(map(tuple, found)) == brute(rows)
    assert len(found) > 60


def test_small_whole_numbers_give_ties(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), [rng.choice([-1, 0, 1, 2]) / 256 for _ in range(6)]) for i in range(300)]
    assert sorted(map(tuple, negatives.hard_negatives(frame(spark, rows), "vec_id", "label", "embedding").collect())) == brute(rows)


def test_nulls_ragged_and_repeated_rows(spark):
    rows = vectors(150, 8, 3) + [(200, None, [1.0] * 8), (201, 1, None), (202, 1, [1.0, None] * 4), (203, 1, [math.inf] * 8), (204, 2, [math.nan] * 8), (None, 1, [1.0] * 8)]
    rows += [(250, 0, [0.7] * 3), (251, 1, [0.7] * 12), (252, 1, []), (300, 1, [0.0] * 8)] + [(350, 2, [0.4] * 8)] * 2
    found = sorted(map(tuple, negatives.hard_negatives(frame(spark, rows), "vec_id", "label", "embedding").collect()))
    assert found == brute(rows)
    assert any(r[0] == 350 and r[1] == 350 for r in found) and any(r[0] == 250 for r in found)


def test_large_numbers_stay_exact(spark):
    rows = [(i, i % 2, (np.random.default_rng(i).integers(-200_000, 200_000, 40) + 0.25).astype(np.float32).tolist()) for i in range(120)]
    assert sorted(map(tuple, negatives.hard_negatives(frame(spark, rows), "vec_id", "label", "embedding").collect())) == brute(rows)


def test_empty_tables_and_no_anchor(spark):
    assert negatives.hard_negatives(frame(spark, []), "vec_id", "label", "embedding").count() == 0
    assert negatives.hard_negatives(frame(spark, [(1, 1, [1.0]), (2, 2, [1.0])]), "vec_id", "label", "embedding").count() == 0
    assert negatives.hard_negatives(frame(spark, [(0, 1, [1.0]), (2, 2, [1.0])]), "vec_id", "label", "embedding").count() == 0


def test_bounds_drop_candidates():
    """Most rows are given up before all dimensions are read."""
    rng = np.random.default_rng(0)
    x = rng.integers(-100, 100, (64, 5000)) * (np.arange(64) < 8)[:, None] + rng.integers(-3, 3, (64, 5000))
    block = negatives.Block(x, int(np.abs(x).max()))
    alive, score = negatives.scanned(block, x[:, 0], np.arange(1, 5000), np.array([[-negatives.NO_LIMIT, negatives.NO_LIMIT]]), 5)
    want = x[:, 0] @ x[:, 1:]
    assert len(alive) < 100 and set(np.argsort(-want)[:5] + 1) <= set(alive)
    assert (score == want[alive - 1]).all()
