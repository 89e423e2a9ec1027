"""Signals over chunks and surrogates against whole signals and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervale.operators import replicates as B
from intervale.functions import signals as K
from intervale.operators import chunks as C
from intervale.plans import signals as P
from intervale.sources.tables import segments

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("size", "border"), [(64, 300), (500, 300)])
def test_filtered_chunks_equal_the_filtered_whole(spark, size, border):
    dice = np.random.default_rng(1)
    whole = {k: np.cumsum(dice.normal(size=2000)) for k in (1, 2)}
    rows = [(k, i // size, i, x[i : i + size].tolist()) for k, x in whole.items() for i in range(0, 2000, size)]
    df = spark.createDataFrame(rows, "key long, chunk long, i0 long, samples array<double>").repartition(5)
    found = C.over_chunks(df, ["key"], size, border, lambda x: K.zero_phase(*K.butterworth(2, 4, 12, 64.0), x)).collect()
    for k, x in whole.items():
        mine = sorted((r for r in found if r.key == k), key=lambda r: r.i0)
        assert np.concatenate([r.samples for r in mine]) == pytest.approx(K.zero_phase(*K.butterworth(2, 4, 12, 64.0), x[None])[0], abs=2e-3)


def test_gaps_nulls_and_ragged_rows(spark):
    rows = [(1, 0, 0, [1.0, 2.0]), (1, 1, 2, [3.0, None]), (1, 3, 6, [5.0, 6.0]), (1, 4, 8, [7.0, 8.0])]
    df = spark.createDataFrame(rows, "key long, chunk long, i0 long, samples array<double>")
    borders = {r.chunk: (r.before, r.samples) for r in C.with_borders(df, ["key"], 2, 3).collect()}
    assert borders[3] == (0, [5.0, 6.0, 7.0, 8.0]) and borders[4] == (2, [5.0, 6.0, 7.0, 8.0]) and borders[0] == (0, [1.0, 2.0, 3.0, None])
    found = {r.chunk: r.samples for r in C.over_chunks(df, ["key"], 2, 3, lambda x: x + 1).collect()}
    assert found == {0: None, 1: None, 3: [6.0, 7.0], 4: [8.0, 9.0]}
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [1.0, 2.0, 3.0]), (5, [])], "unit long, samples array<double>")
    got = {r.unit: r.top for r in P.by_row(odd, ["samples"], lambda x: {"top": x.max(axis=1)}, "unit long, top double").collect()}
    assert got == {1: 2.0, 2: None, 3: None, 4: 3.0, 5: None}


def test_coupling_and_locking_against_brute_force(spark):
    rows = segments(spark, SF).orderBy(F.xxhash64("unit"), "unit").collect()
    pac, locked = ({r.grp: r for r in f(spark, SF).collect()} for f in (P.irpac, P.sfc))
    for g in {r.grp for r in rows}:
        own = [r for r in rows if r.grp == g]
        x = np.array([r.samples for r in own])
        phase, amplitude = P._phase_and_amplitude(x[:, :32], x[:, 32:])
        # one trial of all samples has the same bins as the trials together
        mi = lambda a: K.coupling(phase.reshape(1, -1), a.reshape(1, -1))[0]
        null = None
        if len(own) <= P.TRIALS:
            lot, null = B.lots([r.unit for r in own], 1, P.N), []
            for k in range(P.N):
                order = sorted(range(len(own)), key=lambda i: (lot[i, k], i))
                partner = {a: b for a, b in zip(order, [*order[1:], order[0]])}
                null.append(mi(amplitude[[partner[i] for i in range(len(own))]]))
        assert pac[g].observed == pytest.approx(mi(amplitude))
        if null:
            assert pac[g].p == pytest.approx((sum(v >= mi(amplitude) for v in null) + 1) / (P.N + 1)) and pac[g].z == pytest.approx((mi(amplitude) - np.mean(null)) / np.std(null), rel=1e-6)
        y = x[:, 32:]
        spikes = y > y.mean(axis=1, keepdims=True) + y.std(axis=1, keepdims=True)
        assert locked[g].observed == pytest.approx(abs(np.exp(1j * phase)[spikes].mean())) and 0 < locked[g].p <= 1 and locked[g].p_two <= locked[g].p


def test_derangements_are_random_cycles():
    partner = B.cycles(B.lots(list(range(50)), 1, 200))
    assert len({tuple(p) for p in partner}) == 200 and all((p != np.arange(50)).all() and sorted(p) == list(range(50)) for p in partner)
    # each partner is about as likely as any other
    share = np.bincount(partner[:, 7], minlength=50) / 200
    assert share[7] == 0 and share.max() < 0.1 and (share > 0).sum() > 40


def test_surrogates_find_a_planted_coupling(spark):
    t = np.arange(512) / 64.0
    dice = np.random.default_rng(2)
    rows = []
    for unit in range(60):
        turn = dice.uniform(0, 2 * np.pi)
        slow = np.cos(2 * np.pi * 6 * t + turn)
        fast = (1 + slow) * np.cos(2 * np.pi * 20 * t)
        rows.append((unit, 1, [*(slow + 0.1 * dice.normal(size=512)), *(fast + 0.1 * dice.normal(size=512))]))
        rows.append((100 + unit, 2, [*(slow + 0.1 * dice.normal(size=512)), *dice.normal(size=512)]))
    df = spark.createDataFrame([(u, g, [float(v) for v in x]) for u, g, x in rows], "unit long, grp long, samples array<double>")
    sums = P.surrogate_sums(df, P.coupling_cells, 36)
    means = F.transform(F.sequence(F.lit(0), F.lit(17)), lambda i: F.get("cells", i) / F.get("cells", i + 18))
    from intervale.functions.circular import modulation_index

    found = {r.grp: r for r in P.against_surrogates(sums.select("grp", "replicate", modulation_index(means, 18).alias("statistic"))).collect()}
    assert found[1].p == pytest.approx(1 / (P.N + 1)) and found[1].z > 5 and found[2].p > 0.02


def test_chunked_queries_equal_whole_signals(spark):
    by_mark = {}
    for r in P.hourly(spark, SF).collect():
        by_mark.setdefault(r.mark, {})[r.chunk] = r.samples
    found = {(r.mark, r.chunk): r.envelope for r in P.chunked_envelope(spark, SF).collect()}
    checked = 0
    for mark, parts in by_mark.items():
        ids = sorted(parts)
        if ids != list(range(ids[0], ids[-1] + 1)):
            continue
        whole = np.abs(K.band(np.concatenate([parts[i] for i in ids])[None], 1 / 36, 1 / 16, 1.0, 2))[0].reshape(len(ids), -1).mean(axis=1)
        inner = slice(1, -1)
        assert np.array([found[mark, i] for i in ids])[inner] == pytest.approx(whole[inner], rel=0.05, abs=0.05 * whole.mean())
        checked += 1
    assert len(found) == sum(map(len, by_mark.values())) and P.chunked_spectrogram(spark, SF).where("power < 0").count() == 0
    assert checked or by_mark
