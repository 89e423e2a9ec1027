"""Queries on maps between halves of segments, their dimensions and subspaces, decoders, mixed models and mixtures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.operators import graph as G
from intervale.operators import models as M
from intervale.operators import replicates as B
from intervale.operators.chunks import matrices_by_length
from intervale.operators.neighbours import usable
from intervale.plans.events import EV, r6
from intervale.plans.models import FOLDS, _folds
from intervale.plans.nulls import N, lot_of, shuffled_sql
from intervale.plans.registry import query
from intervale.plans.segments import PH, SG, _phases, _widths
from intervale.sources.scratch import saved
from intervale.sources.tables import DAY, HOUR, any_flag, points, segments, table

HALF = 32
PENALTIES = [float(p) for p in 10.0 ** np.arange(-2, 4)]
RANKS = list(range(1, 11))
#: Pairs of labels that are matched on the driver, at most.
LABEL_PAIRS = 1 << 20
#: Resamples of the channels.
RESAMPLES = 100


@query()
def rrr_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated R^2 by penalty and rank; chosen: the smallest rank within one error of the peak, at the penalty of the peak."""
    scores = M.rank_scores(_folds(spark, d), HALF, PENALTIES, RANKS)
    mean, se = scores.mean(axis=2), scores.std(axis=2) / scores.shape[2]
    a = int(mean.max(axis=1).argmax())
    r = M.within_one_error(mean[a].tolist(), se[a].tolist())
    return spark.createDataFrame([(p, k, float(mean[i, j]), float(se[i, j]), (i, j) == (a, r)) for i, p in enumerate(PENALTIES) for j, k in enumerate(RANKS)], "penalty double, rank long, r2 double, se double, chosen boolean")


@query()
def rrr_nse(spark: SparkSession, d: str) -> DataFrame:
    """Normalised squared error by rank, with penalties chosen inside each training set; chosen: smallest rank within one error of the least."""
    errors = M.nested_errors(_folds(spark, d), HALF, PENALTIES, RANKS)
    best = M.smallest_within_error(errors)
    se = errors.std(axis=0, ddof=1) / np.sqrt(len(errors))
    return spark.createDataFrame([(k, float(errors[:, j].mean()), float(se[j]), j == best) for j, k in enumerate(RANKS)], "rank long, nse double, se double, chosen boolean")


@query()
def rrr_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Rank and best R^2 over resampled channels: with replacement, and in disjoint halves. Resamples are sub-blocks of one moment matrix."""
    folds, rows = _folds(spark, d), []
    for sampling in ("replace", "disjoint"):
        for i in range(RESAMPLES):
            dice = np.random.default_rng([5, i])
            n = 12
            left, right = ((dice.integers(0, HALF, n), dice.integers(0, HALF, n)) if sampling == "replace" else (dice.permutation(HALF)[:n], dice.permutation(HALF)[:n]))
            own = {k: M.sub_moments(m, HALF, left, right) for k, m in folds.items()}
            scores = M.rank_scores(own, n, PENALTIES[::2], RANKS)
            mean, se = scores.mean(axis=2), scores.std(axis=2) / scores.shape[2]
            a = int(mean.max(axis=1).argmax())
            rows.append((sampling, i, RANKS[M.within_one_error(mean[a].tolist(), se[a].tolist())], float(mean[a].max())))
    return spark.createDataFrame(rows, "sampling string, resample long, rank long, r2 double")


@query()
def fa_dim_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Factors, shared dimensions and cumulative shares of each group's source and target half; groups with too few segments give nulls.

    So do segments that are not of two halves, which are counted in rows of their own.
    """

    def fit(grp: int, width: int, folds: dict[int, np.ndarray]) -> list[tuple]:
        n = int(sum(m[0, 0] for m in folds.values()))
        if n < 4 * (HALF // 4) or len(folds) < 2 or width != 2 * HALF:
            return [(grp, side, n, None, None, None) for side in ("source", "target")]
        rows = []
        for side, at in (("source", 0), ("target", HALF)):
            # block means of four samples, as the samples of a half are too many for a group's segments
            mix = np.zeros((1 + HALF // 4, 1 + 2 * HALF))
            mix[0, 0] = 1
            for b in range(HALF // 4):
                mix[1 + b, 1 + at + 4 * b : 1 + at + 4 * b + 4] = 0.25
            best, dims, values = M.factor_dimension({k: mix @ m @ mix.T for k, m in folds.items()}, 4)
            rows.append((grp, side, n, best, dims, M.padded_curve(values[: max(best, 1)], 6).tolist()))
        return rows

    s = segments(spark, d).withColumn("key", F.col("grp") * FOLDS + F.pmod("unit", F.lit(FOLDS)))
    return M.solved(M.moments(s, "key"), fit, "grp long, side string, n long, factors long, dimensions long, curve array<double>", FOLDS)


@query()
def trial_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Factors and shared dimensions of each segment taken as eight channels over time; short or incomplete segments give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [(None, None, None)] * batch.num_rows
            for rows, (x,) in matrices_by_length([batch.column("samples")]):
                if x.shape[1] % 8 or x.shape[1] < 64:
                    continue
                for row, v in zip(rows, x, strict=True):
                    t = np.hstack([np.ones((x.shape[1] // 8, 1)), v.reshape(-1, 8) if x.shape[1] // 8 >= 8 else v.reshape(8, -1).T])
                    best, dims, values = M.factor_dimension({k: t[k::2].T @ t[k::2] for k in range(2)}, 2, rounds=15)
                    out[row] = (best, dims, M.padded_curve(values[: max(best, 1)], 4).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=["unit", "factors", "dimensions", "curve"])

    return segments(spark, d).select("unit", "samples").repartition(16).mapInArrow(run, "unit long, factors long, dimensions long, curve array<double>")


@query()
def null_space_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Energy in the directions that the map uses and in the others, against a thousand permutations of the directions, by group.

    The map is of all segments of the commonest length; those of another one are counted in rows of their own, without energies.
    """
    found = saved(M.moments(segments(spark, d), "grp"))
    m = M.whole(found)
    potent, null = M.split_spaces(M.reduced_rank(m, HALF, 10.0, 3), scatter=M.covariance(m)[1][:HALF, :HALF]) if m is not None else (np.zeros((HALF, 0)), np.eye(HALF))
    every, r = np.hstack([potent, null]), potent.shape[1]
    picks = np.array([np.random.default_rng([3, i]).permutation(HALF)[:r] for i in range(N)])

    def fit(grp: int, width: int, own: dict[int, np.ndarray]) -> list[tuple]:
        n = int(own[0][0, 0])
        if width != len(m) - 1:
            return [(grp, n, r, None, None, None, None)]
        energy = np.diag(every.T @ M.covariance(own[0])[1][:HALF, :HALF] @ every)
        drawn = energy[picks].sum(axis=1)
        return [(grp, n, r, float(energy[:r].sum()), float(energy[r:].sum()), float(drawn.mean()), float(((drawn >= energy[:r].sum()).sum() + 1) / (N + 1)))]

    return M.solved(found, fit, "grp long, n long, rank long, potent double, outside double, permuted_mean double, p double")


@query()
def null_space_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Each group's mean segment, half by half, along the directions that the map uses and the others' three of greatest variance."""
    found = saved(M.moments(segments(spark, d), "grp"))
    m = M.whole(found)
    potent, null = M.split_spaces(M.reduced_rank(m, HALF, 10.0, 3), scatter=M.covariance(m)[1][:HALF, :HALF]) if m is not None else (None, None)

    def fit(grp: int, width: int, own: dict[int, np.ndarray]) -> list[tuple]:
        mean = own[0][0, 1:] / own[0][0, 0]
        halves, bases = (("first", mean[:HALF]), ("second", mean[HALF:])), (("potent", potent), ("null", null[:, :3]))
        return [(grp, epoch, space, k, float(v)) for epoch, part in halves for space, basis in bases for k, v in enumerate(basis.T @ part)] if width == len(m) - 1 else []

    return M.solved(found, fit, "grp long, epoch string, space string, direction long, value double")


@query()
def null_space_by_flag(spark: SparkSession, d: str) -> DataFrame:
    """Tuning ratio of a map between two populations of samples split by a flag (their variance above the median), overall and by sample.

    The rank is the first whose singular values hold more than 90 % of the variance. Groups count by their means, whose scatter is one
    more moment matrix.
    """
    schema = "sample long, rank long, potent double, outside double, ratio double"
    found = saved(M.moments(segments(spark, d), "grp"))
    whole = M.whole(found)
    if whole is None:
        return spark.createDataFrame([], schema)
    spread = np.diag(M.covariance(whole)[1])
    flag = spread > np.median(spread)
    source, target = np.flatnonzero(flag), np.flatnonzero(~flag)
    take = np.concatenate([[0], 1 + source, 1 + target])
    w = M.ridge(whole[np.ix_(take, take)], len(source), 10.0)
    left, value, _ = np.linalg.svd(w, full_matrices=True)
    rank = min(int((np.cumsum(value**2) / (value**2).sum() <= 0.9).sum()) + 1, len(source) - 1)
    means = M.solved(found, lambda grp, width, own: [(0, (own[0][0, 1:] / own[0][0, 0]).tolist())] if width == len(whole) - 1 else [], "zero long, samples array<double>")
    _, scatter, groups = M.covariance(M.whole(M.moments(means, "zero")))
    scatter = groups * scatter[np.ix_(source, source)]
    energy = lambda basis: float(np.trace(basis.T @ scatter @ basis))
    potent, null = left[:, :rank], left[:, rank:]
    gamma = null.shape[1] / potent.shape[1]
    rows = [(None, rank, energy(potent), energy(null), energy(null) / energy(potent) / gamma if energy(potent) > 0 else None)]
    for k, s in enumerate(source):
        own = [float(scatter[k, k] * (b[k] ** 2).sum()) for b in (potent, null)]
        rows.append((int(s), rank, *own, own[1] / own[0] / gamma if own[0] > 0 else None))
    return spark.createDataFrame(rows, schema)


@query()
def lme_interactions(spark: SparkSession, d: str) -> DataFrame:
    """Effect of clicks on log value in each of three groups of units, with random intercepts for units and weeks in them; Wald tests."""
    p = points(spark, d).where("value > 0").select("unit", F.pmod("unit", F.lit(3)).cast("long").alias("grp"), F.floor(F.col("t") / (7 * DAY)).alias("week"), (F.col("mark") == "click").cast("double").alias("x"), F.log("value").alias("y"))
    sums = [F.sum(c).alias(a) for a, c in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("xy", F.col("x") * F.col("y")), ("yy", F.col("y") * F.col("y")))]
    blocks = p.groupBy("grp", "unit", "week").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)
    units = blocks.groupBy("grp", "unit").agg(F.collect_list(F.struct("n", "x", "y", "xx", "xy", "yy")).alias("blocks"))
    fit = M.interaction_fit(units, "grp")
    joint = M.chi_square_tail(fit["wald"], max(len(fit["groups"]) - 1, 1))
    rows = [(g, float(b), float(s), float(b / s), M.chi_square_tail(float(b / s) ** 2, 1), joint, *fit["ratios"]) for g, b, s in zip(fit["groups"], fit["beta"], fit["se"], strict=True)]
    return spark.createDataFrame(rows, "grp long, beta double, se double, z double, p double, joint_p double, unit_ratio double, week_ratio double")


@query()
def decode_logistic(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of a logistic decoder of groups in each of three folds; folds without two groups to learn from give null."""
    s = segments(spark, d).select("unit", F.col("grp").cast("double").alias("label"), array_to_vector("samples").alias("features"), F.pmod(F.xxhash64("unit"), F.lit(3)).alias("fold"))
    out = None
    for fold in range(3):
        train, test = s.where(F.col("fold") != fold), s.where(F.col("fold") == fold)
        if train.select("label").distinct().count() < 2:
            one = test.select(F.lit(fold).alias("fold"), F.lit(None).cast("boolean").alias("hit"))
        else:
            model = LogisticRegression(maxIter=15, regParam=0.01).fit(train)
            one = model.transform(test).select(F.lit(fold).alias("fold"), (F.col("prediction") == F.col("label")).alias("hit"))
        one = one.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {SG}, v AS (SELECT unit, grp, h, unnest(x[h * 32 + 1 : h * 32 + 32]) AS v, unnest(range(32)) AS i FROM s CROSS JOIN range(2) k(h)), m AS (SELECT h, grp, i, avg(v) AS mu, var_pop(v) + 1e-9::DOUBLE AS va FROM v GROUP BY 1, 2, 3),
pr AS (SELECT grp, ln(count(*)::DOUBLE) AS lp FROM s GROUP BY 1), sc AS (SELECT m.h AS train, v.h AS test, v.unit, v.grp, m.grp AS guess, any_value(lp) - 0.5::DOUBLE * sum(ln(va) + (v - mu) * (v - mu) / va) AS score FROM v JOIN m ON m.i = v.i JOIN pr ON pr.grp = m.grp GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT *, row_number() OVER (PARTITION BY train, test, unit ORDER BY round(score, 6) DESC, guess) AS place FROM sc) SELECT train::BIGINT AS train, test::BIGINT AS test, count(*)::BIGINT AS n, round(avg(CASE WHEN guess = grp THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM b WHERE place = 1 GROUP BY 1, 2""")
def cross_temporal(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of a Gaussian decoder that is fitted on one half of the segments' time and scored on the other, and on its own."""
    s = segments(spark, d)
    by_group = M.matrices(M.moments(s, "grp"))
    fits = {g: (np.log(m[0, 0]), M.covariance(m)[0], np.diag(M.covariance(m)[1]) + 1e-9) for g, m in by_group.items()}
    groups = np.array(sorted(fits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, mean, var = (np.array([fits[g][i] for g in groups]) for i in range(3))
        for batch in batches:
            grp = np.asarray(batch.column("grp"))
            for rows, (x,) in matrices_by_length([batch.column("samples")]):
                for train in (0, 1):
                    for test in (0, 1):
                        a, b = slice(train * HALF, train * HALF + HALF), slice(test * HALF, test * HALF + HALF)
                        score = prior - 0.5 * (np.log(var[:, a]) + (x[:, None, b] - mean[:, a]) ** 2 / var[:, a]).sum(axis=2)
                        hit = groups[np.round(score, 6).argmax(axis=1)] == grp[rows]
                        yield pa.RecordBatch.from_pydict({"train": pa.array([train]), "test": pa.array([test]), "n": pa.array([len(rows)]), "hits": pa.array([int(hit.sum())])})

    found = s.select("grp", "samples").mapInArrow(run, "train long, test long, n long, hits long")
    return r6(found.groupBy("train", "test").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy")), "accuracy")


@query()
def poisson_glm_covariate(spark: SparkSession, d: str) -> DataFrame:
    """Counts by time of day and half of the recording in each unit: harmonic, covariate and their interactions, with the gain in deviance."""
    p = _phases(spark, d).select("unit", "phase", "t")
    middle = p.groupBy("unit").agg(((F.min("t") + F.max("t")) / 2).alias("middle"))
    bins = F.least(F.floor(F.col("phase") / (2 * np.pi / 24)), F.lit(23)).cast("int")
    cells = p.join(middle, "unit").groupBy("unit", (bins + F.when(F.col("t") > F.col("middle"), 24).otherwise(0)).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m")).select("unit", F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("double")).alias("counts"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        angle = 2 * np.pi * (np.arange(48) % 24 + 0.5) / 24
        late = (np.arange(48) >= 24).astype(float)
        x = np.stack([np.ones(48), np.sin(angle), np.cos(angle), late, late * np.sin(angle), late * np.cos(angle)], axis=1)
        for pdf in batches:
            out = []
            for unit, counts in zip(pdf["unit"], pdf["counts"], strict=True):
                y = np.asarray(counts)
                full, plain = M.poisson_glm(x, y, np.ones(48)), M.poisson_glm(x[:, :3], y, np.ones(48))
                gain = plain[2] - full[2]
                out.append((unit, full[0][3], full[1][3], gain, M.chi_square_tail(gain, 3), gain - 6))
            yield pd.DataFrame(out, columns=["unit", "covariate", "se", "lr", "p", "delta_aic"])

    return rows.mapInPandas(fit, "unit long, covariate double, se double, lr double, p double, delta_aic double")


@query()
def gmm_bic(spark: SparkSession, d: str) -> DataFrame:
    """Whether two normal parts describe each group's reaches better than one, by the Bayes criterion on their histogram."""
    w = _widths(spark, d)
    low, high = w.agg(F.min("w"), F.max("w")).first()
    step = max(((high or 0) - (low or 0)) / 200, 1e-12)
    cells = w.groupBy("grp", F.least(F.floor((F.col("w") - F.lit(low or 0.0)) / step), F.lit(199)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    rows = cells.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cells in batch.column("cells").to_pylist():
                centre, count = low + step * (np.array([c["k"] for c in cells]) + 0.5), np.array([c["c"] for c in cells], dtype=float)
                n = count.sum()
                normal = lambda m, s: np.exp(-0.5 * ((centre - m) / s) ** 2) / s / np.sqrt(2 * np.pi)  # noqa: E731, B023
                m = (count * centre).sum() / n
                sd = max(np.sqrt((count * (centre - m) ** 2).sum() / n), 1e-9)
                one = -2 * (count * np.log(normal(m, sd))).sum() + 2 * np.log(n)
                weight, means, sds = M.two_gaussians(centre, count)
                two = -2 * (count * np.log(sum(a * normal(b, c) for a, b, c in zip(weight, means, sds, strict=True)) + 1e-300)).sum() + 5 * np.log(n)
                out.append((int(n), float(one), float(two), bool(two < one)))
            yield pa.RecordBatch.from_arrays([batch.column("grp").cast(pa.int64()), *(pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.bool_())))], names=["grp", "n", "bic1", "bic2", "bimodal"])

    return rows.mapInArrow(run, "grp long, n long, bic1 double, bic2 double, bimodal boolean")


MATCHED = 40


@query(f"""WITH {EV}, k AS (SELECT unit % 3 AS kind, point_id, value, CASE WHEN row_number() OVER (PARTITION BY unit % 3 ORDER BY point_id) <= {MATCHED} THEN 'in' ELSE 'out' END AS mark FROM e WHERE mark = 'view' AND value IS NOT NULL), {shuffled_sql('k', 'kind')},
g AS (SELECT kind, rep, avg(value) AS m FROM pm WHERE mark = 'in' AND rep > 0 GROUP BY 1, 2)
SELECT kind, count(*)::BIGINT AS replicates, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(min(m), 6) AS low, round(max(m), 6) AS high FROM g GROUP BY 1""")
def matched_n_null(spark: SparkSession, d: str) -> DataFrame:
    """Mean of equally many values drawn from each kind of unit, over a thousand draws without replacement."""
    p = points(spark, d).where("mark = 'view' AND value IS NOT NULL").select(F.pmod("unit", F.lit(3)).alias("kind"), "point_id", "value")
    # the SQL hands the label of the smallest ids to the rows that come first in a draw: those with the smallest lots
    sums = B.drawn_sums(p, "kind", "point_id", "value", MATCHED, N).withColumn("m", F.col("s") / F.col("n"))
    return r6(sums.groupBy("kind").agg(F.count(F.lit(1)).alias("replicates"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.min("m").alias("low"), F.max("m").alias("high")), "mean", "sd", "low", "high")


@query()
def phase_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Mean direction and von Mises concentration of each unit's phases."""
    sums = _phases(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.avg(F.cos("phase")).alias("c"), F.avg(F.sin("phase")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, s = (np.asarray(batch.column(k)) for k in ("c", "s"))
            yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("n"), pa.array(np.arctan2(s, c) % (2 * np.pi)), pa.array(M.von_mises_concentration(np.hypot(c, s)))], names=["unit", "n", "direction", "kappa"])

    return sums.select("unit", "n", "c", "s").mapInArrow(run, "unit long, n long, direction double, kappa double")


@query(f"""WITH {SG}, p AS (SELECT a.grp, round(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 4) AS v FROM s a JOIN s b ON a.grp = b.grp AND a.unit < b.unit)
SELECT grp, count(*)::BIGINT AS pairs, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v), 6) AS low, round(max(v), 6) AS high FROM p GROUP BY 1""")
def group_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances between the segments of each group: mean, median and range, from counts by distance in ten-thousandths."""
    every = segments(spark, d)  # of segments with nulls or another length there is no distance
    s = usable(every.select("unit", "samples")).join(every.select("unit", F.col("grp").cast("long").alias("cell")), "unit").where("cell IS NOT NULL")
    counted = s.join(s.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell")
    cells = G.pair_distances(counted, 10_000)
    by = Window.partitionBy("grp")
    upto, n = F.sum("c").over(by.orderBy("v")), F.sum("c").over(by)
    placed = cells.select("grp", "v", "c", upto.alias("upto"), n.alias("n"))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("v")))
    middle = (at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2
    stats = placed.groupBy("grp").agg(F.sum("c").alias("pairs"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), middle.alias("median"), F.min("v").alias("low"), F.max("v").alias("high"))
    return stats.select("grp", "pairs", *[F.round(F.col(c) / 10_000, 6).alias(c) for c in ("mean", "median", "low", "high")])


@query(f"""WITH RECURSIVE {SG}, c AS (SELECT grp, list_position(x, list_max(x)) % 10 AS other, count(*) AS n FROM s WHERE grp IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2), r AS (SELECT grp, row_number() OVER (ORDER BY grp) AS row FROM (SELECT DISTINCT grp FROM c)),
d AS (SELECT row, b.other, coalesce(c.n, 0) AS n FROM r CROSS JOIN range(10) b(other) LEFT JOIN c ON c.grp = r.grp AND c.other = b.other),
best AS (SELECT 0::BIGINT AS row, 0::BIGINT AS used, 0::BIGINT AS total UNION ALL SELECT b.row + 1, b.used | (1::BIGINT << d.other), max(b.total + d.n)::BIGINT FROM best b JOIN d ON d.row = b.row + 1 AND (b.used & (1::BIGINT << d.other)) = 0 GROUP BY 1, 2)
SELECT (SELECT sum(n) FROM c)::BIGINT AS n, round((SELECT max(total) FROM best) / (SELECT sum(n) FROM c)::DOUBLE, 6) AS accuracy""")
def assignment_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of segments whose group agrees with a split by the place of their largest sample, under the best matching of the labels."""
    s = segments(spark, d).select("grp", F.pmod(F.array_position("samples", F.array_max("samples")), F.lit(10)).alias("other"))
    counts = s.where("grp IS NOT NULL AND other IS NOT NULL").groupBy("grp", "other").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.limit(LABEL_PAIRS + 1).collect()
    if len(cells) > LABEL_PAIRS:
        raise ValueError(f"more than {LABEL_PAIRS} pairs of labels to match")
    rows, columns = sorted({r["grp"] for r in cells}), sorted({r["other"] for r in cells})
    table = np.zeros((len(rows), len(columns)))
    for r in cells:
        table[rows.index(r["grp"]), columns.index(r["other"])] = r["n"]
    return r6(spark.createDataFrame([(int(table.sum()), float(M.best_assignment(table) / table.sum()))], "n long, accuracy double"), "accuracy")


@query(f"""WITH {EV}, g AS (SELECT unit, t, t - lag(t) OVER (PARTITION BY unit ORDER BY t, point_id) AS gap FROM e), a AS (SELECT unit, count(*)::DOUBLE AS n, count(*) FILTER (gap > 0 AND gap < {HOUR // 4})::DOUBLE AS viol, (max(t) - min(t))::DOUBLE / {HOUR}::DOUBLE AS span FROM g GROUP BY 1)
SELECT unit, n::BIGINT AS n, viol::BIGINT AS violations, CASE WHEN span > 0 THEN round(viol / (2 * n * 0.25::DOUBLE) / (n / span) * 100, 6) END AS percent FROM a""")
def violation_percent(spark: SparkSession, d: str) -> DataFrame:
    """Estimated contamination of each unit from gaps under a quarter of an hour, in percent of its rate."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("unit").orderBy("t", "point_id"))
    a = points(spark, d).select("unit", "t", gap.alias("gap")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("gap") > 0) & (F.col("gap") < HOUR // 4)).alias("violations"), ((F.max("t") - F.min("t")) / F.lit(float(HOUR))).alias("span"))
    percent = F.col("violations") / (2 * F.col("n") * 0.25) / (F.col("n") / F.col("span")) * 100
    return r6(a.select("unit", "n", "violations", F.when(F.col("span") > 0, percent).alias("percent")), "percent")


@query("SELECT doc_id, coalesce(toxic = 1, false) AS bad FROM labels")
def flag_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows that any of the candidate flags marks; candidates that the table lacks are left out."""
    labels = table(spark, d, "labels")
    return labels.select("doc_id", any_flag(labels, ["bad", "toxic", "flagged"]).alias("bad"))


@query()
def sparse_targets(spark: SparkSession, d: str) -> DataFrame:
    """For each sample of the second half, the sparse map from the first half: its penalty by cross-validation, R^2 and weights in use."""
    folds = _folds(spark, d)
    whole = sum(folds.values())
    penalties = [float(p) for p in np.geomspace(1e-5, 1e-1, 7)]
    scores = np.array([np.mean([M.target_r_squared(m, whole - m, HALF, M.lasso(whole - m, HALF, a)) for m in folds.values()], axis=0) for a in penalties])
    best = scores.argmax(axis=0)
    used = [(np.abs(M.lasso(whole, HALF, a)) > 0).sum(axis=0) for a in penalties]
    return spark.createDataFrame([(j, penalties[b], float(scores[b, j]), int(used[b][j])) for j, b in enumerate(best)], "target long, penalty double, r2 double, used long")


LEVELS = (0.0, 20.0, 40.0, 60.0, 80.0, 400.0)


@query(f"""WITH {EV}, k AS (SELECT * FROM (VALUES {', '.join(f'({v}::DOUBLE)' for v in LEVELS)}) t(level)), g AS (SELECT level, count(value) FILTER (mark = 'click') AS a, count(value) FILTER (mark = 'view') AS b, avg(value) FILTER (mark = 'click') - avg(value) FILTER (mark = 'view') AS effect FROM e JOIN k ON value >= level GROUP BY 1)
SELECT level, a::BIGINT AS n_click, b::BIGINT AS n_view, round(effect, 6) AS effect FROM g WHERE a >= 5 AND b >= 5""")
def threshold_titration(spark: SparkSession, d: str) -> DataFrame:
    """Click against view values among the points at or above each of several levels; levels with fewer than five of either drop out.

    One pass counts each point at the levels that it reaches; the sums of nested subsets are partial before the shuffle.
    """
    p = points(spark, d).where("mark IN ('click', 'view') AND value IS NOT NULL")
    reached = p.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, LEVELS)), lambda v: F.col("value") >= v)))
    of = lambda m: F.when(F.col("mark") == m, F.col("value"))
    found = reached.groupBy("level").agg(F.count(of("click")).alias("n_click"), F.count(of("view")).alias("n_view"), (F.avg(of("click")) - F.avg(of("view"))).alias("effect"))
    return r6(found.where("n_click >= 5 AND n_view >= 5"), "effect")


@query(f"""WITH {PH}, q AS (SELECT unit, mark, ph, point_id FROM p WHERE mark IN ('click', 'view')), k AS (SELECT unit, min(c) AS n FROM (SELECT unit, mark, count(*) AS c FROM q GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 2),
o AS (SELECT q.unit, q.mark, q.ph, k.n, r.rep, row_number() OVER (PARTITION BY q.unit, q.mark, r.rep ORDER BY {lot_of('q.point_id')}, q.point_id) AS place FROM q JOIN k ON k.unit = q.unit CROSS JOIN range(1, 201) r(rep)),
v AS (SELECT unit, mark, rep, any_value(n) AS n, sqrt(pow(sum(cos(ph)), 2) + pow(sum(sin(ph)), 2)) / any_value(n) AS mvl FROM o WHERE place <= n GROUP BY 1, 2, 3)
SELECT unit, mark, max(n)::BIGINT AS n, round(avg(mvl), 6) AS mvl FROM v GROUP BY 1, 2""")
def equalised_mvl_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean phase vectors of clicks and views drawn down to the smaller count, over 200 draws; units without both drop out."""
    p = _phases(spark, d).where("mark IN ('click', 'view')").select("unit", "mark", "phase", "point_id")
    least = p.groupBy("unit", "mark").agg(F.count(F.lit(1)).alias("c")).groupBy("unit").agg(F.min("c").alias("n"), F.count(F.lit(1)).alias("both")).where("both = 2").select("unit", "n")
    place = F.row_number().over(Window.partitionBy("unit", "mark").orderBy("point_id"))
    dealt = p.withColumn("k", place).join(least, "unit").withColumn("side", F.when(F.col("k") <= F.col("n"), "in").otherwise("out"))
    # the same strata and keys give both sums the same draws
    part = lambda f, name: B.permuted_sums(dealt.select("unit", "mark", "side", "point_id", f("phase").alias("v")), ["unit", "mark"], "side", "point_id", "v", 200).where("side = 'in' AND replicate > 0").select("unit", "mark", "replicate", "n", F.col("s").alias(name))
    sums = part(F.cos, "c").join(part(F.sin, "s").drop("n"), ["unit", "mark", "replicate"])
    length = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n")
    return sums.groupBy("unit", "mark").agg(F.max("n").alias("n"), F.round(F.avg(length), 6).alias("mvl"))
