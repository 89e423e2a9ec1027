"""Model queries: moments, projections, reduced rank, factors, phases, mixtures, graphs. Most have no SQL; tests check them in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.operators import discriminants as D
from intervale.operators import graph as G
from intervale.operators import neighbours as N
from intervale.operators import layout as L
from intervale.operators import models as M
from intervale.operators import relational as R
from intervale.operators import trees as B
from intervale.operators import tuning as T
from intervale.operators.chunks import matrices_by_length
from intervale.plans.events import EV, _acg, r6
from intervale.plans.registry import query
from intervale.plans.segments import SG, _phases, _widths
from intervale.sources.scratch import saved
from intervale.sources.tables import points, segments, table

FOLDS = 5


def _folds(spark: SparkSession, d: str) -> dict[int, np.ndarray]:
    return M.matrices(M.moments(segments(spark, d).withColumn("fold", F.pmod("unit", F.lit(FOLDS))), "fold"))


@query(f"""WITH {SG}, v AS (SELECT grp, list_concat([1.0::DOUBLE], x) AS z FROM s), p AS (SELECT grp, i, j, sum(z[i + 1] * z[j + 1]) AS total FROM v CROSS JOIN range(65) a(i) CROSS JOIN range(65) b(j) GROUP BY 1, 2, 3)
SELECT grp::BIGINT AS grp, i::BIGINT AS i, j::BIGINT AS j, round(total, 6) AS total FROM p WHERE i <= j""")
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Sums of products of (1, samples) in each group."""
    found = M.moments(segments(spark, d), "grp")
    i, j = F.floor(F.col("cell") / (F.col("width") + 1)), F.pmod(F.col("cell").cast("long"), F.col("width") + 1)
    return found.select(F.col("key").alias("grp"), i.alias("i"), j.alias("j"), F.round("total", 6).alias("total")).where("i <= j")


@query()
def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every segment on the three leading components."""
    s = segments(spark, d)
    mean, parts, _ = M.principal(sum(_folds(spark, d).values()), 3)
    return M.projected(s, mean, parts, "pc")


@query()
def pca_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Participation ratio and the dimensions that hold 90 % of the variance, by group and length of its segments, centred or not."""

    def fit(grp: int, width: int, own: dict[int, np.ndarray]) -> list[tuple]:
        values = [(centred, M.principal(own[0], 1, centred)[2].clip(0)) for centred in (True, False)]
        return [(grp, width, int(own[0][0, 0]), centred, M.participation_ratio(v), M.dimension(v, 0.9)) if v.sum() > 0 else (grp, width, int(own[0][0, 0]), centred, None, None) for centred, v in values]

    return M.solved(M.moments(segments(spark, d), "grp"), fit, "grp long, width long, n long, centred boolean, participation double, dimensions long")


@query()
def ridge_map_cv(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated fit of the second half of a segment from its first half, by ridge penalty."""
    folds = _folds(spark, d)
    rows = [(float(p), *M.cross_validated(folds, lambda train, test, p=p: M.r_squared(test, train, 32, M.ridge(train, 32, p)))) for p in 10.0 ** np.arange(-2, 4)]
    return spark.createDataFrame(rows, "penalty double, r2 double, se double")


@query()
def rrr_cs_dim(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated fit by rank of the map, and the smallest rank within one standard error of the best."""
    folds = _folds(spark, d)
    found = [M.cross_validated(folds, lambda train, test, k=k: M.r_squared(test, train, 32, M.reduced_rank(train, 32, 10.0, k))) for k in range(1, 11)]
    best = M.within_one_error([f[0] for f in found], [f[1] for f in found])
    return spark.createDataFrame([(k + 1, *f, k == best) for k, f in enumerate(found)], "rank long, r2 double, se double, chosen boolean")


@query()
def fa_dim(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated likelihood of factor models by number of factors; the best, and the dimensions of its shared covariance."""
    folds = _folds(spark, d)
    whole = sum(folds.values())
    fits = []
    for q in range(7):
        fits.append(M.cross_validated(folds, lambda train, test, q=q: M.gaussian_fit(*M.factor_analysis(M.covariance(train)[1], q), train, test))[0])
    best = int(np.argmax(fits))
    load, _ = M.factor_analysis(M.covariance(whole)[1], max(best, 1))
    values = np.sort(np.linalg.eigvalsh(load @ load.T))[::-1].clip(0)
    return spark.createDataFrame([(q, float(f), q == best, M.dimension(values, 0.95) if q == best else None) for q, f in enumerate(fits)], "factors long, likelihood double, chosen boolean, shared_dimensions long")


@query()
def poisson_glm_phase(spark: SparkSession, d: str) -> DataFrame:
    """Each unit's counts by time of day: preferred phase, deviance and the likelihood-ratio statistic of a single harmonic."""
    bins = F.least(F.floor(F.col("phase") / (2 * np.pi / 24)), F.lit(23)).cast("int")
    counts = _phases(spark, d).groupBy("unit", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n")).groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    rows = counts.select("unit", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("double")).alias("counts"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                b, deviance, null = M.poisson_phase(np.stack(pdf["counts"].to_numpy()))
                yield pd.DataFrame({"unit": pdf["unit"], "preferred": np.arctan2(b[:, 1], b[:, 2]) % (2 * np.pi), "strength": np.hypot(b[:, 1], b[:, 2]), "deviance": deviance, "lr": null - deviance, "p": np.exp(-np.maximum(null - deviance, 0) / 2), "delta_aic": null - deviance - 4})

    return rows.mapInPandas(fit, "unit long, preferred double, strength double, deviance double, lr double, p double, delta_aic double")


@query()
def gmm_antimode(spark: SparkSession, d: str) -> DataFrame:
    """Segments on either side of the valley between the two normal parts of the reaches' histogram."""
    w = _widths(spark, d)
    low, high = w.agg(F.min("w"), F.max("w")).first()
    if low is None:
        return w.select("unit", F.lit("invalid").alias("side"))
    step = max((high - low) / 200, 1e-12)
    cells = w.groupBy(F.least(F.floor((F.col("w") - low) / step), F.lit(199)).alias("k")).agg(F.count(F.lit(1)).alias("c")).orderBy("k").collect()  # 200 rows at most
    split = M.antimode(*M.two_gaussians(low + step * (np.array([r["k"] for r in cells]) + 0.5), np.array([r["c"] for r in cells], dtype=float)))
    return w.select("unit", F.when(F.col("w") < split, "narrow").when(F.col("w") >= split, "broad").otherwise("invalid").alias("side"))


RATIOS = [0.0, *(2.0 ** np.arange(-10, 4)).tolist()]


@query(f"""WITH {EV}, p AS (SELECT unit, (mark = 'click')::INT::DOUBLE AS x, ln(value) AS y FROM e WHERE value > 0), u AS (SELECT unit, count(*)::DOUBLE AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM p GROUP BY 1),
r AS (SELECT unnest({RATIOS}::DOUBLE[]) AS ratio), w AS (SELECT *, ratio / (1 + ratio * n) AS w FROM u CROSS JOIN r),
c AS (SELECT ratio, sum(n) - 2 AS free, sum(n - w * n * n) AS nn, sum(x - w * n * x) AS nx, sum(y - w * n * y) AS ny, sum(xx - w * x * x) AS xx, sum(xy - w * x * y) AS xy, sum(yy - w * y * y) AS yy, sum(ln(1 + ratio * n)) AS ld FROM w GROUP BY 1),
b AS (SELECT *, nn * xx - nx * nx AS det, (xx * ny - nx * xy) / (nn * xx - nx * nx) AS b0, (nn * xy - nx * ny) / (nn * xx - nx * nx) AS b1 FROM c), k AS (SELECT *, (yy - b0 * ny - b1 * xy) / free AS scale FROM b),
l AS (SELECT ratio, b1, sqrt(scale * nn / det) AS se, -0.5::DOUBLE * (free * ln(scale) + ld + ln(det)) AS likelihood FROM k)
SELECT ratio, round(b1, 6) AS beta, round(se, 6) AS se, round(likelihood, 6) AS likelihood, row_number() OVER (ORDER BY likelihood DESC, ratio) = 1 AS chosen FROM l""")
def lme_beta(spark: SparkSession, d: str) -> DataFrame:
    """Effect of clicks against other marks on log value, with a random intercept per unit, by restricted likelihood."""
    p = points(spark, d).where("value > 0").select("unit", (F.col("mark") == "click").cast("double").alias("x"), F.log("value").alias("y"))
    sums = p.groupBy("unit").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(a) for a, c in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("xy", F.col("x") * F.col("y")), ("yy", F.col("y") * F.col("y")))])
    found = M.random_intercept(sums, RATIOS)
    best = max(found, key=lambda r: r["likelihood"])
    return r6(spark.createDataFrame([(r["ratio"], r["beta"], r["se"], r["likelihood"], r is best) for r in found], "ratio double, beta double, se double, likelihood double, chosen boolean"), "beta", "se", "likelihood")


@query()
def acg_fit(spark: SparkSession, d: str) -> DataFrame:
    """Rise and decay times of each unit's autocorrelogram after lag 0, in hours."""
    right = _acg(spark, d).where("bin >= 24").groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda s: s["n"].cast("double")).alias("y"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lag = np.arange(24) + 0.5
        for pdf in batches:
            found = [M.fitted_shape(lag, np.asarray(y)) for y in pdf["y"]]
            yield pd.DataFrame({"unit": pdf["unit"], "decay": [p[0] for p, _ in found], "rise": [p[1] for p, _ in found], "refractory": [p[4] for p, _ in found], "rate": [p[7] for p, _ in found], "r2": [r for _, r in found]})

    return right.mapInPandas(fit, "unit long, decay double, rise double, refractory double, rate double, r2 double")


@query(f"""WITH {SG}, v AS (SELECT unit, grp, unit % {FOLDS} AS fold, unnest(x) AS v, unnest(range(len(x))) AS i FROM s), m AS (SELECT f.f AS fold, grp, i, avg(v) AS mu, avg(v * v) - avg(v) * avg(v) + 1e-9::DOUBLE AS va, ln(count(*)::DOUBLE) AS lp FROM v CROSS JOIN range({FOLDS}) f(f) WHERE v.fold <> f.f GROUP BY 1, 2, 3),
sc AS (SELECT v.fold, v.unit, v.grp, m.grp AS guess, any_value(lp) - 0.5::DOUBLE * sum(ln(va) + (v - mu) * (v - mu) / va) AS score FROM v JOIN m ON m.fold = v.fold AND m.i = v.i GROUP BY 1, 2, 3, 4), b AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(score, 6) DESC, guess) AS place FROM sc)
SELECT fold::BIGINT AS fold, count(*)::BIGINT AS n, round(avg(CASE WHEN guess = grp THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM b WHERE place = 1 GROUP BY 1""")
def decode_classes(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated accuracy of a Gaussian naive classifier of groups, from sums by fold and group."""
    s = segments(spark, d).withColumn("fold", F.pmod("unit", F.lit(FOLDS)))
    folds = {k: m for k, m in M.matrices(M.moments(s.withColumn("key", F.col("grp") * FOLDS + F.col("fold")), "key")).items()}
    groups = sorted({k // FOLDS for k in folds})
    models = {}
    for fold in range(FOLDS):
        own = {g: [m for k, m in folds.items() if k // FOLDS == g and k % FOLDS != fold] for g in groups}
        models[fold] = {g: (np.log(sum(m)[0, 0]), *[M.covariance(sum(m))[0], np.diag(M.covariance(sum(m))[1]) + 1e-9]) for g, m in own.items() if m}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, grp = np.asarray(batch.column("fold")), np.asarray(batch.column("grp"))
            for rows, (x,) in matrices_by_length([batch.column("samples")]):
                for f in np.unique(fold[rows]):
                    own = rows[fold[rows] == f]
                    names, fits = list(models[f]), list(models[f].values())
                    if not names or x.shape[1] != len(fits[0][1]):
                        hit = np.zeros(len(own), bool)
                    else:
                        prior, mean, var = (np.array([v[i] for v in fits]) for i in range(3))
                        score = prior - 0.5 * (np.log(var) + (x[fold[rows] == f][:, None] - mean) ** 2 / var).sum(axis=2)
                        hit = np.array(names)[np.round(score, 6).argmax(axis=1)] == grp[own]
                    yield pa.RecordBatch.from_pydict({"fold": pa.array([int(f)]), "n": pa.array([len(own)]), "hits": pa.array([int(hit.sum())])})

    found = s.select("fold", "grp", "samples").mapInArrow(decode, "fold long, n long, hits long")
    return r6(found.groupBy("fold").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy")), "accuracy")


K = 8


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return N.nearest_of_all(segments(spark, d), K, saved)


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return saved(G.symmetric(G.fuzzy_weights(_graph(spark, d), K)))


@query(f"""WITH {SG}, g AS (SELECT a.unit AS src, b.unit AS dst, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS far FROM s a JOIN s b ON a.unit <> b.unit WHERE a.unit % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(far, 9), dst) AS place FROM g) SELECT src, dst, place, round(far, 6) AS distance FROM r WHERE place <= {K}""")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    """The nearest segments of every hundredth one, against all of them."""
    s = segments(spark, d)
    return r6(N.nearest(s, s.where("unit % 100 = 0"), K).select("src", "dst", "place", "distance"), "distance")


@query()
def fuzzy_weights(spark: SparkSession, d: str) -> DataFrame:
    """The graph of every segment's nearest ones with membership weights, made symmetric."""
    return G.symmetric(G.fuzzy_weights(_graph(spark, d), K))


@query(f"""WITH {SG}, g AS (SELECT a.unit AS src, b.unit AS dst, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS far FROM s a JOIN s b ON a.unit <> b.unit),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(far, 9), dst) AS place FROM g), ed AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM r WHERE place <= {K}),
m AS (SELECT p.grp AS a, q.grp AS b FROM ed JOIN s p ON p.unit = ed.src JOIN s q ON q.unit = ed.dst), k AS (SELECT l, count(*)::DOUBLE AS k FROM (SELECT a AS l FROM m UNION ALL SELECT b FROM m) GROUP BY 1)
SELECT round((SELECT avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) FROM m) - (SELECT sum(k * k) FROM k) / (4 * (SELECT count(*)::DOUBLE FROM m) * (SELECT count(*)::DOUBLE FROM m)), 6) AS modularity""")
def graph_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the groups on the unweighted graph."""
    edges = _graph(spark, d).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("w", F.lit(1.0))
    return r6(G.modularity(edges, segments(spark, d).select("unit", F.col("grp").alias("label"))), "modularity")


@query()
def louvain_labels(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the weighted graph of all segments, by levels of greedy modularity moves."""
    return G.communities(_weighted(spark, d), saved).select("unit", "label")


@query()
def resolution_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Number of communities and their modularity by resolution, on one graph."""
    edges, rows = _weighted(spark, d), None
    found = saved(G.communities(edges, saved, [0.5, 2.0]))
    for gamma in (0.5, 2.0):
        own = found.where(F.col("resolution") == gamma)
        one = G.modularity(edges, own.select("unit", "label")).join(own.agg(F.countDistinct("label").alias("clusters"))).select(F.lit(gamma).alias("resolution"), "clusters", "modularity")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query()
def spectral_split(spark: SparkSession, d: str) -> DataFrame:
    """Two sides of the weighted graph of all segments by the second eigenvector."""
    return G.bisected(_weighted(spark, d), saved)


@query()
def eigengap_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """The smallest eigenvalues of the graph's normalised Laplacian, and the gap to the next one."""
    _, values = G.spectral_embedding(_weighted(spark, d), 8, saved)
    small = np.sort(1 - values)
    return spark.createDataFrame([(i, float(v), float(small[i + 1] - v) if i + 1 < len(small) else None) for i, v in enumerate(small)], "place long, eigenvalue double, gap double")


def _clustered(embedding: DataFrame, k: int, seed: int) -> DataFrame:
    """Clusters by k-means on the first ``k`` coordinates of each unit, scaled to length one."""
    own = F.slice("x", 1, k)
    length = F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, v: a + v * v))
    rows = embedding.select("unit", array_to_vector(F.transform(own, lambda v: v / F.greatest(length, F.lit(1e-300)))).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=40).fit(rows).transform(rows).select("unit", F.col("prediction").cast("long").alias("cluster"))


@query()
def spectral_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of all segments by k-means on the leading eigenvectors of the graph."""
    embedding, _ = G.spectral_embedding(_weighted(spark, d), 4, saved)
    return _clustered(saved(embedding), 4, 1)


@query()
def spectral_stability(spark: SparkSession, d: str) -> DataFrame:
    """Mean adjusted Rand index between the clusterings of three seeds, by number of clusters."""
    embedding, _ = G.spectral_embedding(_weighted(spark, d), 4, saved)
    embedding, rows = saved(embedding), []
    for k in (2, 3, 4):
        runs = [_clustered(embedding, k, seed).withColumnRenamed("cluster", f"c{seed}") for seed in (1, 2, 3)]
        joined = saved(runs[0].join(runs[1], "unit").join(runs[2], "unit"))
        scores = [R.adjusted_rand(joined, f"c{a}", f"c{b}").first()["ari"] for a, b in ((1, 2), (1, 3), (2, 3))]
        rows.append((k, float(np.mean(scores))))
    return spark.createDataFrame(rows, "clusters long, stability double")


@query()
def null_space_split(spark: SparkSession, d: str) -> DataFrame:
    """Variance of the first half of the segments in the directions that a rank-3 map to the second half uses, and in the others, by group.

    The map is of all segments of the commonest length; those of another one are counted in rows of their own, without variances.
    """
    found = saved(M.moments(segments(spark, d), "grp"))
    m = M.whole(found)
    potent, null = M.split_spaces(M.reduced_rank(m, 32, 10.0, 3), scatter=M.covariance(m)[1][:32, :32]) if m is not None else (None, None)

    def fit(grp: int, width: int, own: dict[int, np.ndarray]) -> list[tuple]:
        n, r = int(own[0][0, 0]), potent.shape[1]
        if width != len(m) - 1:
            return [(grp, n, r, None, None, None)]
        cov = M.covariance(own[0])[1][:32, :32]
        energy = [float(np.trace(b.T @ cov @ b)) for b in (potent, null)]
        return [(grp, n, r, *energy, energy[1] / energy[0] / (null.shape[1] / r) if energy[0] > 0 else None)]

    return M.solved(found, fit, "grp long, n long, rank long, potent double, outside double, ratio double")


@query("""WITH t AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS a, count(*) FILTER (quality = 0 AND toxic = 1) AS b, count(*) FILTER (quality = 1 AND toxic = 0) AS c, count(*) FILTER (quality = 1 AND toxic = 1) AS d FROM labels WHERE quality IN (0, 1) AND toxic IN (0, 1)),
r AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS x FROM t), h AS (SELECT *, lgamma(x + 1) + lgamma(a + b - x + 1) + lgamma(a + c - x + 1) + lgamma(d - a + x + 1) AS l, lgamma(a + 1) + lgamma(b + 1) + lgamma(c + 1) + lgamma(d + 1) AS o,
lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS f FROM r)
SELECT any_value(a)::BIGINT AS n00, any_value(b)::BIGINT AS n01, any_value(c)::BIGINT AS n10, any_value(d)::BIGINT AS n11, round(least(1.0::DOUBLE, sum(exp(f - l)) FILTER (l >= o - 1e-7)), 6) AS p FROM h""")
def fisher_labels(spark: SparkSession, d: str) -> DataFrame:
    """Exact test of the two labels' independence: four counts, then a sum over the tables with the same margins."""
    cells = table(spark, d, "labels").where("quality IN (0, 1) AND toxic IN (0, 1)").groupBy().agg(*[F.count_if((F.col("quality") == a) & (F.col("toxic") == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(p=[round(M.fisher_exact(*map(int, r)), 6) for r in pdf[["n00", "n01", "n10", "n11"]].to_numpy()])

    return cells.mapInPandas(test, "n00 long, n01 long, n10 long, n11 long, p double")


@query(f"""WITH {SG}, c AS (SELECT grp AS l, count(*) AS n, avg(list_sum(list_transform(x, lambda v: v * v))) AS q FROM s WHERE grp IS NOT NULL GROUP BY 1), e AS (SELECT grp AS l, unnest(x) AS v, unnest(range(len(x))) AS i FROM s WHERE grp IS NOT NULL),
m AS (SELECT l, list(m ORDER BY i) AS m FROM (SELECT l, i, avg(v) AS m FROM e GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT s.unit, s.grp, c.l, c.n, greatest(list_sum(list_transform(s.x, lambda v: v * v)) - 2 * list_inner_product(s.x, m.m) + c.q, 0) AS d FROM s CROSS JOIN c JOIN m ON m.l = c.l WHERE s.grp IS NOT NULL),
r AS (SELECT unit, grp, max(CASE WHEN l = grp AND n > 1 THEN d * n / (n - 1) END) AS own, min(CASE WHEN l <> grp THEN d END) AS other FROM f GROUP BY 1, 2)
SELECT grp, count(*)::BIGINT AS n, round(avg(CASE WHEN own IS NULL OR other IS NULL OR greatest(own, other) = 0 THEN 0 ELSE (other - own) / greatest(own, other) END), 6) AS silhouette FROM r GROUP BY 1""")
def group_silhouettes(spark: SparkSession, d: str) -> DataFrame:
    """Mean silhouette of the segments of each group, by squared distance, from sums by group."""
    found = T.silhouettes(segments(spark, d).withColumnRenamed("grp", "label"), saved)
    return r6(found.groupBy(F.col("label").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette")), "silhouette")


@query()
def tuning_grid(spark: SparkSession, d: str) -> DataFrame:
    """Clusterings of all segments by number of neighbours and resolution: clusters, modularity, silhouette, stability, profiles and shares."""
    s = segments(spark, d)
    features = s.select("unit", "grp", (F.array_max("samples") - F.array_min("samples")).alias("reach"), F.array_position("samples", F.array_min("samples")).cast("double").alias("trough"), F.array_max("samples").alias("top"))
    return T.grid(s, features, ["reach", "trough", "top"], "grp", [8, 15], [1.0], [1, 2], saved)


@query()
def sample_importance(spark: SparkSession, d: str) -> DataFrame:
    """How much each sample tells of a segment's group (of three), by boosted trees: mean absolute attribution, and five-fold accuracy."""
    rows = segments(spark, d).select("unit", "samples", (F.col("grp") % 3).alias("label"))
    return r6(B.importance(rows, saved, rounds=3, n_bins=8), "mean_abs", "accuracy")


def _three_groups(spark: SparkSession, d: str) -> DataFrame:
    return D.stratified(segments(spark, d).select("unit", "samples", (F.col("grp") % 3).alias("label")), 5, saved)


@query()
def decode_discriminant(spark: SparkSession, d: str) -> DataFrame:
    """Rows and hits of linear discriminants of three groups of segments, by fold."""
    return D.decode_discriminant(_three_groups(spark, d), 5)


@query()
def decode_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Rows and hits of machines with a radial kernel on three groups of segments, by fold."""
    return D.decode_kernel(_three_groups(spark, d), 5, size=64)


@query()
def graph_layout(spark: SparkSession, d: str) -> DataFrame:
    """Places of all segments in a plane, by the weighted graph of their nearest ones."""
    s = segments(spark, d)
    return L.laid_out(_weighted(spark, d), L.started(s, saved), saved, epochs=10)
