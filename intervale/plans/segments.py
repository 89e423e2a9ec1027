"""Queries over ``embeddings`` as sampled segments, and over the phases of ``events``."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.functions import arrays as A
from intervale.functions import circular as C
from intervale.operators import quantiles as Q
from intervale.operators.chunks import by_row
from intervale.plans.events import EV, onsets, r6
from intervale.plans.registry import query
from intervale.sources.scratch import saved
from intervale.sources.tables import DAY, points, segments

SG = "s AS (SELECT vec_id AS unit, label AS grp, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
RATE = 64.0
TAU = 2 * math.pi


def listed(x: Column) -> Column:
    """An array of doubles as text, rounded."""
    return F.array_join(F.transform(x, lambda v: F.format_string("%.5f", F.round(v, 5) + F.lit(0.0))), ",")


L5 = "array_to_string(list_transform({}, lambda v: printf('%.5f', round(v, 5) + 0.0)), ',')"


@query(f"""WITH {SG}, a AS (SELECT *, list_position(x, list_min(x)) AS tr FROM s), b AS (SELECT *, x[tr:len(x)] AS r FROM a), c AS (SELECT *, tr + list_position(r, list_max(r)) - 1 AS pk FROM b)
SELECT unit, tr::BIGINT AS trough, pk::BIGINT AS peak, CASE WHEN tr < len(x) THEN round((pk - tr) / {RATE}::DOUBLE, 6) END AS trough_to_peak, CASE WHEN tr < len(x) THEN round(abs(x[pk] / x[tr]), 6) END AS ratio, round(list_max(x) - list_min(x), 6) AS reach FROM c""")
def waveform_shape(spark: SparkSession, d: str) -> DataFrame:
    """Trough, the peak after it, the time between them, their ratio and the reach of each segment; none if the trough is last."""
    s = segments(spark, d)
    at = A.argmin(F.col("samples"))
    found = s.withColumn("trough", at).withColumn("rest", F.slice("samples", F.col("trough").cast("int"), F.size("samples"))).withColumn("peak", F.col("trough") + A.argmax(F.col("rest")) - 1)
    inside = F.col("trough") < F.size("samples")
    ratio = F.abs(F.element_at("samples", F.col("peak").cast("int")) / F.element_at("samples", F.col("trough").cast("int")))
    return r6(found.select("unit", "trough", "peak", F.when(inside, (F.col("peak") - F.col("trough")) / RATE).alias("trough_to_peak"), F.when(inside, ratio).alias("ratio"), A.reach(F.col("samples")).alias("reach")), "trough_to_peak", "ratio", "reach")


@query(f"""WITH {SG}, a AS (SELECT *, list_position(x, list_min(x)) AS tr FROM s), c AS (SELECT unit, list_transform(range(-8, 16), lambda k: x[least(greatest(tr + k, 1), len(x))]) AS y FROM a),
n AS (SELECT unit, list_transform(y, lambda v: v - list_sum(y) / 24.0::DOUBLE) AS y FROM c) SELECT unit, {L5.format('list_transform(y, lambda v: v / greatest(list_max(y), -list_min(y)))')} AS samples FROM n""")
def waveform_crop_norm(spark: SparkSession, d: str) -> DataFrame:
    """24 samples around the trough, centred and scaled to their largest absolute value."""
    cropped = segments(spark, d).select("unit", A.cropped(F.col("samples"), 8, 16).alias("y"))
    m = cropped.select("unit", "y", A.mean(F.col("y")).alias("m")).select("unit", "y", "m", F.greatest(F.array_max("y") - F.col("m"), F.col("m") - F.array_min("y")).alias("top"))
    return m.select("unit", listed(F.transform("y", lambda v: (v - F.col("m")) / F.col("top"))).alias("samples"))


@query(f"""WITH {SG} SELECT unit, {L5.format('list_transform(x, lambda v: (v - list_sum(x) / len(x)) / (list_max(x) - list_min(x)))')} AS samples FROM s""")
def row_range_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Each segment less its mean, over its reach."""
    s = segments(spark, d).select("unit", "samples", A.mean(F.col("samples")).alias("m"), A.reach(F.col("samples")).alias("r"))
    return s.select("unit", listed(F.transform("samples", lambda v: (v - F.col("m")) / F.col("r"))).alias("samples"))


@query(f"""WITH {SG} SELECT unit, {L5.format('list_transform(range(8), lambda i: list_sum(x[i * 8 + 1 : i * 8 + 8]) / 8.0::DOUBLE)')} AS samples FROM s""")
def block_average(spark: SparkSession, d: str) -> DataFrame:
    """Means of blocks of eight samples."""
    return segments(spark, d).select("unit", listed(A.block_means(F.col("samples"), 8)).alias("samples"))


@query(f"""WITH {SG}, b AS (SELECT *, (list_sort(x[1:8])[4] + list_sort(x[1:8])[5]) / 2 AS md FROM s)
SELECT unit, {L5.format('list_transform(x, lambda v: (v - md) * CASE WHEN abs(list_max(x) - md) > abs(list_min(x) - md) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)')} AS samples FROM b""")
def polarity_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Segments less the median of their first eight samples, turned so that the largest deflection is negative."""
    s = segments(spark, d).withColumn("_o", F.array_sort(F.slice("samples", 1, 8))).withColumn("_m", (F.get("_o", 3) + F.get("_o", 4)) / 2)
    s = s.withColumn("_s", F.when(F.abs(F.array_max("samples") - F.col("_m")) > F.abs(F.array_min("samples") - F.col("_m")), -1.0).otherwise(1.0))
    return s.select("unit", listed(F.transform("samples", lambda v: (v - F.col("_m")) * F.col("_s"))).alias("samples"))


WD = f"{SG}, w AS (SELECT unit, grp, list_max(x) - list_min(x) AS w FROM s)"


def _widths(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("unit", "grp", A.reach(F.col("samples")).alias("w"))


@query(f"WITH {WD}, m AS (SELECT median(w) AS md FROM w) SELECT unit, CASE WHEN w < md THEN 'narrow' WHEN w >= md THEN 'broad' ELSE 'invalid' END AS width_group FROM w, m")
def narrow_broad_median(spark: SparkSession, d: str) -> DataFrame:
    """Segments below and from the median reach on."""
    w = _widths(spark, d)
    return w.crossJoin(F.broadcast(Q.medians(w, [], F.col("w"), "md", saved))).select("unit", F.when(F.col("w") < F.col("md"), "narrow").when(F.col("w") >= F.col("md"), "broad").otherwise("invalid").alias("width_group"))


@query(f"""WITH {WD}, st AS (SELECT min(w) AS lo, max(w) AS hi, count(*) AS n, stddev_samp(w) * pow(count(*), -0.2::DOUBLE) AS h FROM w), b AS (SELECT least(floor((w - lo) / ((hi - lo) / 200)), 199)::BIGINT AS k, count(*) AS c FROM w, st GROUP BY 1),
g AS (SELECT g.k, sum(b.c * exp(-0.5::DOUBLE * pow((g.k - b.k) * (hi - lo) / 200 / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())) AS density FROM range(200) g(k), b, st GROUP BY 1) SELECT k::BIGINT AS bin, round(density, 6) AS density FROM g""")
def narrow_broad_kde(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian kernel density of the reaches on 200 grid cells, from counts per cell: work beyond one scan does not grow."""
    w = _widths(spark, d)
    stats = w.agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.count(F.lit(1)).alias("n"), (F.stddev_samp("w") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("h"))
    step = (F.col("hi") - F.col("lo")) / 200
    cells = w.crossJoin(F.broadcast(stats)).groupBy(F.least(F.floor((F.col("w") - F.col("lo")) / step), F.lit(199)).alias("k"), "lo", "hi", "n", "h").agg(F.count(F.lit(1)).alias("c"))
    grid = cells.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(199)).cast("array<bigint>")))  # 200 cells at most
    weight = F.exp(-0.5 * F.pow((F.col("bin") - F.col("k")) * step / F.col("h"), F.lit(2)))
    return grid.groupBy("bin").agg(F.round(F.sum(F.col("c") * weight) / (F.max("n") * F.max("h") * math.sqrt(TAU)), 6).alias("density"))


PH = f"{EV}, p AS (SELECT *, 2 * pi() * ((t % {DAY})::DOUBLE / {DAY}::DOUBLE) AS ph FROM e)"


def _phases(spark: SparkSession, d: str) -> DataFrame:
    """Points with their time of day as a phase."""
    return points(spark, d).withColumn("phase", TAU * (F.pmod(F.col("t"), F.lit(DAY)).cast("double") / float(DAY)))


@query(f"WITH {PH} SELECT unit, mark, count(*)::BIGINT AS n, round(sqrt(pow(avg(cos(ph)), 2) + pow(avg(sin(ph)), 2)), 6) AS mvl, round(sqrt(pow(avg(value * cos(ph)), 2) + pow(avg(value * sin(ph)), 2)), 6) AS weighted FROM p GROUP BY 1, 2")
def circular_mvl(spark: SparkSession, d: str) -> DataFrame:
    """Length of the mean phase vector of each unit and mark, plain and weighted by value."""
    p = _phases(spark, d)
    return r6(p.groupBy("unit", "mark").agg(F.count(F.lit(1)).alias("n"), C.resultant(F.col("phase")).alias("mvl"), C.resultant(F.col("phase"), F.col("value")).alias("weighted")), "mvl", "weighted")


@query(f"""WITH {PH}, r AS (SELECT unit, count(*) AS n, pow(avg(cos(ph)), 2) + pow(avg(sin(ph)), 2) AS r2 FROM p GROUP BY 1), z AS (SELECT unit, n, n * r2 AS z FROM r)
SELECT unit, n::BIGINT AS n, round(CASE WHEN n < 2 THEN 0 ELSE z END, 6) AS z, round(CASE WHEN n < 2 THEN 1 ELSE least(greatest(exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * z * z * z - 9 * z * z * z * z) / (288 * n * n)), 0), 1) END, 6) AS p FROM z""")
def rayleigh(spark: SparkSession, d: str) -> DataFrame:
    """Rayleigh test of each unit's phases."""
    found = _phases(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), C.resultant(F.col("phase")).alias("r"))
    z, p = C.rayleigh(F.col("n"), F.col("r"))
    return r6(found.select("unit", "n", z.alias("z"), p.alias("p")), "z", "p")


@query(f"""WITH {PH}, b AS (SELECT mark, least(floor(ph / (2 * pi() / 18)), 17) AS k, avg(value) AS a FROM p GROUP BY 1, 2), g AS (SELECT m.mark, r.k, coalesce(b.a, 0) AS a FROM (SELECT DISTINCT mark FROM e) m CROSS JOIN range(18) r(k) LEFT JOIN b ON b.mark = m.mark AND b.k = r.k),
q AS (SELECT mark, a / sum(a) OVER (PARTITION BY mark) AS q FROM g) SELECT mark, round(sum(q * ln((q + 1e-10::DOUBLE) / (1.0::DOUBLE / 18 + 1e-10::DOUBLE))) / ln(18.0::DOUBLE), 6) AS mi FROM q GROUP BY 1""")
def tort_mi(spark: SparkSession, d: str) -> DataFrame:
    """Modulation of each mark's mean value by phase, over 18 bins."""
    bins = _phases(spark, d).groupBy("mark", C.phase_bin(F.col("phase"), 18).alias("k")).agg(F.avg("value").alias("a"))
    rows = bins.groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("k", "a"))).alias("m"))
    means = rows.select("mark", F.transform(F.sequence(F.lit(0), F.lit(17)).cast("array<bigint>"), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))).alias("means"))
    return r6(means.select("mark", C.modulation_index(F.col("means"), 18).alias("mi")), "mi")


@query(f"""WITH {PH}, k AS (SELECT mark, least(floor(ph / (2 * pi() / 36)), 35)::BIGINT AS bin, count(*) AS n FROM p GROUP BY 1, 2), g AS (SELECT m.mark, r.bin::BIGINT AS bin, coalesce(n, 0)::DOUBLE AS n FROM (SELECT DISTINCT mark FROM e) m CROSS JOIN range(36) r(bin) LEFT JOIN k ON k.mark = m.mark AND k.bin = r.bin)
SELECT mark, bin, round(n / sum(n) OVER (PARTITION BY mark), 6) AS share FROM g""")
def phase_tuning_hist(spark: SparkSession, d: str) -> DataFrame:
    """Share of each mark's points in 36 phase bins, empty ones included."""
    p = _phases(spark, d)
    counts = p.groupBy("mark", C.phase_bin(F.col("phase"), 36).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = p.select("mark").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(35)).cast("array<bigint>")))
    n = F.coalesce("n", F.lit(0)).cast("double")
    return r6(grid.join(counts, ["mark", "bin"], "left").select("mark", "bin", (n / F.sum(n).over(Window.partitionBy("mark"))).alias("share")), "share")


MD = "(atan2({0}, {1}) + CASE WHEN atan2({0}, {1}) < 0 THEN 2 * pi() ELSE 0 END)"


@query(f"""WITH {PH}, m AS (SELECT unit, avg(sin(ph)) FILTER (mark = 'click') AS s1, avg(cos(ph)) FILTER (mark = 'click') AS c1, avg(sin(ph)) FILTER (mark = 'view') AS s2, avg(cos(ph)) FILTER (mark = 'view') AS c2 FROM p GROUP BY 1),
d AS (SELECT unit, atan2(s1, c1) - atan2(s2, c2) AS dl FROM m WHERE s1 IS NOT NULL AND s2 IS NOT NULL) SELECT unit, round(atan2(sin(dl), cos(dl)), 6) AS shift FROM d""")
def phase_shift_remap(spark: SparkSession, d: str) -> DataFrame:
    """Shift of each unit's mean phase between clicks and views, in (-pi, pi]."""
    of = lambda f, m: F.avg(F.when(F.col("mark") == m, f(F.col("phase"))))
    m = _phases(spark, d).groupBy("unit").agg(*[of(f, k).alias(f"{n}{i}") for i, k in ((1, "click"), (2, "view")) for n, f in (("s", F.sin), ("c", F.cos))]).where("s1 IS NOT NULL AND s2 IS NOT NULL")
    delta = F.atan2("s1", "c1") - F.atan2("s2", "c2")
    return r6(m.select("unit", F.atan2(F.sin(delta), F.cos(delta)).alias("shift")), "shift")


@query(f"""WITH {PH}, u AS (SELECT unit, avg(sin(ph)) AS s, avg(cos(ph)) AS c FROM p GROUP BY 1), g AS (SELECT atan2(avg(sin(ph)), avg(cos(ph))) AS gm FROM p), a AS (SELECT p.ph + gm - atan2(u.s, u.c) AS ph FROM p JOIN u ON u.unit = p.unit, g)
SELECT count(*)::BIGINT AS n, round(sqrt(pow(avg(cos(ph)), 2) + pow(avg(sin(ph)), 2)), 6) AS aligned_mvl, round(atan2(avg(sin(ph)), avg(cos(ph))), 5) AS direction FROM a""")
def procrustes_rotate(spark: SparkSession, d: str) -> DataFrame:
    """Consistency of all phases after each unit's mean is turned to that of the whole."""
    p = _phases(spark, d)
    of = lambda df: df.agg(F.avg(F.sin("phase")).alias("s"), F.avg(F.cos("phase")).alias("c"))
    own, whole = of(p.groupBy("unit")), p.agg(F.avg(F.sin("phase")).alias("gs"), F.avg(F.cos("phase")).alias("gc"))
    turned = p.join(own, "unit").crossJoin(F.broadcast(whole)).withColumn("phase", F.col("phase") + F.atan2("gs", "gc") - F.atan2("s", "c"))
    direction = F.atan2(F.avg(F.sin("phase")), F.avg(F.cos("phase")))
    return turned.agg(F.count(F.lit(1)).alias("n"), F.round(C.resultant(F.col("phase")), 6).alias("aligned_mvl"), F.round(direction, 5).alias("direction"))


DFT = f"""{SG}, v AS (SELECT unit, unnest(x) AS v, unnest(range(64)) AS i FROM s), f AS (SELECT unit, k, sum(v * cos(2 * pi() * k * i / 64)) AS re, sum(v * sin(2 * pi() * k * i / 64)) AS im FROM v CROSS JOIN range(33) r(k) GROUP BY 1, 2), pw AS (SELECT unit, k::BIGINT AS k, (re * re + im * im) / 64 AS power FROM f)"""


def powers(rows: DataFrame, column: str, keep: int) -> DataFrame:
    """The first ``keep`` columns of ``rows`` and powers: those of the frequencies 0 .. n/2 of a row of n samples."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:keep])
    return by_row(rows, [column], lambda x: {"powers": np.abs(np.fft.rfft(x, axis=1)) ** 2 / x.shape[1]}, f"{kinds}, powers array<double>", keep)


def _powers(spark: SparkSession, d: str) -> DataFrame:
    return powers(segments(spark, d).select("unit", "grp", "samples"), "samples", 2)


@query(f"WITH {DFT} SELECT unit, k, round(power, 6) AS power FROM pw")
def dft_power(spark: SparkSession, d: str) -> DataFrame:
    """Power spectrum of each segment."""
    return _powers(spark, d).select("unit", F.posexplode("powers").alias("k", "power")).select("unit", F.col("k").cast("long").alias("k"), F.round("power", 6).alias("power"))


@query(f"WITH {DFT}, g AS (SELECT vec_id AS unit, label AS grp FROM embeddings), b AS (SELECT unit, avg(power) FILTER (k BETWEEN 2 AND 4) AS low, avg(power) FILTER (k BETWEEN 4 AND 8) AS theta, avg(power) FILTER (k BETWEEN 9 AND 20) AS high FROM pw GROUP BY 1) SELECT grp, count(*)::BIGINT AS n, round(avg(low), 6) AS low, round(avg(theta), 6) AS theta, round(avg(high), 6) AS high, round(stddev_samp(theta) / sqrt(count(*)), 6) AS theta_sem FROM b JOIN g ON g.unit = b.unit GROUP BY 1")
def band_power(spark: SparkSession, d: str) -> DataFrame:
    """Mean power in three bands by group, with the standard error of the middle one."""
    band = lambda a, b: A.mean(F.slice("powers", a + 1, b - a + 1))
    p = _powers(spark, d).select("grp", band(2, 4).alias("low"), band(4, 8).alias("theta"), band(9, 20).alias("high"))
    return r6(p.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("low").alias("low"), F.avg("theta").alias("theta"), F.avg("high").alias("high"), (F.stddev_samp("theta") / F.sqrt(F.count(F.lit(1)))).alias("theta_sem")), "low", "theta", "high", "theta_sem")


@query(f"WITH {DFT}, l AS (SELECT unit, log10(k) AS lk, log10(power) AS lp FROM pw WHERE k BETWEEN 1 AND 31 AND power > 0) SELECT unit, round(regr_slope(lp, lk), 6) AS slope, round(regr_intercept(lp, lk), 6) AS intercept FROM l GROUP BY 1")
def one_over_f_fit(spark: SparkSession, d: str) -> DataFrame:
    """Line through log power over log frequency of each segment."""
    each = _powers(spark, d).select("unit", F.posexplode("powers").alias("k", "power")).where("k BETWEEN 1 AND 31 AND power > 0")
    y, x = F.log10("power"), F.log10(F.col("k").cast("double"))
    return r6(each.groupBy("unit").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")), "slope", "intercept")


@query(f"WITH {DFT} SELECT unit, round(max(power) FILTER (k BETWEEN 4 AND 11) / avg(power) FILTER (k BETWEEN 1 AND 32), 6) AS theta_index FROM pw GROUP BY 1")
def theta_index(spark: SparkSession, d: str) -> DataFrame:
    """Largest power in a band over the mean of all frequencies above 0."""
    p = F.col("powers")
    return r6(_powers(spark, d).select("unit", (F.array_max(F.slice(p, 5, 8)) / A.mean(F.slice(p, 2, 32))).alias("theta_index")), "theta_index")


@query(f"""WITH {SG}, q AS (SELECT unit, seg, x[seg * 16 + 1 : seg * 16 + 32] AS y FROM s CROSS JOIN range(3) r(seg)), c AS (SELECT unit, seg, list_transform(y, lambda v: v - list_sum(y) / 32.0::DOUBLE) AS y FROM q),
v AS (SELECT unit, seg, unnest(y) AS v, unnest(range(32)) AS i FROM c), w AS (SELECT unit, seg, i, v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 32)) AS v FROM v),
f AS (SELECT unit, seg, k, sum(v * cos(2 * pi() * k * i / 32)) AS re, sum(v * sin(2 * pi() * k * i / 32)) AS im FROM w CROSS JOIN range(17) r(k) GROUP BY 1, 2, 3)
SELECT unit, k::BIGINT AS k, round(avg((re * re + im * im) / (64 * 12) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END), 6) AS psd FROM f GROUP BY 1, 2""")
def welch_psd(spark: SparkSession, d: str) -> DataFrame:
    """Welch density of each segment: Hann windows of 32 samples, half overlapping, means removed (64 samples a second)."""
    window = F.array(*[F.lit(0.5 - 0.5 * math.cos(TAU * i / 32)) for i in range(32)])
    part = segments(spark, d).select("unit", "samples", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seg")).select("unit", F.slice("samples", F.col("seg") * 16 + 1, F.lit(32)).alias("y"))
    centred = part.select("unit", "y", A.mean(F.col("y")).alias("m")).select("unit", F.zip_with(F.transform("y", lambda v: v - F.col("m")), window, lambda v, w: v * w).alias("y"))
    each = powers(centred.select("unit", "y"), "y", 1).select("unit", F.posexplode("powers").alias("k", "power"))
    scale = F.when(F.col("k").isin(0, 16), 1.0).otherwise(2.0) * 32 / (64 * 12)
    return each.groupBy("unit", F.col("k").cast("long").alias("k")).agg(F.round(F.avg(F.col("power") * scale), 6).alias("psd"))


@query(f"""WITH {SG}, v AS (SELECT grp, unnest(x) AS v, unnest(range(64)) AS i FROM s) SELECT grp, i::BIGINT AS sample, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem FROM v GROUP BY 1, 2""")
def group_mean_sem(spark: SparkSession, d: str) -> DataFrame:
    """Mean segment of each group with its standard error."""
    each = segments(spark, d).select("grp", F.posexplode("samples").alias("sample", "v"))
    return r6(each.groupBy("grp", F.col("sample").cast("long").alias("sample")).agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count(F.lit(1)))).alias("sem")), "mean", "sem")


@query(f"""WITH {SG}, f AS (SELECT grp, list_max(x) - list_min(x) AS reach, list_position(x, list_min(x))::DOUBLE AS trough FROM s) SELECT grp, count(*)::BIGINT AS n, round(median(reach), 6) AS reach, round(median(trough), 6) AS trough FROM f GROUP BY 1""")
def cluster_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Size and median features of each group."""
    f = segments(spark, d).select("grp", A.reach(F.col("samples")).alias("reach"), A.argmin(F.col("samples")).cast("double").alias("trough"))
    found = f.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    for c in ("reach", "trough"):
        middle = Q.medians(f, ["grp"], F.col(c), c, saved).withColumnRenamed("grp", "of")
        found = found.join(middle, F.col("grp").eqNullSafe(F.col("of"))).drop("of")
    return r6(found, "reach", "trough")
