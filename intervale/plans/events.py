"""Queries over ``events`` as a point process: users are units, event types are marks, sign-ups are onsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.operators import intervals as I
from intervale.operators import pointprocess as P
from intervale.operators import quantiles as Q
from intervale.operators import scans
from intervale.plans.registry import query
from intervale.sources.scratch import saved
from intervale.sources.tables import DAY, HOUR, points

EV = "e AS (SELECT event_id AS point_id, user_id AS unit, event_type AS mark, epoch_us(ts) AS t, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
ON = f"{EV}, o AS (SELECT point_id, unit, t FROM e WHERE mark = 'signup')"
H, D = HOUR, DAY


def onsets(p: DataFrame) -> DataFrame:
    return p.where("mark = 'signup'").select("unit", "point_id", "t")


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"""WITH {ON}, c AS (SELECT DISTINCT mark FROM e)
SELECT o.unit, o.point_id, c.mark, count(e.t)::BIGINT AS n FROM o CROSS JOIN c
LEFT JOIN e ON e.unit = o.unit AND e.mark = c.mark AND e.t BETWEEN o.t AND o.t + {D} GROUP BY 1, 2, 3""")
def window_counts_closed(spark: SparkSession, d: str) -> DataFrame:
    """Points of each mark in the closed day after each onset, zeros included."""
    p = points(spark, d)
    windows = I.fixed_windows(onsets(p), 0, D)
    found = I.window_counts(p.select("unit", "t", "mark"), windows, ["unit"], "point_id", D, "both", "mark", p.select("mark").distinct())
    return found.select("unit", "point_id", "mark", "n")


@query(f"""WITH {ON}, w AS (SELECT unit, point_id, 'before' AS kind, t - {12 * H} AS a, t AS b FROM o UNION ALL SELECT unit, point_id, 'after', t, t + {12 * H} FROM o)
SELECT w.unit, w.point_id, w.kind, count(e.t)::BIGINT AS n, round(count(e.t) / 12.0::DOUBLE, 6) AS rate FROM w
LEFT JOIN e ON e.unit = w.unit AND e.t >= w.a AND e.t < w.b GROUP BY 1, 2, 3""")
def window_rates_halfopen(spark: SparkSession, d: str) -> DataFrame:
    """Rates per hour in the half-open half-days before and after each onset."""
    p = points(spark, d)
    o = onsets(p)
    windows = I.fixed_windows(o, -12 * H, 0).withColumn("kind", F.lit("before")).unionByName(I.fixed_windows(o, 0, 12 * H).withColumn("kind", F.lit("after")))
    windows = windows.withColumn("window", F.concat_ws(":", "point_id", "kind"))
    found = I.rates(I.window_counts(p.select("unit", "t"), windows, ["unit"], "window", 12 * H, "left"), H)
    return r6(found.select("unit", "point_id", "kind", "n", "rate"), "rate")


@query(f"""WITH {ON}, c AS (SELECT DISTINCT mark FROM e WHERE mark <> 'signup'),
n AS (SELECT o.unit, o.point_id, c.mark, count(e.t) AS n FROM o CROSS JOIN c LEFT JOIN e ON e.unit = o.unit AND e.mark = c.mark AND e.t BETWEEN o.t AND o.t + {D} GROUP BY 1, 2, 3),
m AS (SELECT unit, mark, sum(n) AS tot, count(*) AS trials FROM n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY tot DESC, mark) AS k, max(tot) OVER (PARTITION BY unit) AS mx, sum(tot) OVER (PARTITION BY unit) AS sm, count(*) OVER (PARTITION BY unit) AS nc FROM m)
SELECT unit, mark AS preferred, tot::BIGINT AS n, round(tot::DOUBLE / trials::DOUBLE / 24.0::DOUBLE, 6) AS rate,
  CASE WHEN mx > 0 THEN round((nc::DOUBLE - sm::DOUBLE / mx::DOUBLE) / (nc::DOUBLE - 1), 6) END AS depth FROM r WHERE k = 1""")
def category_tuning(spark: SparkSession, d: str) -> DataFrame:
    """Each unit's preferred mark after onsets (most points, ties to the first name), its rate and the depth of selectivity."""
    p = points(spark, d)
    others = p.where("mark <> 'signup'").select("unit", "t", "mark")
    counted = I.window_counts(others, I.fixed_windows(onsets(p), 0, D), ["unit"], "point_id", D, "both", "mark", others.select("mark").distinct())
    total = counted.groupBy("unit", "mark").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("trials"))
    found = total.groupBy("unit").agg(F.min(F.struct((-F.col("n")).alias("k"), "mark", "trials")).alias("best"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("marks"))
    n, marks = -F.col("best.k"), F.col("marks").cast("double")
    depth = F.when(n > 0, (marks - F.col("all") / n.cast("double")) / (marks - 1))
    return r6(found.select("unit", F.col("best.mark").alias("preferred"), n.alias("n"), (n / F.col("best.trials").cast("double") / 24.0).alias("rate"), depth.alias("depth")), "rate", "depth")


EPOCHS = {"baseline": (-6 * H, 0), "early": (0, 6 * H), "late": (6 * H, 12 * H)}
EP = f"""{ON}, x AS (SELECT unit, point_id, t, lead(t) OVER (PARTITION BY unit ORDER BY t, point_id) AS nt FROM o),
ep AS (SELECT * FROM (SELECT unit, point_id, nt, 'baseline' AS kind, t - {6 * H} AS a, t AS b FROM x UNION ALL SELECT unit, point_id, nt, 'early', t, t + {6 * H} FROM x
  UNION ALL SELECT unit, point_id, nt, 'late', t + {6 * H}, t + {12 * H} FROM x UNION ALL SELECT unit, point_id, nt, 'delay', t + {12 * H}, nt FROM x) WHERE b > a AND (nt IS NULL OR b <= nt))"""


def _epochs(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("unit").orderBy("t", "point_id")
    return I.epochs(onsets(points(spark, d)).withColumn("next_t", F.lead("t").over(by)), EPOCHS, "delay")


@query(f'WITH {EP} SELECT unit, point_id, kind, a AS "start", b AS "end" FROM ep')
def epoch_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """The valid epochs of each onset, one a row."""
    return _epochs(spark, d)


@query(f"WITH {EP} SELECT kind, count(*)::BIGINT AS n, round(avg((b - a) / {H}::DOUBLE), 6) AS mean_hours, round(stddev_samp((b - a) / {H}::DOUBLE), 6) AS sd_hours FROM ep GROUP BY 1")
def epoch_summary(spark: SparkSession, d: str) -> DataFrame:
    """Number, mean and sample deviation of the epochs' lengths by kind."""
    hours = (F.col("end") - F.col("start")) / F.lit(float(H))
    return r6(_epochs(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(hours).alias("mean_hours"), F.stddev_samp(hours).alias("sd_hours")), "mean_hours", "sd_hours")


CY = f"{ON}, cy AS (SELECT * FROM (SELECT unit, t AS a, lead(t) OVER w AS b, row_number() OVER w - 1 AS cycle FROM o WINDOW w AS (PARTITION BY unit ORDER BY t, point_id)) WHERE b > a)"


def _in_cycles(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).where("mark <> 'signup'")
    cycles = I.consecutive(onsets(points(spark, d)), "unit")
    found = I.as_of(p.select("unit", "point_id", "t", "mark", "value"), cycles.select("unit", F.col("start").alias("t"), "end", "cycle"), "unit", ["end", "cycle"])
    return found.where(F.col("t") < F.col("end")).withColumn("progress", (F.col("t") - F.col("mark_t")) / (F.col("end") - F.col("mark_t")).cast("double"))


@query(f"""WITH {CY} SELECT e.point_id, e.unit, cy.cycle::BIGINT AS cycle, round(2 * pi() * (e.t - a)::DOUBLE / (b - a)::DOUBLE, 6) AS phase
FROM e JOIN cy ON e.unit = cy.unit AND e.t >= cy.a AND e.t < cy.b WHERE e.mark <> 'signup'""")
def interval_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Each point's cycle between onsets and its phase there, found by one sort per unit."""
    found = _in_cycles(spark, d)
    return r6(found.select("point_id", "unit", "cycle", (2 * F.pi() * F.col("progress")).alias("phase")), "phase")


@query(f"""WITH {ON}, k AS (SELECT e.unit, e.t, (SELECT max(o.t) FROM o WHERE o.unit = e.unit AND o.t <= e.t) AS a FROM e WHERE mark <> 'signup')
SELECT unit, count(*) FILTER (a IS NOT NULL AND t <= a + {D})::BIGINT AS inside, count(*)::BIGINT AS n FROM k GROUP BY 1""")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    """Points inside the closed day after the latest onset at or before them, by unit."""
    p = points(spark, d)
    found = I.as_of(p.where("mark <> 'signup'").select("unit", "point_id", "t"), onsets(p).select("unit", "t", F.col("point_id").alias("onset")), "unit", ["onset"])
    inside = F.coalesce(F.col("t") <= F.col("mark_t") + D, F.lit(False))
    return found.groupBy("unit").agg(F.sum(inside.cast("long")).alias("inside"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, s AS (SELECT unit, t, value FROM e WHERE mark = 'view'), c AS (SELECT unit, t, point_id FROM e WHERE mark = 'click'),
b AS (SELECT c.*, (SELECT max(s.t) FROM s WHERE s.unit = c.unit AND s.t <= c.t) AS t0, (SELECT min(s.t) FROM s WHERE s.unit = c.unit AND s.t >= c.t) AS t1 FROM c)
SELECT b.unit, b.point_id, round(CASE WHEN t0 = b.t THEN s0.value ELSE s0.value + (b.t - t0)::DOUBLE / (t1 - t0)::DOUBLE * (s1.value - s0.value) END, 6) AS value
FROM b LEFT JOIN s s0 ON s0.unit = b.unit AND s0.t = b.t0 LEFT JOIN s s1 ON s1.unit = b.unit AND s1.t = b.t1""")
def asof_interpolate(spark: SparkSession, d: str) -> DataFrame:
    """The series of view values, linearly interpolated at each click."""
    p = points(spark, d)
    return r6(I.interpolated(p.where("mark = 'click'"), p.where("mark = 'view'"), "unit").select("unit", "point_id", "value"), "value")


@query(f"""WITH {EV}, g AS (SELECT unit, t, point_id, CASE WHEN t > lag(t) OVER w THEN (t - lag(t) OVER w) / {H}::DOUBLE END AS g FROM e WINDOW w AS (PARTITION BY unit ORDER BY t, point_id)),
p AS (SELECT *, CASE WHEN g IS NOT NULL THEN last_value(g IGNORE NULLS) OVER (PARTITION BY unit ORDER BY t, point_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS b FROM g),
a AS (SELECT unit, count(*) AS n, count(g) AS ng, (max(t) - min(t)) / {H}::DOUBLE AS span, stddev_pop(g) / avg(g) AS cv, avg(2 * abs((g - b) / (g + b))) AS cv2, avg(3 * ((g - b) / (g + b)) * ((g - b) / (g + b))) AS lv, median(g) AS md,
  avg(CASE WHEN g IS NULL THEN NULL WHEN g < 1 THEN 1.0::DOUBLE ELSE 0 END) AS bu, avg(CASE WHEN g IS NULL THEN NULL WHEN g < 0.25 THEN 1.0::DOUBLE ELSE 0 END) AS vi FROM p GROUP BY unit)
SELECT unit, n::BIGINT AS n, CASE WHEN span > 0 THEN round(n::DOUBLE / span, 6) END AS rate, CASE WHEN n >= 3 AND ng >= 2 THEN round(cv, 6) END AS cv, CASE WHEN n >= 3 AND ng >= 2 THEN round(cv2, 6) END AS cv2,
  CASE WHEN n >= 3 AND ng >= 2 THEN round(lv, 6) END AS lv, CASE WHEN n >= 3 AND ng >= 2 THEN round(md, 6) END AS median_gap, CASE WHEN n >= 3 AND ng >= 2 THEN round(bu, 6) END AS burst_share, CASE WHEN n >= 3 AND ng >= 2 THEN round(vi, 6) END AS violation_share FROM a""")
def isi_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Inter-event statistics of each unit, in hours."""
    return r6(P.interval_metrics(points(spark, d), H, 1.0, 0.25, saved), "rate", "cv", "cv2", "lv", "median_gap", "burst_share", "violation_share")


ACG_W, ACG_B = 24 * H, H
ACG = f"""{EV}, u AS (SELECT unit, count(*) AS np FROM e GROUP BY 1), l AS (SELECT a.unit, b.t - a.t AS lag FROM e a JOIN e b ON a.unit = b.unit AND b.t BETWEEN a.t - {ACG_W} AND a.t + {ACG_W} WHERE b.t <> a.t),
k AS (SELECT unit, least((lag + {ACG_W}) // {ACG_B}, 47)::BIGINT AS bin, count(*) AS n FROM l GROUP BY 1, 2),
ac AS (SELECT u.unit, u.np, g.bin::BIGINT AS bin, coalesce(k.n, 0)::BIGINT AS n FROM u CROSS JOIN range(48) g(bin) LEFT JOIN k ON k.unit = u.unit AND k.bin = g.bin)"""


def _acg(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return P.filled(P.correlogram(p, p, ACG_W, ACG_B), p, 48)


@query(f"WITH {ACG} SELECT unit, bin, n FROM ac")
def acg_counts(spark: SparkSession, d: str) -> DataFrame:
    """Autocorrelogram of each unit over a day either way, by the hour."""
    return _acg(spark, d)


@query(f"WITH {ACG}, dn AS (SELECT unit, bin, n, n::DOUBLE / np::DOUBLE AS density FROM ac) SELECT unit, bin, n, round(density, 6) AS density, CASE WHEN max(density) OVER (PARTITION BY unit) > 0 THEN round(density / max(density) OVER (PARTITION BY unit), 6) END AS norm FROM dn")
def acg_density_norm(spark: SparkSession, d: str) -> DataFrame:
    """Autocorrelograms as densities per hour, and scaled to their maxima."""
    sizes = points(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("n_points"))
    return r6(P.correlogram_density(_acg(spark, d), sizes, ACG_B, H), "density", "norm")


@query(f"""WITH {ACG}, r AS (SELECT unit, bin - 23 AS k, n FROM ac WHERE bin >= 24), b AS (SELECT *, avg(CASE WHEN k BETWEEN 10 AND 24 THEN n END) OVER (PARTITION BY unit) AS base FROM r)
SELECT unit, min(CASE WHEN base > 0 AND n >= 0.5::DOUBLE * base THEN k END)::BIGINT AS refractory_bin, max_by(k, n * 100 - k)::BIGINT AS peak_bin,
  CASE WHEN sum(CASE WHEN k > 4 AND k <= 20 THEN n ELSE 0 END) > 0 THEN round(sum(CASE WHEN k <= 4 THEN n ELSE 0 END)::DOUBLE / sum(CASE WHEN k > 4 AND k <= 20 THEN n ELSE 0 END)::DOUBLE, 6) END AS burst_ratio FROM b GROUP BY unit""")
def acg_shape_features(spark: SparkSession, d: str) -> DataFrame:
    """Refractory lag, peak lag and burst ratio of the autocorrelograms."""
    return r6(P.correlogram_shape(_acg(spark, d), 48, (10, 24), 0.5, 4, 20), "burst_ratio")


PS = f"""{ON}, ns AS (SELECT count(*) AS trials FROM o), c AS (SELECT DISTINCT mark FROM e WHERE mark <> 'signup'),
k AS (SELECT e.mark, least((e.t - (o.t - {12 * H})) // {H}, 23)::BIGINT AS bin, count(*) AS n FROM e JOIN o ON e.unit = o.unit AND e.t BETWEEN o.t - {12 * H} AND o.t + {12 * H} WHERE e.mark <> 'signup' GROUP BY 1, 2),
ps AS (SELECT c.mark, g.bin::BIGINT AS bin, coalesce(k.n, 0)::BIGINT AS n, coalesce(k.n, 0)::DOUBLE / trials::DOUBLE AS rate FROM c CROSS JOIN range(24) g(bin) CROSS JOIN ns LEFT JOIN k ON k.mark = c.mark AND k.bin = g.bin)"""


def _psth(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    o, others = onsets(p), p.where("mark <> 'signup'")
    found = P.aligned_histogram(others.select("unit", "t", "mark"), o, -12 * H, 12 * H, H, ["mark"])
    grid = others.select(F.col("mark").alias("unit")).distinct()
    return P.filled(found.withColumnRenamed("mark", "unit"), grid, 24).withColumnRenamed("unit", "mark").crossJoin(F.broadcast(o.agg(F.count(F.lit(1)).alias("trials")))).withColumn("rate", F.col("n") / F.col("trials").cast("double")).drop("trials")


@query(f"WITH {PS} SELECT mark, bin, n, round(rate, 6) AS rate FROM ps")
def psth_binned(spark: SparkSession, d: str) -> DataFrame:
    """Mean points per onset and hour around onsets, by mark."""
    return r6(_psth(spark, d), "rate")


@query(f"""WITH {PS} SELECT a.mark, a.bin, round(sum(b.rate * exp(-0.5::DOUBLE * pow((b.bin - a.bin) / 1.5::DOUBLE, 2))) / sum(exp(-0.5::DOUBLE * pow((b.bin - a.bin) / 1.5::DOUBLE, 2))), 6) AS smooth
FROM ps a JOIN ps b ON a.mark = b.mark AND b.bin BETWEEN a.bin - 4 AND a.bin + 4 GROUP BY 1, 2""")
def psth_smoothed(spark: SparkSession, d: str) -> DataFrame:
    """The same, smoothed with a Gaussian of 1.5 hours."""
    return r6(P.smoothed(_psth(spark, d), ["mark"], "rate", 1.5, 4).select("mark", "bin", "smooth"), "smooth")


@query(f"""WITH {ON}, t AS (SELECT unit, point_id, t, (row_number() OVER (PARTITION BY unit ORDER BY t, point_id) - 1) % 3 AS cond FROM o), tr AS (SELECT unit, cond, count(*) AS trials FROM t GROUP BY 1, 2),
k AS (SELECT t.unit, t.cond, (e.t - t.t) // {6 * H} AS bin, count(*) AS n FROM t JOIN e ON e.unit = t.unit AND e.t >= t.t AND e.t < t.t + {D} WHERE e.mark <> 'signup' GROUP BY 1, 2, 3),
g AS (SELECT u.unit, c.cond, b.bin FROM (SELECT DISTINCT unit FROM o) u CROSS JOIN range(3) c(cond) CROSS JOIN range(4) b(bin))
SELECT g.unit, list(round(coalesce(k.n, 0)::DOUBLE / coalesce(tr.trials, 1)::DOUBLE, 6) ORDER BY g.cond, g.bin)::VARCHAR AS matrix FROM g
LEFT JOIN tr ON tr.unit = g.unit AND tr.cond = g.cond LEFT JOIN k ON k.unit = g.unit AND k.cond = g.cond AND k.bin = g.bin GROUP BY 1""")
def condition_bin_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Each unit's mean counts per trial by condition (onset number modulo 3) and six-hour bin, flattened; empty conditions are zeros."""
    p = points(spark, d)
    number = F.row_number().over(Window.partitionBy("unit").orderBy("t", "point_id")) - 1
    trials = onsets(p).withColumn("cond", (number % 3).cast("long"))
    windows = trials.select("unit", "cond", F.col("t").alias("start"), (F.col("t") + D).alias("end"))
    found = I.range_join(p.where("mark <> 'signup'").select("unit", "t"), windows, ["unit"], D, "left").groupBy("unit", "cond", F.floor((F.col("t") - F.col("start")) / (6 * H)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    sizes = trials.groupBy("unit", "cond").agg(F.count(F.lit(1)).alias("trials"))
    cells = found.join(sizes, ["unit", "cond"]).select("unit", (F.col("cond") * 4 + F.col("bin")).cast("int").alias("cell"), F.round(F.col("n") / F.col("trials").cast("double"), 6).alias("mean"))
    filled = trials.select("unit").distinct().join(cells.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("cell", "mean"))).alias("cells")), "unit", "left")
    values = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.coalesce(F.col("cells")[i], F.lit(0.0)).cast("string"))
    return filled.select("unit", F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]")).alias("matrix"))


@query(f"""WITH {EV}, z AS (SELECT *, (value - avg(value) OVER (PARTITION BY unit)) / nullif(stddev_pop(value) OVER (PARTITION BY unit), 0) > 0.5::DOUBLE AS above, row_number() OVER (PARTITION BY unit ORDER BY t, point_id) AS i, count(*) OVER (PARTITION BY unit) AS last FROM e),
r AS (SELECT *, i - row_number() OVER (PARTITION BY unit ORDER BY t, point_id) AS run FROM z WHERE above),
b AS (SELECT unit, run, min(t) AS a, max(t) AS b, count(*) AS n, avg(value) AS mv, max(value) AS xv, max(i) AS ei, max(last) AS last FROM r GROUP BY 1, 2)
SELECT unit, a AS "start", b AS "end", n::BIGINT AS n, round(mv, 6) AS mean_value, xv AS max_value FROM b WHERE n >= 2 AND ei < last""")
def burst_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more points whose value is half a deviation above the unit's mean; one open at the end is dropped."""
    p = points(spark, d)
    stats = p.groupBy("unit").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd"))
    return r6(P.bursts(p.join(stats, "unit"), z > 0.5, 2, saved), "mean_value")


@query(f"""WITH {EV}, b AS (SELECT mark, avg(value) AS m, stddev_pop(value) AS s FROM e WHERE t < (SELECT min(t) FROM e) + {7 * D} GROUP BY 1)
SELECT e.point_id, e.mark, round(CASE WHEN b.s > 0 THEN (e.value - b.m) / b.s ELSE 0 END, 6) AS z FROM e JOIN b ON b.mark = e.mark""")
def baseline_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Values as z-scores against their mark's first week (population deviation, 0 where that is 0)."""
    p = points(spark, d)
    first = p.agg(F.min("t").alias("first"))
    base = p.crossJoin(F.broadcast(first)).where(F.col("t") < F.col("first") + 7 * D).groupBy("mark").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return r6(p.join(base, "mark").select("point_id", "mark", F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0).alias("z")), "z")


@query(f"""WITH {EV}, m AS (SELECT unit, stddev_pop(value) AS sd, count(*) AS n FROM e GROUP BY 1), q AS (SELECT median(sd) AS md FROM m), a AS (SELECT median(abs(sd - md)) AS mad FROM m, q)
SELECT unit, round((sd - md) / (1.4826::DOUBLE * (mad + 1e-12::DOUBLE)), 6) AS mad_z, (abs((sd - md) / (1.4826::DOUBLE * (mad + 1e-12::DOUBLE))) > 3 OR sd = 0) AS outlier FROM m, q, a""")
def mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Units whose deviation of values is an outlier by the median absolute deviation, or zero."""
    sd = saved(points(spark, d).groupBy("unit").agg(F.stddev_pop("value").alias("sd")))
    away = sd.crossJoin(F.broadcast(Q.medians(sd, [], F.col("sd"), "md", saved)))
    spread = Q.medians(away, [], F.abs(F.col("sd") - F.col("md")), "mad", saved).crossJoin(Q.medians(sd, [], F.col("sd"), "md", saved))
    z = (F.col("sd") - F.col("md")) / (1.4826 * (F.col("mad") + 1e-12))
    return r6(sd.crossJoin(F.broadcast(spread)).select("unit", z.alias("mad_z"), ((F.abs(z) > 3) | (F.col("sd") == 0)).alias("outlier")), "mad_z")


@query(f"""WITH {EV}, h AS (SELECT unit, mark, t // {D} AS day, sum(value) AS v FROM e GROUP BY 1, 2, 3), r AS (SELECT *, avg(v) OVER (PARTITION BY mark, day) AS m, count(*) OVER (PARTITION BY mark, day) AS k FROM h)
SELECT unit, mark, day::BIGINT AS day, round(CASE WHEN k >= 2 THEN v - m ELSE v END, 6) AS referenced FROM r""")
def car_reference(spark: SparkSession, d: str) -> DataFrame:
    """Daily sums of each unit less the mean over the units of the same mark and day, where there are two or more."""
    daily = points(spark, d).groupBy("unit", "mark", F.floor(F.col("t") / D).alias("day")).agg(F.sum("value").alias("v"))
    means = daily.groupBy("mark", "day").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("k"))
    return r6(daily.join(means, ["mark", "day"]).select("unit", "mark", "day", F.when(F.col("k") >= 2, F.col("v") - F.col("m")).otherwise(F.col("v")).alias("referenced")), "referenced")


@query(f"""WITH {EV}, s AS (SELECT unit, count(*) AS n FROM e GROUP BY 1), i AS (SELECT unit, point_id, row_number() OVER (PARTITION BY unit ORDER BY t, point_id) - 1 AS i FROM e)
SELECT i.unit, point_id, (CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE (n % 5) + (i - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END)::BIGINT AS fold FROM i JOIN s ON s.unit = i.unit""")
def contiguous_folds(spark: SparkSession, d: str) -> DataFrame:
    """Five contiguous folds of each unit's points, the remainder in the first ones."""
    p = points(spark, d)
    keys, order = ["unit"], ["t", "point_id"]
    placed = scans.scanned(scans.dealt(p.select(*keys, *order), keys, order, saved), keys, order, {"i": ("rank", None)})
    sized = placed.withColumn("i", F.col("i") - 1).join(p.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "unit")
    small, extra = F.expr("n div 5"), F.expr("n % 5")
    long = extra * (small + 1)
    fold = F.when(F.col("i") < long, F.floor(F.col("i") / (small + 1))).otherwise(extra + F.floor((F.col("i") - long) / F.greatest(small, F.lit(1))))
    return sized.select("unit", "point_id", fold.cast("long").alias("fold"))
