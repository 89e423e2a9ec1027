"""Queries on trials, units and labels: filters, design matrices, samples, peaks, label tables and comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from intervale.functions.circular import resultant
from intervale.operators import intervals as I
from intervale.operators import pointprocess as P
from intervale.operators import quantiles as Q
from intervale.operators import relational as R
from intervale.operators import replicates as B
from intervale.operators import resampling as S
from intervale.operators import sampled as D
from intervale.plans.events import CY, EV, ON, H, _in_cycles, onsets, r6
from intervale.plans.nulls import N
from intervale.plans.registry import query
from intervale.plans.segments import PH, SG, _phases, _widths
from intervale.sources.partitions import PartitionStore
from intervale.sources.scratch import folder, saved
from intervale.sources.tables import DAY, points, segments, table

TR = """tr AS (SELECT o_orderkey AS trial, o_custkey AS session, substr(o_orderpriority, 1, 1)::BIGINT AS load, o_orderstatus = 'F' AS correct, CASE WHEN o_totalprice > 250000 THEN 'in' WHEN o_totalprice > 0 THEN 'out' END AS probe,
  (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS ordinal FROM orders)"""


def trials(spark: SparkSession, d: str) -> DataFrame:
    """Orders as trials: a load from 1 to 5, a correctness flag, a probe side and the place in the customer's sequence."""
    side = F.when(F.col("o_totalprice") > 250000, "in").when(F.col("o_totalprice") > 0, "out")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_custkey").alias("session"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("load"), (F.col("o_orderstatus") == "F").alias("correct"), side.alias("probe"), place.cast("long").alias("ordinal"))


@query(f"WITH {TR} SELECT trial, session, ordinal FROM tr WHERE load IN (1, 2) AND correct AND probe = 'in'")
def trial_selection(spark: SparkSession, d: str) -> DataFrame:
    """Correct trials of two loads with the probe inside, with their original ordinals."""
    return trials(spark, d).where("load IN (1, 2) AND correct AND probe = 'in'").select("trial", "session", "ordinal")


@query(f"WITH {TR}, k AS (SELECT load AS g, count(*) AS n, sum(CASE WHEN correct THEN 1 ELSE 0 END) AS c, min(ordinal) AS f FROM tr GROUP BY 1) SELECT 'Load ' || w.g AS label, coalesce(n, 0)::BIGINT AS n, coalesce(c, 0)::BIGINT AS n_correct, f AS first_ordinal FROM (VALUES (1), (3), (5), (7)) w(g) LEFT JOIN k ON k.g = w.g")
def trial_groups(spark: SparkSession, d: str) -> DataFrame:
    """Trials by load for a list of loads to keep, empty groups included."""
    keep = spark.range(1, 8, 2).select(F.col("id").alias("load"))
    found = trials(spark, d).groupBy("load").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"), F.min("ordinal").alias("first_ordinal"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return keep.join(found, "load", "left").select(F.concat(F.lit("Load "), F.col("load")).alias("label"), zero("n"), zero("n_correct"), "first_ordinal")


@query(f"WITH {TR}, m AS (SELECT trial, least(load, 3) AS l, ordinal % 2 AS s FROM tr) SELECT trial, (CASE WHEN l = 1 AND s = 0 THEN 1 ELSE 0 END)::INTEGER AS l1_s0, (CASE WHEN l = 1 AND s = 1 THEN 1 ELSE 0 END)::INTEGER AS l1_s1, (CASE WHEN l = 2 AND s = 0 THEN 1 ELSE 0 END)::INTEGER AS l2_s0, (CASE WHEN l = 2 AND s = 1 THEN 1 ELSE 0 END)::INTEGER AS l2_s1, (CASE WHEN l = 3 AND s = 0 THEN 1 ELSE 0 END)::INTEGER AS l3_s0, (CASE WHEN l = 3 AND s = 1 THEN 1 ELSE 0 END)::INTEGER AS l3_s1 FROM m")
def design_matrix(spark: SparkSession, d: str) -> DataFrame:
    """One-hot columns of each trial's load (at most 3) and stimulus."""
    load, stimulus = F.least("load", F.lit(3)), F.col("ordinal") % 2
    return trials(spark, d).select("trial", *[((load == a) & (stimulus == b)).cast("int").alias(f"l{a}_s{b}") for a in (1, 2, 3) for b in (0, 1)])


@query(f"WITH {EV}, r AS (SELECT 1 AS rep), q AS (SELECT mark, point_id, row_number() OVER (PARTITION BY mark ORDER BY md5(concat_ws(':', r.rep::VARCHAR, point_id::VARCHAR)), point_id) AS k FROM e, r) SELECT mark, point_id FROM q WHERE k <= 20")
def sample_per_mark(spark: SparkSession, d: str) -> DataFrame:
    """Twenty points of each mark, drawn by hash: the same ones however the data is split."""
    p = points(spark, d).select("mark", "point_id")
    return R.top_per_key(p.withColumn("lot", S.lot(F.lit(1), F.col("point_id"))), "mark", [F.col("lot"), F.col("point_id")], 20).select("mark", "point_id")


@query(f"""WITH {CY}, f AS (SELECT cy.unit, cy.cycle, e.mark, least(floor((e.t - a)::DOUBLE / (b - a)::DOUBLE * 4), 3)::BIGINT AS bin FROM e JOIN cy ON e.unit = cy.unit AND e.t >= cy.a AND e.t < cy.b WHERE e.mark <> 'signup')
SELECT unit, cycle::BIGINT AS cycle, mark, bin, count(*)::BIGINT AS n FROM f GROUP BY ALL""")
def phase_binned_features(spark: SparkSession, d: str) -> DataFrame:
    """Counts by cycle, mark and quarter of the cycle."""
    return _in_cycles(spark, d).groupBy("unit", "cycle", "mark", F.least(F.floor(F.col("progress") * 4), F.lit(3)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SG}, v AS (SELECT unit, unnest(x) AS v, unnest(range(64)) AS i FROM s), m AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a, median(v) OVER (PARTITION BY unit) AS md FROM v WINDOW w AS (PARTITION BY unit ORDER BY i)),
p AS (SELECT unit, i, v, lead(i) OVER (PARTITION BY unit ORDER BY i) AS nx FROM m WHERE v > b AND v >= a AND v >= md) SELECT unit, i::BIGINT AS "start", nx::BIGINT AS "end", round(v, 6) AS peak FROM p WHERE nx - i BETWEEN 3 AND 12""")
def peak_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles between neighbouring peaks above a segment's median, of 3 to 12 samples."""
    by = Window.partitionBy("unit").orderBy("i")
    s = segments(spark, d).select("unit", F.array_sort("samples").alias("o"), "samples")
    n = F.size("o")
    middle = (F.get("o", F.floor((n - 1) / 2).cast("int")) + F.get("o", F.floor(n / 2).cast("int"))) / 2
    each = s.select("unit", middle.alias("md"), F.posexplode("samples").alias("i", "v")).withColumns({"b": F.lag("v").over(by), "a": F.lead("v").over(by)})
    peaks = each.where("v > b AND v >= a AND v >= md").withColumn("end", F.lead("i").over(by))
    return peaks.where("end - i BETWEEN 3 AND 12").select("unit", F.col("i").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round("v", 6).alias("peak"))


@query(f"""WITH {EV}, r AS (SELECT unnest(range(1, {N + 1})) AS rep), x AS (SELECT 0 AS rep, unit, t FROM e WHERE mark = 'click' UNION ALL SELECT r.rep, unit, t + {B.wide_lot_sql('r.rep', 'point_id')} % {2 * H} - {H} FROM e, r WHERE mark = 'click'),
c AS (SELECT x.rep, count(*) AS stat FROM x JOIN e ON e.unit = x.unit AND e.mark = 'purchase' AND e.t BETWEEN x.t AND x.t + {H} GROUP BY 1), a AS (SELECT k.rep, coalesce(stat, 0) AS stat FROM range({N + 1}) k(rep) LEFT JOIN c ON c.rep = k.rep)
SELECT o.stat::DOUBLE AS observed, round((count(*) FILTER (n.stat >= o.stat) + 1)::DOUBLE / {N + 1}::DOUBLE, 6) AS p FROM a o JOIN a n ON n.rep > 0 WHERE o.rep = 0 GROUP BY 1""")
def jitter_null(spark: SparkSession, d: str) -> DataFrame:
    """Purchases in the hour after a click, against clicks moved by up to an hour either way."""
    p = points(spark, d)
    near = p.where("mark = 'click'").select("unit", "point_id", F.col("t").alias("at"), (F.col("t") - H).alias("start"), (F.col("t") + 2 * H).alias("end"))
    pairs = I.range_join(p.where("mark = 'purchase'").select("unit", "t"), near, ["unit"], 3 * H, "both").select("point_id", (F.col("t") - F.col("at")).alias("gap"))
    stat = B.jittered_counts(pairs, "point_id", "gap", H, H, N).select("replicate", F.col("n").cast("double").alias("statistic"))
    return r6(S.p_values(stat, [], "statistic", N), "p")


@query(f"""WITH {PH}, q AS (SELECT unit, mark, ph, row_number() OVER (PARTITION BY unit, mark ORDER BY md5(concat_ws(':', '1', point_id::VARCHAR)), point_id) AS k FROM p WHERE mark IN ('click', 'view')),
n AS (SELECT unit, CASE WHEN count(DISTINCT mark) = 2 THEN min(c) END AS m FROM (SELECT unit, mark, count(*) AS c FROM q GROUP BY 1, 2) GROUP BY 1) SELECT q.unit, mark, m::BIGINT AS n, round(sqrt(pow(avg(cos(ph)), 2) + pow(avg(sin(ph)), 2)), 6) AS mvl FROM q JOIN n ON n.unit = q.unit WHERE k <= m GROUP BY 1, 2, 3""")
def equalised_mvl(spark: SparkSession, d: str) -> DataFrame:
    """Mean phase vectors of clicks and views after both are drawn down to the smaller count; units without both drop out."""
    p = _phases(spark, d).where("mark IN ('click', 'view')").select("unit", "mark", "phase", "point_id")
    least = p.groupBy("unit", "mark").agg(F.count(F.lit(1)).alias("c")).groupBy("unit").agg(F.min("c").alias("n"), F.count(F.lit(1)).alias("both")).where("both = 2").select("unit", "n")
    place = F.row_number().over(Window.partitionBy("unit", "mark").orderBy(S.lot(F.lit(1), F.col("point_id")), "point_id"))
    return r6(p.withColumn("k", place).join(least, "unit").where("k <= n").groupBy("unit", "mark", "n").agg(resultant(F.col("phase")).alias("mvl")), "mvl")


@query(f"""WITH {EV}, u AS (SELECT unit, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd, (max(t) - min(t)) / {H}::DOUBLE AS span, avg(CASE WHEN value < 1 THEN 1.0::DOUBLE ELSE 0 END) AS low FROM e GROUP BY 1), x AS (SELECT *, n / nullif(span, 0) AS rate, median(sd) OVER () AS md FROM u)
SELECT unit, n::BIGINT AS n, round(rate, 6) AS rate, CASE WHEN sd < md THEN 'narrow' WHEN sd >= md THEN 'broad' ELSE 'invalid' END AS width_group, (n >= 60 AND low < 0.08 AND rate IS NOT NULL) AS qc_pass,
CASE WHEN NOT (n >= 60 AND low < 0.08 AND rate IS NOT NULL) THEN 'failed' WHEN sd < md AND rate > 0.095 THEN 'fast' WHEN sd < md THEN 'slow' ELSE 'other' END AS kind FROM x""")
def label_table(spark: SparkSession, d: str) -> DataFrame:
    """Units with features, a split at the median, a quality gate and a rule label; a missing measure fails the gate."""
    low = F.avg((F.col("value") < 1).cast("double"))
    span = (F.max("t") - F.min("t")) / F.lit(float(H))
    u = points(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("sd"), F.when(span > 0, F.count(F.lit(1)) / span).alias("rate"), low.alias("low"))
    u = saved(u)
    u = u.crossJoin(F.broadcast(Q.medians(u, [], F.col("sd"), "md", saved)))
    passes = F.coalesce((F.col("n") >= 60) & (F.col("low") < 0.08) & F.col("rate").isNotNull(), F.lit(False))
    narrow = F.col("sd") < F.col("md")
    kind = F.when(~passes, "failed").when(narrow & (F.col("rate") > 0.095), "fast").when(narrow, "slow").otherwise("other")
    return u.select("unit", "n", F.round("rate", 6).alias("rate"), F.when(narrow, "narrow").when(F.col("sd") >= F.col("md"), "broad").otherwise("invalid").alias("width_group"), passes.alias("qc_pass"), kind.alias("kind"))


FE = f"""{SG}, f AS (SELECT unit, list_max(x) - list_min(x) AS reach, list_position(x, list_min(x))::DOUBLE AS trough, list_max(x) AS top FROM s), m AS (SELECT median(reach) AS md FROM f),
l AS (SELECT reach < md AS g, 'trough' AS feature, trough AS v FROM f, m UNION ALL SELECT reach < md, 'top', top FROM f, m UNION ALL SELECT reach < md, 'reach', reach FROM f, m)"""


@query(f"""WITH {FE}, r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS r FROM l), tt AS (SELECT feature, sum(k * k * k - k)::DOUBLE AS tie FROM (SELECT feature, v, count(*)::DOUBLE AS k FROM l GROUP BY 1, 2) GROUP BY 1),
s2 AS (SELECT r.feature, median(v) FILTER (g) AS ma, median(v) FILTER (NOT g) AS mb, sum(CASE WHEN g THEN r END) - count(*) FILTER (g) * (count(*) FILTER (g) + 1)::DOUBLE / 2 AS u, count(*) FILTER (g)::DOUBLE AS na, count(*) FILTER (NOT g)::DOUBLE AS nb, any_value(tie) AS tie FROM r JOIN tt ON tt.feature = r.feature GROUP BY 1)
SELECT feature, na::BIGINT AS n_narrow, nb::BIGINT AS n_broad, round(ma, 6) AS median_narrow, round(mb, 6) AS median_broad, round(u / (na * nb), 6) AS auc, round((u - na * nb / 2) / sqrt(na * nb / 12 * (na + nb + 1 - tie / ((na + nb) * (na + nb - 1)))), 6) AS z FROM s2""")
def feature_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Rank tests of three features between segments below and above the median reach, with both medians."""
    s = segments(spark, d).select(F.array_max("samples").alias("top"), (F.array_max("samples") - F.array_min("samples")).alias("reach"), F.array_position("samples", F.array_min("samples")).cast("double").alias("trough"))
    middle = F.broadcast(Q.medians(s, [], F.col("reach"), "md", saved))
    each = s.crossJoin(middle).select((F.col("reach") < F.col("md")).alias("g"), F.stack(F.lit(3), F.lit("trough"), "trough", F.lit("top"), "top", F.lit("reach"), "reach").alias("feature", "v"))
    tests = R.mann_whitney(each, "v", F.col("g"), ["feature"])
    narrow, broad = (Q.medians(each, ["feature"], F.when(g, F.col("v")), name, saved) for g, name in ((F.col("g"), "median_narrow"), (~F.col("g"), "median_broad")))
    return r6(tests.join(narrow, "feature").join(broad, "feature").select("feature", F.col("na").alias("n_narrow"), F.col("nb").alias("n_broad"), "median_narrow", "median_broad", "auc", "z"), "median_narrow", "median_broad", "auc", "z")


@query(f"""WITH {EV} SELECT unit % 10 AS session, count(DISTINCT unit)::BIGINT AS units, count(*)::BIGINT AS points, count(*) FILTER (mark = 'signup')::BIGINT AS onsets, round((max(t) - min(t)) / {DAY}::DOUBLE, 6) AS days, string_agg(DISTINCT mark, ',' ORDER BY mark) AS marks FROM e GROUP BY 1""")
def session_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Units, points, onsets, span and marks of each session (units by last digit)."""
    p = points(spark, d).withColumn("session", F.col("unit") % 10)
    return p.groupBy("session").agg(F.countDistinct("unit").alias("units"), F.count(F.lit(1)).alias("points"), F.count_if(F.col("mark") == "signup").alias("onsets"), F.round((F.max("t") - F.min("t")) / F.lit(float(DAY)), 6).alias("days"), F.array_join(F.array_sort(F.collect_set("mark")), ",").alias("marks"))


@query(f"""WITH {ON}, x AS (SELECT o.unit, o.point_id, (e.t - o.t)::DOUBLE / {H}::DOUBLE AS lag, e.mark FROM o JOIN e ON e.unit = o.unit AND e.t >= o.t AND e.t < o.t + {DAY} AND e.mark <> 'signup')
SELECT unit, point_id, count(*)::BIGINT AS n, round(min(lag), 6) AS first_lag, arg_min(mark, lag) AS first_mark, round(quantile_cont(lag, 0.5), 6) AS median_lag FROM x GROUP BY 1, 2""")
def response_latency(spark: SparkSession, d: str) -> DataFrame:
    """Points in the day after each onset: how many, the first one's lag and mark, and the median lag in hours."""
    p = points(spark, d)
    windows = onsets(p).select("unit", "point_id", F.col("t").alias("start"), (F.col("t") + DAY).alias("end"))
    lag = (F.col("t") - F.col("start")) / F.lit(float(H))
    found = I.range_join(p.where("mark <> 'signup'").select("unit", "t", "mark"), windows, ["unit"], DAY, "left")
    return r6(found.groupBy("unit", "point_id").agg(F.count(F.lit(1)).alias("n"), F.min(lag).alias("first_lag"), F.min_by("mark", "t").alias("first_mark"), F.median(lag).alias("median_lag")), "first_lag", "median_lag")


@query(f"""WITH {EV}, a AS (SELECT unit, t, mark FROM e WHERE mark IN ('click', 'purchase')), l AS (SELECT x.unit, y.t - x.t AS lag FROM a x JOIN a y ON x.unit = y.unit AND x.mark = 'click' AND y.mark = 'purchase' AND y.t BETWEEN x.t - {12 * H} AND x.t + {12 * H} WHERE y.t <> x.t)
SELECT unit, least((lag + {12 * H}) // {H}, 23)::BIGINT AS bin, count(*)::BIGINT AS n FROM l GROUP BY 1, 2""")
def cross_correlogram(spark: SparkSession, d: str) -> DataFrame:
    """Purchases around clicks by hour of lag, in each unit."""
    p = points(spark, d)
    return P.correlogram(p.where("mark = 'click'"), p.where("mark = 'purchase'"), 12 * H, H)


@query()
def bca_interval(spark: SparkSession, d: str) -> DataFrame:
    """Bias-corrected and accelerated bootstrap interval of the mean reach, by group: means of resamples by Poisson weights, jackknife by sums."""
    return S.bca(_widths(spark, d).select("grp", F.col("unit").alias("key"), F.col("w").alias("x")), "grp", 2000)


SR = f"""{EV}, sr AS (SELECT mark, (t // {H})::BIGINT AS i, sum(value) AS v FROM e GROUP BY 1, 2), lim AS (SELECT mark, min(i // 24) AS lo, max(i // 24) AS hi FROM sr GROUP BY 1)"""


@query(f"""WITH {SR}, o AS (SELECT DISTINCT (t // {DAY})::BIGINT AS day FROM e WHERE mark = 'signup'), g AS (SELECT s.mark, o.day, k.k, day * 24 + 18 + k.k AS i FROM o CROSS JOIN range(12) k(k) CROSS JOIN (SELECT DISTINCT mark FROM sr) s),
x AS (SELECT g.mark, g.day, g.k, sr.v, count(h.c) OVER (PARTITION BY g.mark, g.day) AS n FROM g LEFT JOIN sr ON sr.mark = g.mark AND sr.i = g.i LEFT JOIN (SELECT DISTINCT mark, i // 24 AS c FROM sr) h ON h.mark = g.mark AND h.c = g.i // 24)
SELECT mark, day AS onset, count(v)::BIGINT AS n, round(sum(v), 6) AS total, round(max(v), 6) AS top FROM x WHERE n = 12 GROUP BY 1, 2""")
def signal_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Hourly sums of each mark as a chunked signal, cut from 18 h of each day with a sign-up to 6 h of the next; windows over the ends drop out."""
    p = points(spark, d)
    series = p.groupBy("mark", F.floor(F.col("t") / H).alias("i")).agg(F.sum("value").alias("value"))
    chunks = D.chunked(series, ["mark"], 24)
    days = p.where("mark = 'signup'").select(F.floor(F.col("t") / DAY).alias("onset")).distinct().select("onset", (F.col("onset") * 24).alias("at"))
    everywhere = days.crossJoin(p.select("mark").distinct())
    found = D.aligned(chunks, everywhere, ["mark"], 24, 18, 30)
    known = F.filter("samples", lambda v: v.isNotNull())
    return r6(found.select("mark", "onset", F.size(known).cast("long").alias("n"), F.aggregate(known, F.lit(0.0), lambda a, v: a + v).alias("total"), F.array_max(known).alias("top")).withColumn("total", F.when(F.col("n") > 0, F.col("total"))), "total", "top")


@query(f"WITH {SG}, r AS (SELECT grp, unit, list_max(x) - list_min(x) > 0.75::DOUBLE AS bad FROM s) SELECT grp, count(*)::BIGINT AS n, count(*) FILTER (bad)::BIGINT AS rejected, bool_or(bad) AS any_rejected FROM r GROUP BY 1")
def p2p_reject(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each group whose reach is over a threshold."""
    bad = _widths(spark, d).withColumn("bad", F.col("w") > 0.75)
    return bad.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("rejected"), F.bool_or("bad").alias("any_rejected"))


@query(f"""WITH {SG}, v AS (SELECT grp, unnest(x) AS v, unnest(range(64)) AS i FROM s), g AS (SELECT grp, i, var_pop(v) AS q FROM v GROUP BY 1, 2), a AS (SELECT grp, sum(q) AS variance FROM g GROUP BY 1) SELECT grp, round(variance, 6) AS variance, round(variance / sum(variance) OVER (), 6) AS share FROM a""")
def variance_by_condition(spark: SparkSession, d: str) -> DataFrame:
    """Variance across a group's segments, summed over samples, and its share of all groups'."""
    long = segments(spark, d).select("grp", F.posexplode("samples").alias("i", "v"))
    return r6(D.variance_by(long, "grp", "i", "v"), "variance", "share")


@query(f"""WITH {EV} SELECT unit % 10 AS subject, t // {30 * DAY} AS session, mark, count(*)::BIGINT AS n, round(sum(value), 4) AS value, CASE WHEN (t // {30 * DAY}) % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS run FROM e GROUP BY 1, 2, 3""")
def partition_resume(spark: SparkSession, d: str) -> DataFrame:
    """Sums by subject, month and mark, stored by subject and month: a first run makes the even months, a second one what is missing."""
    p = points(spark, d).select((F.col("unit") % 10).alias("subject"), F.floor(F.col("t") / (30 * DAY)).alias("session"), "mark", "value")
    schema = StructType().add("subject", "long").add("session", "long").add("mark", "string").add("n", "long").add("value", "double").add("run", "long")
    store = PartitionStore(spark, folder(spark), "monthly", {"days": 30}, schema, ["subject", "session"])
    keys = saved(p.select("subject", "session").distinct())

    def make(run: int) -> Callable[[DataFrame], DataFrame]:
        return lambda missing: p.join(F.broadcast(missing), ["subject", "session"]).groupBy("subject", "session", "mark").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"), F.lit(run).alias("run"))

    store.completed(keys.where("session % 2 = 0"), make(1))
    return store.completed(keys, make(2), lots=2)
