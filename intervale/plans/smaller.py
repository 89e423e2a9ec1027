"""Smaller queries: order of a key list, coverage, composite keys, bundles, waveforms from nested arrays, time courses and bounded jitter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.operators import relational as R
from intervale.operators import replicates as B
from intervale.operators import sampled as D
from intervale.plans.events import EV, H, r6
from intervale.plans.registry import query
from intervale.plans.segments import L5, SG, listed
from intervale.sources.tables import DAY, points, segments, table

NATIONS = [7, 3, 3, 99, 0, 12]
TRIES = 12


@query(f"SELECT (place - 1)::BIGINT AS place, k.nation::BIGINT AS nation, n_name AS name FROM (SELECT unnest({NATIONS}) AS nation, generate_subscripts({NATIONS}, 1) AS place) k LEFT JOIN nation ON n_nationkey = k.nation")
def in_key_order(spark: SparkSession, d: str) -> DataFrame:
    """Nations in the order of a list of keys, which repeats one and has one that is not there."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("name"))
    return R.in_order_of(nation, "nation", NATIONS, "long").orderBy("place").select("place", "nation", "name")


@query(f"WITH {EV}, c AS (SELECT unit, mark, count(*) AS n FROM e GROUP BY 1, 2) SELECT unit FROM c WHERE mark IN ('click', 'view') AND n >= 3 GROUP BY unit HAVING count(*) = 2")
def covered_units(spark: SparkSession, d: str) -> DataFrame:
    """Units with three clicks and three views at least."""
    counts = points(spark, d).groupBy("unit", "mark").agg(F.count(F.lit(1)).alias("n"))
    return R.covered(counts, "unit", ["click", "view"], "mark", 3)


@query("SELECT coalesce(lang, '') || '|' || coalesce(source, '') AS stratum, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def composite_strata(spark: SparkSession, d: str) -> DataFrame:
    """Documents by language and source as one key."""
    return table(spark, d, "documents").groupBy(R.stratum("lang", "source").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT c_nationkey AS bundle, avg(c_acctbal) AS m, count(c_acctbal) AS k FROM customer GROUP BY 1)
SELECT c_custkey AS channel, 'c_nationkey' AS by_column, round(CASE WHEN k >= 2 THEN c_acctbal - m ELSE c_acctbal END, 6) AS referenced FROM customer JOIN b ON b.bundle = c_nationkey""")
def bundle_reference(spark: SparkSession, d: str) -> DataFrame:
    """Balances of customers less the mean of their bundle, by the first column that bundles them: a missing one and a unique one do not."""
    c = table(spark, d, "customer")
    by = D.detected_bundle(c, ["c_bundle", "c_custkey", "c_nationkey"], "c_name")
    rows = c.select(F.col("c_custkey").alias("channel"), F.lit(by).alias("by_column"), F.col(by).alias("bundle"), F.col("c_acctbal").alias("referenced"))
    return r6(D.referenced(rows, ["bundle"], "referenced").select("channel", "by_column", "referenced"), "referenced")


@query(f"""WITH {SG}, a AS (SELECT unit, list_transform(range(4), lambda c: x[c * 16 + 1 : c * 16 + 16]) AS ch, list_transform(range(4), lambda k: list_avg(list_transform(range(16), lambda r: x[r * 4 + k + 1]))) AS av,
  list_transform(range(4), lambda c: list_transform(range(8), lambda k: (x[c * 8 + k + 1] + x[32 + c * 8 + k + 1]) / 2)) AS sp FROM s WHERE len(x) = 64),
r AS (SELECT *, list_transform(ch, lambda v: list_max(v) - list_min(v)) AS rc, list_transform(sp, lambda v: list_max(v) - list_min(v)) AS rs FROM a)
SELECT unit, {L5.format('ch[list_position(rc, list_max(rc))]')} AS peak, {L5.format('av')} AS mean, {L5.format('sp[list_position(rs, list_max(rs))]')} AS spikes FROM r""")
def nested_waveforms(spark: SparkSession, d: str) -> DataFrame:
    """Waveforms from a segment as four channels, as sixteen repetitions, and as two repetitions of four channels."""
    s = segments(spark, d).where("size(samples) = 64")
    rows = lambda n: F.transform(F.sequence(F.lit(0), F.lit(64 // n - 1)), lambda r: F.slice("samples", (r * n + 1).cast("int"), n))
    twice = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice("samples", (h * 32 + c * 8 + 1).cast("int"), 8)))
    return s.select("unit", listed(D.mean_wave(rows(16), 2)).alias("peak"), listed(D.mean_wave(rows(4), 2)).alias("mean"), listed(D.mean_wave(twice, 3)).alias("spikes"))


@query(f"WITH {SG}, e AS (SELECT grp, unnest(range(len(x)))::BIGINT AS sample, unnest(x) AS v FROM s) SELECT grp, sample, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM e GROUP BY 1, 2")
def group_mean_sd(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation of each sample by group."""
    each = segments(spark, d).select("grp", F.posexplode("samples").alias("sample", "v"))
    return r6(each.groupBy("grp", F.col("sample").cast("long").alias("sample")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")), "mean", "sd")


@query(f"""WITH {EV}, c AS (SELECT mark, (t // {7 * DAY})::BIGINT AS week, unit, avg(value) AS v FROM e WHERE (t % {DAY}) // {H} BETWEEN 6 AND 17 GROUP BY 1, 2, 3)
SELECT mark, week, count(v)::BIGINT AS n, round(avg(v), 6) AS mean, round(stddev_pop(v) / sqrt(count(v)), 6) AS sem FROM c GROUP BY 1, 2""")
def band_timecourse(spark: SparkSession, d: str) -> DataFrame:
    """Values of a band of hours by mark and week: mean over the band in each unit, then mean and standard error over units."""
    p = points(spark, d).withColumn("week", F.floor(F.col("t") / (7 * DAY)))
    band = p.where(F.floor(F.pmod("t", F.lit(DAY)) / H).between(6, 17))
    return r6(D.timecourse(band, ["mark", "week"], "unit", "value"), "mean", "sem")


def _moved(k: int) -> str:
    return f"t + {B.lot_sql(str(k), 'point_id')} % {12 * H} - {6 * H}"


@query(f"""WITH {EV}, m AS (SELECT point_id, t // {DAY} * {DAY} AS a, t // {DAY} * {DAY} + {DAY - 1} AS b, [{', '.join(_moved(k) for k in range(1, TRIES + 1))}] AS m FROM e WHERE mark = 'click'),
i AS (SELECT *, list_filter(m, lambda x: x >= a AND x <= b) AS inside FROM m) SELECT point_id, (CASE WHEN len(inside) > 0 THEN inside[1] ELSE greatest(least(m[{TRIES}], b), a) END)::BIGINT AS t FROM i""")
def bounded_jitter(spark: SparkSession, d: str) -> DataFrame:
    """Clicks moved by up to six hours within their day: moves that leave it are drawn again, and cut in the end."""
    start = F.floor(F.col("t") / DAY) * DAY
    return points(spark, d).where("mark = 'click'").select("point_id", B.jittered_inside(F.col("t"), start, start + (DAY - 1), 6 * H, F.col("point_id"), TRIES).cast("long").alias("t"))
