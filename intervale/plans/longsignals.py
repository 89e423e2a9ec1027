"""Queries that pair units and channels, and that look up phases and couplings in long hourly signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.functions import circular as C
from intervale.functions import signals as K
from intervale.operators import longsignals as L
from intervale.operators.chunks import over_chunks
from intervale.plans.events import EV, H, r6
from intervale.plans.registry import query
from intervale.plans.signals import BORDER, SIZE, hourly
from intervale.sources.scratch import saved
from intervale.sources.tables import points

#: Lags of a coupling in hours, and those that are left out (by magnitude) as too near to tell from none.
LAGS, NEAR = list(range(-24, 25, 2)), (1, 3)


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(units, channels) of each session: users with a side by their number, and their marks with a side by the name's length."""
    p = points(spark, d).where("mark IS NOT NULL").select((F.col("unit") % 10).alias("session"), "unit", "mark")
    side = lambda n: F.when(n % 3 == 0, "left").when(n % 3 == 1, "right")
    units = p.select("session", "unit").distinct().withColumn("hemisphere", side(F.col("unit")))
    return units, p.select("session", F.col("mark").alias("channel")).distinct().withColumn("hemisphere", side(F.length("channel")))


@query(f"""WITH {EV}, u AS (SELECT DISTINCT unit % 10 AS session, unit, CASE unit % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'unknown' END AS h FROM e WHERE mark IS NOT NULL),
c AS (SELECT DISTINCT unit % 10 AS session, mark AS channel, CASE length(mark) % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'unknown' END AS h FROM e WHERE mark IS NOT NULL)
SELECT u.session, unit, channel, u.h AS left_hemisphere, c.h AS right_hemisphere FROM u JOIN c ON c.session = u.session AND (u.h = c.h OR u.h = 'unknown' OR c.h = 'unknown')""")
def pair_rule(spark: SparkSession, d: str) -> DataFrame:
    """Units and channels of a session whose sides agree or are unknown."""
    return L.hemisphere_pairs(*sides(spark, d), "session").select("session", "unit", "channel", "left_hemisphere", "right_hemisphere")


@query(f"""WITH {EV}, s AS (SELECT mark, t // {H} AS i, sum(value) AS v FROM e WHERE mark IS NOT NULL GROUP BY 1, 2), k AS (SELECT DISTINCT mark, i // {SIZE} AS chunk FROM s),
g AS (SELECT mark, chunk * {SIZE} + r.j AS i FROM k CROSS JOIN range({SIZE}) r(j)), x AS (SELECT g.mark, g.i, 2 * pi() * g.i / 24.0::DOUBLE + coalesce(v, 0) / 50.0::DOUBLE AS a FROM g LEFT JOIN s ON s.mark = g.mark AND s.i = g.i),
p AS (SELECT mark, i, atan2(sin(a), cos(a)) AS ph FROM x), q AS (SELECT e.point_id, e.mark, a.ph, b.ph - a.ph AS dp, e.t / {H}::DOUBLE - e.t // {H} AS share FROM e JOIN p a ON a.mark = e.mark AND a.i = e.t // {H} LEFT JOIN p b ON b.mark = e.mark AND b.i = e.t // {H} + 1),
y AS (SELECT point_id, mark, CASE WHEN share = 0 THEN ph ELSE ph + (dp - 2 * pi() * floor((dp + pi()) / (2 * pi()))) * share END AS v FROM q WHERE share = 0 OR dp IS NOT NULL)
SELECT point_id, mark, round(v + pi() - 2 * pi() * floor((v + pi()) / (2 * pi())) - pi(), 6) AS phase FROM y""")
def phase_at_points(spark: SparkSession, d: str) -> DataFrame:
    """A given phase of each mark's hours (the hour of the day, moved on by what happened in it) at the mark's points."""
    angle = lambda v, i: 2 * np.pi * i / F.lit(24.0) + v / 50.0
    given = F.transform("samples", lambda v, j: F.atan2(F.sin(angle(v, F.col("i0") + j)), F.cos(angle(v, F.col("i0") + j))))
    phases = L.unwrapped(hourly(spark, d).select("mark", "chunk", "i0", given.alias("samples")), ["mark"], saved)
    p = points(spark, d).where("mark IS NOT NULL").select("point_id", "mark", (F.col("t") / float(H)).alias("at"))
    return r6(L.phase_at(p, phases, ["mark"], SIZE).select("point_id", "mark", "phase"), "phase")


def slow_phase(spark: SparkSession, d: str) -> DataFrame:
    """The phase of the daily rhythm in each mark's hourly sums, in chunks."""
    return over_chunks(hourly(spark, d), ["mark"], SIZE, BORDER, lambda x: np.angle(K.band(x, 1 / 36, 1 / 16, 1.0, 2)))


@query()
def pair_locking(spark: SparkSession, d: str) -> DataFrame:
    """How the points of each unit keep to the daily phase of each channel that it pairs with: number, mean vector and Rayleigh's test."""
    pairs = L.hemisphere_pairs(*sides(spark, d), "session").select("unit", F.col("channel").alias("mark"))
    phases = L.unwrapped(slow_phase(spark, d), ["mark"], saved)
    p = points(spark, d).select("unit", (F.col("t") / float(H)).alias("at")).join(pairs, "unit")
    found = L.phase_at(p, phases, ["mark"], SIZE).groupBy("unit", F.col("mark").alias("channel")).agg(F.count(F.lit(1)).alias("n"), C.resultant(F.col("phase")).alias("mvl"))
    z, p_value = C.rayleigh(F.col("n"), F.col("mvl"))
    return r6(found.select("unit", "channel", "n", "mvl", z.alias("z"), p_value.alias("p")), "mvl", "z", "p")


@query()
def coupling_lags(spark: SparkSession, d: str) -> DataFrame:
    """Coupling of each channel's fast amplitude to another one's daily phase over lags of a day either way, from sums by phase bin."""
    fast = over_chunks(hourly(spark, d), ["mark"], SIZE, BORDER, lambda x: np.abs(K.band(x, 1 / 8, 1 / 3, 1.0, 2)))
    channels = saved(hourly(spark, d).select("mark").distinct())
    side = F.when(F.length("mark") % 3 == 0, "left").when(F.length("mark") % 3 == 1, "right")
    sided = lambda name: channels.select(F.lit(0).alias("session"), F.col("mark").alias(name), side.alias("hemisphere"))
    pairs = L.hemisphere_pairs(sided("phase_key"), sided("amplitude_key"), "session").where("phase_key <> amplitude_key")
    sums = L.lag_sums(slow_phase(spark, d).withColumnRenamed("mark", "phase_key"), fast.withColumnRenamed("mark", "amplitude_key"), pairs, SIZE, LAGS)
    return r6(L.lag_curve(sums, exclude=NEAR).withColumnsRenamed({"phase_key": "phase_channel", "amplitude_key": "amplitude_channel"}), "mi")
