"""Relational queries: lookups, set operations, cross-tables, ranks, tests and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.operators import quantiles as Q
from intervale.operators import relational as R
from intervale.operators import scans
from intervale.operators.resampling import lot
from intervale.plans.events import EV, r6
from intervale.plans.registry import query
from intervale.sources.scratch import saved
from intervale.sources.tables import points, table

P5, N0 = "round({}, 6)", "count(*)::BIGINT"


@query("""SELECT r_name AS region, n_name AS nation, count(c_custkey)::BIGINT AS customers, round(coalesce(avg(c_acctbal), 0), 6) AS mean_balance, (count(*) FILTER (c_acctbal < 0))::BIGINT AS overdrawn
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def region_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers by nation and region: dimension tables are left-joined after the sums by key."""
    by_key = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("customers"), F.avg("c_acctbal").alias("mean_balance"), F.count_if(F.col("c_acctbal") < 0).alias("overdrawn"))
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    found = by_key.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return found.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "customers", F.round(F.coalesce("mean_balance", F.lit(0.0)), 6).alias("mean_balance"), "overdrawn")


@query("""SELECT a.l_orderkey AS orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b, a.l_returnflag AS flag FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
AND a.l_linenumber < b.l_linenumber AND (a.l_returnflag = b.l_returnflag OR b.l_linestatus = 'O')""")
def pair_theta_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of an order's lines with the same flag, or whose second line is open: a join on the order with a condition on top."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    a, b = lines.alias("a"), lines.alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & ((F.col("a.l_returnflag") == F.col("b.l_returnflag")) | (F.col("b.l_linestatus") == "O"))
    return a.join(b, on).select(F.col("a.l_orderkey").alias("orderkey"), F.col("a.l_linenumber").alias("line_a"), F.col("b.l_linenumber").alias("line_b"), F.col("a.l_returnflag").alias("flag"))


@query(f"""WITH {EV}, u AS (SELECT unit, 'first' AS slot, mark, t FROM e WHERE mark IN ('signup', 'view') AND value > 5 UNION ALL SELECT unit, 'second', mark, t FROM e WHERE mark = 'purchase' UNION ALL SELECT unit, 'probe', mark, t FROM e WHERE mark = 'click' AND value IS NOT NULL)
SELECT slot, mark, count(*)::BIGINT AS n, count(DISTINCT unit)::BIGINT AS units FROM u GROUP BY 1, 2""")
def union_presentations(spark: SparkSession, d: str) -> DataFrame:
    """Presentations from three sources after each one's validity rule, pooled."""
    p = points(spark, d)
    slots = [p.where("mark IN ('signup', 'view') AND value > 5").withColumn("slot", F.lit("first")), p.where("mark = 'purchase'").withColumn("slot", F.lit("second")), p.where("mark = 'click' AND value IS NOT NULL").withColumn("slot", F.lit("probe"))]
    return slots[0].unionByName(slots[1]).unionByName(slots[2]).groupBy("slot", "mark").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unit").alias("units"))


@query(f"WITH {EV} SELECT unit FROM e WHERE mark = 'purchase' AND value > 30 INTERSECT SELECT unit FROM e WHERE mark = 'error' AND value > 30")
def set_intersect_units(spark: SparkSession, d: str) -> DataFrame:
    """Units with both large purchases and large errors."""
    p = points(spark, d).where("value > 30")
    return p.where("mark = 'purchase'").select("unit").intersect(p.where("mark = 'error'").select("unit"))


@query("SELECT o_custkey AS custkey, o_orderpriority AS priority FROM orders WHERE o_orderstatus <> 'F' EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def set_except_folds(spark: SparkSession, d: str) -> DataFrame:
    """Customer and priority pairs that occur outside the held-out status only."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    return o.where("o_orderstatus <> 'F'").drop("o_orderstatus").subtract(o.where("o_orderstatus = 'F'").drop("o_orderstatus"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT coalesce(a.k, b.k) AS custkey, a.k IS NOT NULL AS has_orders, b.k IS NOT NULL AS known FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def symmetric_validation(spark: SparkSession, d: str) -> DataFrame:
    """Customer keys that one of two sets lacks: those with an urgent order, and those with a balance."""
    a = table(spark, d, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("custkey")).distinct().withColumn("_a", F.lit(True))
    b = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey")).distinct().withColumn("_b", F.lit(True))
    return a.join(b, "custkey", "full").select("custkey", F.col("_a").isNotNull().alias("has_orders"), F.col("_b").isNotNull().alias("known")).where("NOT (has_orders AND known)")


@query("SELECT p_partkey AS partkey, p_brand AS brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09)")
def semi_join_ids(spark: SparkSession, d: str) -> DataFrame:
    """Parts that were sold at a high discount."""
    sold = table(spark, d, "lineitem").where("l_discount > 0.09D").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(sold, "p_partkey", "left_semi").select(F.col("p_partkey").alias("partkey"), F.col("p_brand").alias("brand"))


@query("SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join_unassigned(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a large order."""
    large = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(large, "c_custkey", "left_anti").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))


@query("SELECT custkey, orderkey, price FROM (SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """The first order of each customer by key."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    return R.first_per_key(o, ["custkey"], ["orderkey"])


@query("""WITH d AS (SELECT * FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY lang, source) AS k FROM documents) WHERE k = 1)
SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source FROM labels l LEFT JOIN d ON l.doc_id = d.doc_id""")
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Labels with what is known of their documents; the first row of a repeated key counts."""
    docs = R.first_per_key(table(spark, d, "documents").select("doc_id", "lang", "source"), ["doc_id"], ["lang", "source"])
    return table(spark, d, "labels").select("doc_id", "quality", "toxic").join(docs, "doc_id", "left")


@query("""SELECT brand, place, partkey, price FROM (SELECT p_brand AS brand, p_partkey AS partkey, p_retailprice AS price, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 3""")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The three dearest parts of each brand."""
    part = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("partkey"), F.col("p_retailprice").alias("price"))
    return R.top_per_key(part, "brand", [F.desc("price"), F.asc("partkey")], 3)


@query("(SELECT 'head' AS part, o_orderkey AS orderkey, o_totalprice AS price FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10) UNION ALL (SELECT 'tail', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)")
def head_tail_union(spark: SparkSession, d: str) -> DataFrame:
    """The ten smallest and the ten largest orders."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    head, tail = o.orderBy("price", "orderkey").limit(10), o.orderBy(F.desc("price"), "orderkey").limit(10)
    return head.withColumn("part", F.lit("head")).unionByName(tail.withColumn("part", F.lit("tail"))).select("part", "orderkey", "price")


@query("""WITH c AS (SELECT p_size AS size, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), k AS (SELECT size, sum(q) OVER (ORDER BY size) / sum(q) OVER () AS share, (row_number() OVER (ORDER BY size))::DOUBLE / count(*) OVER () AS pos FROM c)
SELECT size, round(share, 6) AS share, round(share - pos, 6) AS gap FROM k ORDER BY round(share - pos, 9) DESC, size LIMIT 1""")
def knee_argmin(spark: SparkSession, d: str) -> DataFrame:
    """The size at which the cumulative share of quantities lies furthest above the diagonal."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    sums = lines.groupBy(F.col("p_size").alias("size")).agg(F.sum("l_quantity").alias("q"))  # a few dozen sizes
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up = Window.orderBy("size")
    share = F.sum("q").over(up) / F.sum("q").over(everything)
    at = F.row_number().over(up).cast("double") / F.count(F.lit(1)).over(everything)
    found = sums.select("size", share.alias("share"), (share - at).alias("gap"))
    return r6(found.orderBy(F.desc(F.round("gap", 9)), "size").limit(1), "share", "gap")


@query("""WITH r AS (SELECT c_mktsegment AS segment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT segment, greatest(ceil((r - 1) * 10 / nullif(n - 1, 0)::DOUBLE)::BIGINT - 1, 0)::BIGINT AS decile, count(*)::BIGINT AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM r GROUP BY 1, 2""")
def decile_strata(spark: SparkSession, d: str) -> DataFrame:
    """Deciles of balances inside each market segment, by rank, with edges closed on the right."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal", "c_custkey")
    keys, order = ["segment"], ["c_acctbal", "c_custkey"]
    ranked = scans.scanned(scans.dealt(c, keys, order, saved), keys, order, {"r": ("rank", None)})
    sizes = c.groupBy(F.col("segment").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.join(sizes, F.col("segment").eqNullSafe(F.col("of")))
    share = F.when(F.col("n") > 1, (F.col("r") - 1) * 10 / (F.col("n") - 1).cast("double"))
    return ranked.groupBy("segment", F.greatest(F.ceil(share) - 1, F.lit(0)).alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) SELECT a.lang, b.source, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT lang FROM c) a CROSS JOIN (SELECT DISTINCT source FROM c) b LEFT JOIN c ON c.lang = a.lang AND c.source = b.source""")
def crosstab_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by language and source, zeros included."""
    return R.crosstab(table(spark, d, "documents").select("lang", "source"), "lang", "source")


@query("""SELECT l_returnflag AS flag, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o, count(*)::BIGINT AS total FROM lineitem GROUP BY 1""")
def crosstab_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Lines by flag and status as a pivot over a fixed domain, with totals."""
    found = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    f, o = F.coalesce("F", F.lit(0)), F.coalesce("O", F.lit(0))
    return found.select("flag", f.alias("f"), o.alias("o"), (f + o).alias("total"))


@query("""SELECT lang, source, round(n::DOUBLE / sum(n) OVER (PARTITION BY lang)::DOUBLE, 6) AS share FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)""")
def row_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Each source's share of its language's documents."""
    counts = table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("lang", "source", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")).cast("double"), 6).alias("share"))


@query("""WITH c AS (SELECT a.p, b.s, count(o_orderkey) AS n FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders) b LEFT JOIN orders ON o_orderpriority = p AND o_orderstatus = s GROUP BY 1, 2),
m AS (SELECT n, sum(n) OVER (PARTITION BY p) AS r, sum(n) OVER (PARTITION BY s) AS k, sum(n) OVER () AS t FROM c)
SELECT round(sum((n - r::DOUBLE * k::DOUBLE / t::DOUBLE) * (n - r::DOUBLE * k::DOUBLE / t::DOUBLE) / (r::DOUBLE * k::DOUBLE / t::DOUBLE)), 6) AS chi2, ((SELECT count(DISTINCT p) - 1 FROM c) * (SELECT count(DISTINCT s) - 1 FROM c))::BIGINT AS dof FROM m""")
def chi2_contingency(spark: SparkSession, d: str) -> DataFrame:
    """Chi-square of order priority against status."""
    return r6(R.chi_square(R.crosstab(table(spark, d, "orders").select("o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus"), "chi2")


@query("""WITH l AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY 1, 2), ra AS (SELECT sum(n) AS n FROM c GROUP BY a), rb AS (SELECT sum(n) AS n FROM c GROUP BY b),
q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS pc, (SELECT sum(n * (n - 1) / 2) FROM ra) AS pa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS pb, (SELECT sum(n) FROM c) AS t, (SELECT sum(n * ln(n)) FROM c) AS lc, (SELECT sum(n * ln(n)) FROM ra) AS la, (SELECT sum(n * ln(n)) FROM rb) AS lb),
x AS (SELECT *, pa * pb / (t * (t - 1) / 2) AS ex, (pa + pb) / 2 AS mx, ln(t) - la / t AS ha, ln(t) - lb / t AS hb, ln(t) - lc / t AS hc FROM q)
SELECT round((pc - ex) / (mx - ex), 6) AS ari, round((ha + hb - hc) / ((ha + hb) / 2), 6) AS nmi FROM x""")
def ari_nmi(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the two label columns."""
    return r6(R.adjusted_rand(table(spark, d, "labels"), "quality", "toxic"), "ari", "nmi")


@query("""WITH s AS (SELECT l_orderkey AS k, max(l_returnflag) AS a, min(l_returnflag) AS b, max(l_linestatus) AS c FROM lineitem GROUP BY 1), v AS (SELECT k, 'a' AS m, a AS x FROM s UNION ALL SELECT k, 'b', b FROM s UNION ALL SELECT k, 'c', CASE WHEN c = 'O' THEN 'N' ELSE 'A' END FROM s)
SELECT p.m AS one, q.m AS two, round(avg(CASE WHEN p.x = q.x THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement, count(*)::BIGINT AS n FROM v p JOIN v q ON p.k = q.k AND p.m <= q.m GROUP BY 1, 2""")
def agreement_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Share of equal votes for each pair of three labelings of orders."""
    votes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("a"), F.min("l_returnflag").alias("b"), F.max("l_linestatus").alias("c"))
    labels = {"a": F.col("a"), "b": F.col("b"), "c": F.when(F.col("c") == "O", "N").otherwise("A")}
    pairs = [F.struct(F.lit(p).alias("one"), F.lit(q).alias("two"), (labels[p] == labels[q]).cast("double").alias("same")) for p in labels for q in labels if p <= q]
    return r6(votes.select(F.inline(F.array(*pairs))).groupBy("one", "two").agg(F.avg("same").alias("agreement"), F.count(F.lit(1)).alias("n")), "agreement")


@query("""SELECT l_orderkey AS orderkey, count(*)::BIGINT AS votes, count(DISTINCT l_returnflag) = 1 AS unanimous, CASE WHEN max(n) * 2 > count(*) THEN max_by(l_returnflag, n) END AS majority
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS n FROM lineitem) GROUP BY 1""")
def vote_unanimity(spark: SparkSession, d: str) -> DataFrame:
    """Votes of an order's lines, whether all agree, and the majority if there is one."""
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    most = F.when(F.max("n") * 2 > F.sum("n"), F.max_by("l_returnflag", "n"))
    return counts.groupBy("orderkey").agg(F.sum("n").alias("votes"), (F.count(F.lit(1)) == 1).alias("unanimous"), most.alias("majority"))


def _totals(how: str):
    sql = {"rollup": "ROLLUP (l_returnflag, l_linestatus)", "cube": "CUBE (l_returnflag, l_linestatus)", "sets": "GROUPING SETS ((l_returnflag), (l_linestatus), ())"}[how]
    oracle = f"SELECT coalesce(l_returnflag, 'Total') AS flag, coalesce(l_linestatus, 'Total') AS status, count(*)::BIGINT AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY {sql}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        lines = table(spark, d, "lineitem")
        keys = [F.col("l_returnflag"), F.col("l_linestatus")]
        grouped = lines.rollup(*keys) if how == "rollup" else lines.cube(*keys) if how == "cube" else lines.groupingSets([[keys[0]], [keys[1]], []], *keys)
        found = grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))
        return found.select(F.coalesce("l_returnflag", F.lit("Total")).alias("flag"), F.coalesce("l_linestatus", F.lit("Total")).alias("status"), "n", "quantity")

    run.__name__, run.__doc__ = {"rollup": "rollup_totals", "cube": "cube_totals", "sets": "grouping_sets_totals"}[how], "Line counts and quantities with totals."
    return query(oracle)(run)


rollup_totals, cube_totals, grouping_sets_totals = _totals("rollup"), _totals("cube"), _totals("sets")


@query("""SELECT p_partkey AS partkey, CASE WHEN p_name LIKE '%widget%' THEN 'widget' WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%bolt%' THEN 'bolt' ELSE replace(p_name, ' ', '-') END AS area,
  CASE WHEN lower(p_name) LIKE 'small%' OR lower(p_name) LIKE 'red%' THEN 'L' WHEN lower(p_name) LIKE 'blue%' THEN 'R' ELSE 'unknown' END AS side, upper(split_part(p_name, ' ', 1)) AS first_word FROM part""")
def string_area_case(spark: SparkSession, d: str) -> DataFrame:
    """Names by ordered substring rules, a side from their beginning, and their first word."""
    name = F.col("p_name")
    area = F.when(name.contains("widget"), "widget").when(name.contains("ring"), "ring").when(name.contains("bolt"), "bolt").otherwise(F.replace(name, F.lit(" "), F.lit("-")))
    side = F.when(F.lower(name).startswith("small") | F.lower(name).startswith("red"), "L").when(F.lower(name).startswith("blue"), "R").otherwise("unknown")
    return table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), area.alias("area"), side.alias("side"), F.upper(F.split_part(name, F.lit(" "), F.lit(1))).alias("first_word"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, coalesce(try_cast(regexp_extract(url, '/(\d+)', 1) AS BIGINT), -1) AS number, regexp_matches(url, '[?#]') AS has_suffix FROM pages""")
def regex_ids(spark: SparkSession, d: str) -> DataFrame:
    """Host, first number and suffix of each page address."""
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(url, r"^https?://([^/]+)/", 1).alias("host"), F.coalesce(F.regexp_extract(url, r"/(\d+)", 1).try_cast("bigint"), F.lit(-1)).cast("bigint").alias("number"), url.rlike("[?#]").alias("has_suffix"))


@query("SELECT event_type AS mark, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k_sum, count(DISTINCT json_extract(props, '$.k')::BIGINT // 25)::BIGINT AS groups FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Sums over a JSON field, and how many groups of 25 its values fall in."""
    k = F.from_json("props", "k BIGINT")["k"]
    return table(spark, d, "events").select(F.col("event_type").alias("mark"), k.alias("k")).groupBy("mark").agg(F.sum("k").alias("k_sum"), F.countDistinct(F.floor(F.col("k") / 25)).alias("groups"))


@query(f"""WITH {EV}, r AS (SELECT *, rank() OVER (PARTITION BY mark ORDER BY round(value, 0)) + (count(*) OVER (PARTITION BY mark, round(value, 0)) - 1) / 2.0::DOUBLE AS r FROM e) SELECT point_id, mark, r AS "rank" FROM r""")
def midranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of rounded values inside each mark, ties sharing their mean rank."""
    p = points(spark, d).select("point_id", "mark", F.round("value", 0).alias("v"))
    return R.midranks(p, "v", ["mark"]).select("point_id", "mark", "rank")


MW = f"""{EV}, r AS (SELECT mark, (unit % 2 = 0) AS g, rank() OVER (PARTITION BY mark ORDER BY value) + (count(*) OVER (PARTITION BY mark, value) - 1) / 2.0::DOUBLE AS r, value FROM e),
tt AS (SELECT mark, sum(k * k * k - k)::DOUBLE AS tie FROM (SELECT mark, value, count(*)::DOUBLE AS k FROM e GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT r.mark, sum(CASE WHEN g THEN r END) AS ra, count(*) FILTER (g)::DOUBLE AS na, count(*) FILTER (NOT g)::DOUBLE AS nb, any_value(tie) AS tie FROM r JOIN tt ON tt.mark = r.mark GROUP BY 1),
u AS (SELECT *, ra - na * (na + 1) / 2 AS u FROM s)"""


@query(f"WITH {MW} SELECT mark, na::BIGINT AS na, nb::BIGINT AS nb, u, round(u / (na * nb), 6) AS auc, round((u - na * nb / 2) / sqrt(na * nb / 12 * (na + nb + 1 - tie / ((na + nb) * (na + nb - 1)))), 6) AS z FROM u")
def mannwhitney_u(spark: SparkSession, d: str) -> DataFrame:
    """Values of even units against odd ones in each mark."""
    return r6(R.mann_whitney(points(spark, d), "value", F.col("unit") % 2 == 0, ["mark"]), "auc", "z")


@query(f"WITH {MW} SELECT round(sum(u) / sum(na * nb), 6) AS auc, count(*)::BIGINT AS strata FROM u WHERE na > 0 AND nb > 0")
def stratified_auc(spark: SparkSession, d: str) -> DataFrame:
    """The same AUC pooled over marks, weighted by their pairs."""
    found = R.mann_whitney(points(spark, d), "value", F.col("unit") % 2 == 0, ["mark"]).where("u IS NOT NULL")
    weight = F.col("na").cast("double") * F.col("nb")
    return found.agg(F.round(F.sum(F.col("auc") * weight) / F.sum(weight), 6).alias("auc"), F.count(F.lit(1)).alias("strata"))


@query(f"""WITH {EV}, d AS (SELECT unit, avg(value) FILTER (mark = 'click') - avg(value) FILTER (mark = 'view') AS x FROM e GROUP BY 1), n AS (SELECT unit, x, rank() OVER (ORDER BY round(abs(x), 9)) + (count(*) OVER (PARTITION BY round(abs(x), 9)) - 1) / 2.0::DOUBLE AS r FROM d WHERE x <> 0),
w AS (SELECT count(*)::DOUBLE AS n, least(sum(CASE WHEN x > 0 THEN r ELSE 0 END), sum(CASE WHEN x < 0 THEN r ELSE 0 END)) AS w FROM n)
SELECT n::BIGINT AS n, w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) / sqrt(n), 6) AS effect FROM w""")
def wilcoxon_signed(spark: SparkSession, d: str) -> DataFrame:
    """Signed-rank test over units of mean click value less mean view value."""
    p = points(spark, d)
    mean = lambda m: F.avg(F.when(F.col("mark") == m, F.col("value")))
    delta = p.groupBy("unit").agg((mean("click") - mean("view")).alias("x")).where("x <> 0").withColumn("size", F.round(F.abs("x"), 9))
    ranked = R.midranks(delta.withColumn("all", F.lit(1)), "size", ["all"])
    side = lambda c: F.sum(F.when(c, F.col("rank")).otherwise(0.0))
    n = F.col("n").cast("double")
    found = ranked.agg(F.count(F.lit(1)).alias("n"), F.least(side(F.col("x") > 0), side(F.col("x") < 0)).alias("w"))
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return r6(found.select("n", "w", z.alias("z"), (z / F.sqrt(n)).alias("effect")), "z", "effect")


PV = f"""{EV}, u AS (SELECT unit, avg(value) AS m, count(value) AS n FROM e GROUP BY 1), g AS (SELECT avg(value) AS gm, stddev_samp(value) AS gs FROM e), p AS (SELECT unit, exp(-0.717::DOUBLE * abs((m - gm) / (gs / sqrt(n))) - 0.416::DOUBLE * pow((m - gm) / (gs / sqrt(n)), 2)) AS p FROM u, g)"""


def _p_values(spark: SparkSession, d: str) -> DataFrame:
    """A p-value of each unit's mean against the whole (an exponential bound of the normal tails)."""
    p = points(spark, d)
    all_ = p.agg(F.avg("value").alias("gm"), F.stddev_samp("value").alias("gs"))
    z = (F.col("m") - F.col("gm")) / (F.col("gs") / F.sqrt("n"))
    return p.groupBy("unit").agg(F.avg("value").alias("m"), F.count("value").alias("n")).crossJoin(F.broadcast(all_)).select("unit", F.exp(-0.717 * F.abs(z) - 0.416 * z * z).alias("p"))


@query(f"""WITH {PV}, r AS (SELECT unit, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, unit) AS raw FROM p) SELECT unit, round(p, 6) AS p, round(least(1.0::DOUBLE, min(raw) OVER (ORDER BY p DESC, unit DESC)), 6) AS q FROM r""")
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    """False-discovery rates of the units' p-values."""
    return r6(R.benjamini_hochberg(saved(_p_values(spark, d)), "p", "unit", saved), "p", "q")


@query(f"WITH {PV} SELECT unit, round(least(1.0::DOUBLE, p * count(*) OVER ()), 6) AS p_adjusted, p * count(*) OVER () < 0.05 AS significant FROM p")
def bonferroni(spark: SparkSession, d: str) -> DataFrame:
    """p-values times the number of tests."""
    p = _p_values(spark, d)
    found = p.crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("m"))))
    return found.select("unit", F.round(F.least(F.lit(1.0), F.col("p") * F.col("m")), 6).alias("p_adjusted"), (F.col("p") * F.col("m") < 0.05).alias("significant"))


@query("""SELECT conv_id, turn, role, lag(role) OVER w AS before_role, (length(text) - coalesce(length(lag(text) OVER w), 0))::BIGINT AS growth, (count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn, role))::BIGINT AS user_turns FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)""")
def turn_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the role before it, the growth of its text and the user turns so far."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role")
    growth = F.length("text") - F.coalesce(F.length(F.lag("text").over(by)), F.lit(0))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(by).alias("before_role"), growth.cast("long").alias("growth"), F.sum((F.col("role") == "user").cast("long")).over(by).alias("user_turns"))


@query(f"WITH {EV} SELECT mark, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95 FROM e GROUP BY 1")
def quantile_summary(spark: SparkSession, d: str) -> DataFrame:
    """Five percentiles of each mark's values."""
    shares = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return r6(Q.quantiles(points(spark, d), ["mark"], F.col("value"), shares, saved).drop("n"), *shares)


@query("WITH m AS (SELECT c_mktsegment AS segment, c_custkey AS custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer), q AS (SELECT segment, median(v) AS md FROM m GROUP BY 1) SELECT custkey, round(coalesce(v, md), 6) AS balance, v IS NULL AS imputed FROM m JOIN q ON q.segment = m.segment")
def median_imputation(spark: SparkSession, d: str) -> DataFrame:
    """Balances, where negative ones count as missing and take their segment's median."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("custkey"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"))
    return c.join(Q.medians(c, ["segment"], F.col("v"), "md", saved), "segment").select("custkey", F.round(F.coalesce("v", "md"), 6).alias("balance"), F.col("v").isNull().alias("imputed"))


@query("""WITH l AS (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws(':', '1', doc_id::VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels WHERE quality IS NOT NULL) SELECT quality, doc_id FROM l WHERE k <= (SELECT min(n) FROM l)""")
def matched_sample(spark: SparkSession, d: str) -> DataFrame:
    """As many documents of each quality as the rarer one has, drawn by hash."""
    l = table(spark, d, "labels").where("quality IS NOT NULL").select("quality", "doc_id")
    least = l.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    place = F.row_number().over(Window.partitionBy("quality").orderBy(lot(F.lit(1), F.col("doc_id")), "doc_id"))
    return l.withColumn("k", place).crossJoin(F.broadcast(least)).where("k <= least").select("quality", "doc_id")


@query("SELECT o_custkey AS custkey, o_orderkey AS orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) - o_totalprice, 4) AS offset_before FROM orders")
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The sum of a customer's earlier orders before each one."""
    keys, order = ["custkey"], ["o_orderdate", "orderkey"]
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), "o_orderdate", "o_totalprice")
    summed = scans.scanned(scans.dealt(o, keys, order, saved), keys, order, {"upto": ("sum", F.col("o_totalprice"))})
    return summed.select("custkey", "orderkey", F.round(F.col("upto") - F.col("o_totalprice"), 4).alias("offset_before"))


@query("SELECT vec_id AS unit, round(embedding[1]::DOUBLE, 6) AS w0, round(embedding[2]::DOUBLE, 6) AS w1, round(embedding[3]::DOUBLE, 6) AS w2, round(embedding[4]::DOUBLE, 6) AS w3, len(embedding)::INTEGER AS n FROM embeddings WHERE len(embedding) = (SELECT mode(len(embedding)) FROM embeddings)")
def wide_export(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the commonest length, with their first samples as columns."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("unit"), "embedding", F.size("embedding").alias("n"))
    usual = e.groupBy("n").agg(F.count(F.lit(1)).alias("c")).agg(F.max(F.struct("c", "n")).alias("m")).select(F.col("m.n").alias("n"))
    return e.join(usual, "n").select("unit", *[F.round(F.col("embedding")[i].cast("double"), 6).alias(f"w{i}") for i in range(4)], "n")
