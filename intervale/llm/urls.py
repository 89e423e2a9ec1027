"""URL filters by association rules: FP-growth mines combinations of URL tokens that go with a label, and an inverted index of the rules
judges each url. A list of given rules on host and path goes first.

Edge cases: a null url, or one without ``://``, has an empty host and path, no token and the ``default`` verdict. Rows that repeat a
page_id or a url each get their own row. Rows of labels without a doc_id or without any label count for nothing, and labels that
disagree on a document make it bad. Without labelled urls there are no mined rules. Columns beyond those read are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.llm.skew import hot_keys, spread_join
from intervale.llm.store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A mined rule must hold for this share of the labelled urls and for so many of them.
SUPPORT, LEAST = 0.002, 20
#: Of the labelled urls with its tokens, this share must have its label, and so many times the share of all labelled urls.
CONFIDENCE, LIFT = 0.6, 1.2
#: Tokens of a labelled url whose combinations ``filter_sql`` lists: its rarest among the frequent ones. ``mined_rules`` takes all.
TOKENS = 8


def parts(url: Column) -> dict[str, Column]:
    """host, path and query of a url; all empty where it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    query = F.regexp_extract(F.substr(rest, F.length(host) + F.length(path) + 1), r"^\?([^#]*)", 1)
    return {"host": F.translate(host, UPPER, LOWER), "path": path, "query": query}


def tokens(host: Column, path: Column, query: Column) -> Column:
    """The distinct tokens of a url, sorted: labels of its host, segments of its path with # for digits, and keys of its query."""
    some = lambda kind, values, of: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind), of(x)))
    hosts = some("h:", F.split(host, r"\."), lambda x: x)
    segments = some("p:", F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    keys = some("q:", F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    return F.array_sort(F.array_distinct(F.concat(hosts, segments, keys)))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str]], verdict: bool = False) -> Column:
    """The longest of ``rules`` (verdict, host with path) that fits, or its verdict; null if none does. Of equally long ones the first."""
    found = []
    for kind, rule in sorted(rules, key=lambda r: -len(r[1])):
        cut = rule.index("/")
        of_host = (host == rule[:cut]) | host.endswith("." + rule[:cut])
        found.append(F.when(of_host & path.startswith(rule[cut:]), F.lit(kind if verdict else rule)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(_row, tokens, bad) of the urls whose document has a label: the last number of a path is the doc_id of the page's document.

    A document is bad if its quality is 0 or it is toxic. The urls of a document that very many pages carry are spread.
    """
    cut = pages.select(*[c.alias(n) for n, c in parts(F.col("url")).items()])
    number = F.regexp_extract("path", "([0-9]+)[^0-9]*$", 1)
    # 18 digits fit into a long
    urls = written(cut.select(F.monotonically_increasing_id().alias("_row"), tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"), F.when(F.length(number).between(1, 18), number.try_cast("long")).alias("doc_id")), "urls")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    named = urls.where("doc_id IS NOT NULL")
    hot = hot_keys(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), ["doc_id"])
    return written(spread_join(named, marks, ["doc_id"], hot, ["_row"]).select("_row", "tokens", "bad"), "labelled")


RULES_SCHEMA = "verdict string, body array<string>, support long, total long, confidence double, lift double, choices array<array<string>>"


def _unbeaten(rules: DataFrame, masks: str) -> DataFrame:
    """``rules`` without those that have a part of their tokens, one of ``masks`` (SQL for bits), as a rule of at least their confidence."""
    longer = rules.where(F.size("body") > 1).withColumn("mask", F.explode(F.expr(masks)))
    less = longer.select("verdict", F.col("body").alias("longer"), F.col("confidence").alias("of_longer"), F.expr("filter(body, (x, i) -> (mask & shiftleft(1L, i)) <> 0)").alias("body"))
    beaten = less.join(rules.select("verdict", "body", "confidence"), ["verdict", "body"]).where("confidence >= of_longer").select("verdict", F.col("longer").alias("body")).distinct()
    return rules.join(beaten, ["verdict", "body"], "left_anti")


def mined_rules(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """The association rules body => verdict of ``labelled`` (_row, tokens, bad), from all frequent tokens of each url.

    A rule with a part of its tokens and at least its confidence makes a rule superfluous. Columns: verdict (block or allow), body (sorted
    tokens), support (urls with body and label), total (urls with body), confidence, lift, and choices: for each token of the body, all
    that lie on the same labelled urls, itself included. Any of them may stand for it, as the rule is the same; with two of them in a
    body one is superfluous. So only the smallest of such tokens is mined, and copies of a long url have few combinations.
    """
    spark = labelled.sparkSession
    n, n_bad = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    enough = max(least, -int(-support * n // 1))
    each = labelled.select("_row", F.explode("tokens").alias("token"))
    # tokens on the same urls have the same number and the same 128 bits from them
    same = ["n", "_x", "_y"]
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("_row")).alias("_x"), F.bit_xor(F.xxhash64("_row", F.lit(1))).alias("_y"))
    frequent = written(counted.where(F.col("n") >= enough).groupBy(*same).agg(F.array_sort(F.collect_list("token")).alias("choices")).select(F.get("choices", 0).alias("token"), "n", "choices"), "tokens")
    first = frequent.select("token", "n")
    kept = spread_join(each, first, ["token"], hot_keys(first, ["token"]), ["_row"]).groupBy("_row").agg(F.collect_list("token").alias("kept"))
    items = F.concat("kept", F.array(F.when(F.col("bad"), "=block").otherwise("=allow")))
    baskets = written(labelled.join(kept, "_row").select(items.alias("items")), "baskets")
    m = baskets.count()
    if m < enough:
        return spark.createDataFrame([], RULES_SCHEMA)
    sets = FPGrowth(itemsCol="items", minSupport=(enough - 0.5) / m).fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    marked = sets.select(F.filter("items", lambda x: ~x.startswith("=")).alias("body"), F.filter("items", lambda x: x.startswith("=")).alias("mark"), "freq").where(F.size("body") > 0)
    marked = written(marked, "sets")
    whole = marked.where(F.size("mark") == 0).select("body", F.col("freq").alias("total"))
    with_label = marked.where(F.size("mark") == 1).select(F.substr(F.get("mark", 0), F.lit(2)).alias("verdict"), "body", F.col("freq").alias("support"))
    base = F.when(F.col("verdict") == "block", F.lit(n_bad)).otherwise(F.lit(n - n_bad)) / F.lit(float(n))
    sure = F.col("support") / F.col("total")
    rules = with_label.join(whole, "body").select("verdict", "body", "support", "total", sure.alias("confidence"), (sure / base).alias("lift"))
    rules = written(rules.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift)), "rules")
    # what a beaten rule beats is beaten by the same part, so bodies with one token less go first, and few are left for all parts
    rules = written(_unbeaten(rules, "transform(sequence(0, size(body) - 1), i -> shiftleft(1L, size(body)) - 1 - shiftleft(1L, i))"), "shorter")
    rules = _unbeaten(rules, "sequence(1L, shiftleft(1L, size(body)) - 2)")
    own = rules.select("verdict", "body", F.explode("body").alias("token")).join(frequent.select("token", "choices"), "token")
    choices = own.groupBy("verdict", "body").agg(F.array_sort(F.collect_list(F.struct("token", "choices")))["choices"].alias("choices"))
    return written(rules.join(choices, ["verdict", "body"]).select("verdict", "body", "support", "total", "confidence", "lift", "choices"), "pruned")


def inverted_index(rules: DataFrame) -> DataFrame:
    """One row, ``index``: rules_of, a map from token to the rules that are posted under it, each under the rarest token of its body, and
    token_of, a map from each of their choices to the token of the body that it stands for.

    The rarest is the one in the fewest rules, so that common tokens lead to few of them.
    """
    numbered = rules.select(F.struct("confidence", "support", "verdict", "body").alias("rule"), F.explode("body").alias("token"))
    used = numbered.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = numbered.join(used, "token").groupBy("rule").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    lists = posted.groupBy("token").agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    own = rules.select(F.explode(F.arrays_zip("body", "choices")).alias("c")).groupBy("c.body").agg(F.first("c.choices").alias("choices"))
    chosen = own.select(F.explode("choices").alias("choice"), "body")
    index = lists.agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("rules_of")).crossJoin(chosen.agg(F.map_from_entries(F.collect_list(F.struct("choice", "body"))).alias("token_of")))
    return index.select(F.struct("rules_of", "token_of").alias("index"))


def judged(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame, default: str = "allow") -> DataFrame:
    """Each page's page_id, host, path, rule (the given one that decides) and verdict, and the mined rule that speaks on it.

    Of the mined rules whose tokens a url all has, the one with the highest confidence speaks, then the one with the widest support.
    Where a url has several choices for a token, the largest is shown. The index is one value, of the size of the rules that are left
    and their choices, which Spark sends to the tasks; pages are not shuffled.
    """
    cut = pages.select("page_id", *[c.alias(n) for n, c in parts(F.col("url")).items()])
    looked = cut.withColumns({"_tokens": tokens(F.col("host"), F.col("path"), F.col("query")), "_index": inverted_index(mined).scalar()})
    known = F.transform("_tokens", lambda t: F.struct(F.try_element_at("_index.token_of", t).alias("of"), t.alias("token")))
    looked = looked.withColumn("_known", F.filter(known, lambda x: x["of"].isNotNull())).withColumn("_has", F.array_distinct("_known.of"))
    lists = F.transform("_has", lambda t: F.coalesce(F.try_element_at("_index.rules_of", t), F.expr("cast(array() as array<struct<confidence: double, support: bigint, verdict: string, body: array<string>>>)")))
    fitting = F.filter(F.flatten(lists), lambda r: F.size(F.array_except(r["body"], F.col("_has"))) == 0)
    largest = lambda t: F.array_max(F.filter("_known", lambda x: x["of"] == t))["token"]
    shown = F.transform(fitting, lambda r: F.struct(r["confidence"].alias("confidence"), r["support"].alias("support"), r["verdict"].alias("verdict"), F.array_sort(F.transform(r["body"], largest)).alias("body")))
    found = looked.withColumn("_rule", F.array_max(shown))
    return found.select(
        "page_id", "host", "path", given_rule(F.col("host"), F.col("path"), rules).alias("rule"),
        F.coalesce(given_rule(F.col("host"), F.col("path"), rules, verdict=True), F.col("_rule.verdict"), F.lit(default)).alias("verdict"),
        F.array_join("_rule.body", " ").alias("mined"), F.col("_rule.confidence").alias("confidence"), F.col("_rule.support").alias("support"),
    )


def filtered_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """Verdicts on all pages by ``rules``, then by what is mined from the pages whose documents have labels."""
    return judged(pages, rules, mined_rules(labelled_urls(pages, labels)), default)


def filter_sql(rules: list[tuple[str, str]], default: str = "allow") -> str:
    """DuckDB SQL for ``filtered_urls``: it lists the combinations of each labelled url's tokens and counts them."""
    fits = lambda r: f"((host = '{r[: r.index('/')]}' OR ends_with(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/') :]}'))"
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{pick(k, r)}'" for k, r in ordered) + " END"
    return f"""
WITH a AS (SELECT page_id, row_number() OVER () AS row, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT *, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
u AS (SELECT page_id, row, translate(h, '{UPPER}', '{LOWER}') AS host, path, regexp_extract(substr(rest, length(h) + length(path) + 1), '^\\?([^#]*)', 1) AS query FROM c),
t AS (SELECT page_id, row, host, path, list_sort(list_distinct(list_concat(
  list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')),
  list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'q:' || regexp_extract(x, '^[^=]*'))))) AS tokens,
  CASE WHEN length(regexp_extract(path, '([0-9]+)[^0-9]*$', 1)) BETWEEN 1 AND 18 THEN regexp_extract(path, '([0-9]+)[^0-9]*$', 1)::BIGINT END AS doc FROM u),
m AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
l AS (SELECT row, tokens, CASE WHEN bad = 1 THEN 'block' ELSE 'allow' END AS verdict FROM t JOIN m ON m.doc_id = t.doc),
e AS (SELECT greatest({LEAST}, ceil({SUPPORT} * count(*)))::BIGINT AS enough, count(*) AS n FROM l),
v AS (SELECT verdict, count(*) AS k FROM l GROUP BY 1),
f AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM l) GROUP BY 1 HAVING count(*) >= (SELECT enough FROM e)),
k AS (SELECT row, list_sort((list(token ORDER BY f.n, token))[1:{TOKENS}]) AS kept FROM (SELECT row, unnest(tokens) AS token FROM l) JOIN f USING (token) GROUP BY 1),
s AS (SELECT verdict, list_transform(list_filter(list_zip(kept, range(len(kept))), lambda x: (mask >> x[2]) & 1 = 1), lambda x: x[1]) AS body
  FROM (SELECT verdict, kept, unnest(range(1, (1 << len(kept))::BIGINT)) AS mask FROM k JOIN l USING (row))),
w AS (SELECT body, count(*) AS total FROM s GROUP BY 1),
r AS (SELECT * FROM (SELECT verdict, body, count(*) AS support, any_value(total) AS total, count(*) / any_value(total) AS confidence, count(*) / any_value(total) / (any_value(v.k) / any_value(e.n)) AS lift
  FROM s JOIN w USING (body) JOIN v USING (verdict), e GROUP BY verdict, body HAVING count(*) >= any_value(e.enough)) WHERE confidence >= {CONFIDENCE} AND lift >= {LIFT}),
p AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.verdict = r.verdict AND len(q.body) < len(r.body) AND list_has_all(r.body, q.body) AND q.confidence >= r.confidence)),
z AS (SELECT t.row, array_to_string(p.body, ' ') AS mined, p.confidence, p.support, p.verdict FROM t JOIN p ON list_has_all(t.tokens, p.body)
  QUALIFY row_number() OVER (PARTITION BY t.row ORDER BY p.confidence DESC, p.support DESC, p.verdict DESC, p.body DESC) = 1)
SELECT page_id, host, path, {case(lambda k, r: r)} AS rule, coalesce({case(lambda k, r: k)}, z.verdict, '{default}') AS verdict, mined, confidence, support FROM t LEFT JOIN z USING (row)
"""
