"""Secret scans with corpus-wide ownership counts, with DataFrame functions alone.

Three patterns give the base spans of each text. A wider pattern adds candidates: long runs of key characters with both letters
and digits. The hashes of all candidates are counted over the corpus by distinct repositories and distinct owners. A value that
several owners hold, or one owner in more repositories than a credential of its own would be in, is a copied example. The others look
live, and candidates of the wider pattern become spans only then. Counting goes by (value, owner, repository) first, and the places of
a value that is in a third of all texts are spread before they meet its counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.llm.skew import hot_keys, spread_join
from intervale.llm.store import written

# The base patterns by kind, in the order that spans at one place are listed in, with the group that holds the
# secret itself and the number of characters that the group has at least.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: The wider pattern, whose matches must hold a letter and a digit.
WIDER = ("owned", r"[A-Za-z0-9+/_=-]{24,}", 0, 24)

#: Owners, and repositories of one owner, that hold an owner's credential at most.
OWNERS, REPOSITORIES = 1, 10

#: Matches of a text that are folded at once; the sums of the groups are folded then, so a text's cost grows with its matches.
FOLDED = 256

SPAN = "struct<start:long,rank:int,end:long,kind:string,value:string,example:boolean>"


def spans_of(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans (code points, end exclusive) of the leftmost matches that do not overlap; those with a short group are dropped.

    The pieces between the matches and the matches themselves give the places, as lengths add up to them.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    none = F.array().cast(f"array<{SPAN}>")
    empty = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), part["value"].alias("value"), F.lit(False).alias("example"))
        fits = F.coalesce(F.length(part["value"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(fits, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    def fold(whole: Column) -> Column:
        def add_group(state: Column, number: Column) -> Column:
            part = F.aggregate(F.slice(whole, number * FOLDED + 1, FOLDED), empty, add)
            moved = F.transform(part["found"], lambda s: s.withField("start", s["start"] + state["at"]).withField("end", s["end"] + state["at"]))
            return F.struct((state["at"] + part["at"]).alias("at"), F.concat(state["found"], F.array(moved)).alias("found"))

        groups = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / FOLDED).cast("int"))
        return F.flatten(F.aggregate(groups, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("found")), add_group, lambda s: s["found"]))

    # as the one element of an array, the matches are found once
    return F.when(text.rlike(pattern), F.transform(F.array(parts), fold)[0]).otherwise(none)


def clear_of(base: Column, wider: Column) -> Column:
    """The spans of ``wider`` that overlap none of ``base``: one pass over both in order; spans of ``wider`` do not overlap each other."""
    told = lambda spans, is_base: F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(is_base).alias("base"), s.alias("span")))
    nothing = F.lit(None).cast(SPAN)
    start = F.struct(F.lit(0).cast("long").alias("upto"), nothing.alias("last"), F.array().cast(f"array<{SPAN}>").alias("kept"))
    with_last = lambda s: F.when(s["last"].isNotNull(), F.concat(s["kept"], F.array(s["last"]))).otherwise(s["kept"])

    def step(s: Column, x: Column) -> Column:
        hit = F.coalesce(x["at"] < s["last"]["end"], F.lit(False))
        after_base = F.struct(F.greatest(s["upto"], x["span"]["end"]).alias("upto"), F.when(hit, nothing).otherwise(s["last"]).alias("last"), s["kept"].alias("kept"))
        after_wider = F.struct(s["upto"].alias("upto"), F.when(x["at"] >= s["upto"], x["span"]).otherwise(nothing).alias("last"), with_last(s).alias("kept"))
        return F.when(x["base"], after_base).otherwise(after_wider)

    return F.aggregate(F.array_sort(F.concat(told(base, True), told(wider, False))), start, step, with_last)


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """_row, doc_id, owner, repository, base and wider spans; values are replaced by their hashes. _row is a number of the row's own."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), text.alias("text"))
    base = F.array_sort(F.concat(*[spans_of(F.col("text"), kind, rank, *rule) for rank, (kind, rule) in enumerate(BASE.items())]))
    wider = F.filter(spans_of(F.col("text"), WIDER[0], len(BASE), *WIDER[1:]), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    found = each.select("_row", "doc_id", "owner", "repository", base.alias("base"), wider.alias("wider"))
    hashed = lambda c: F.transform(c, lambda s: s.withField("value", F.sha2(s["value"], 256)))
    return found.select("_row", "doc_id", "owner", "repository", hashed(F.col("base")).alias("base"), hashed(clear_of(F.col("base"), F.col("wider"))).alias("wider"))


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories, n) of each candidate value of the corpus; n counts its places."""
    each = found.select("owner", "repository", F.explode(F.concat("base", "wider")).alias("span")).select(F.col("span.value").alias("value"), "owner", "repository")
    in_repository = each.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = in_repository.groupBy("value", "owner").agg(F.count("repository").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count("owner").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = OWNERS, most_repositories: int = REPOSITORIES) -> DataFrame:
    """doc_id, base and spans of every row, and of its values n_live and n_example.

    base and spans are arrays of (start, rank, end, kind, value, example), by start, then kind; value is the hash of the secret.
    base has the matches of the three patterns. spans adds matches of the wider one that overlap no base span and whose value
    ``most_owners`` owners and ``most_repositories`` repositories hold at most. example marks base values that more of them hold.

    Null and empty texts have no spans. A null owner or repository is not counted as one. Rows that repeat a doc_id are
    judged each by their own text and count as one repository; a null doc_id keeps its base spans and gets no others. An empty table gives an empty one; columns
    other than doc_id, text, ``owner`` and ``repository`` are not read.
    """
    found = written(candidates(docs, owner, repository), "secrets")
    each = found.where("doc_id IS NOT NULL AND size(base) + size(wider) > 0").select("_row", F.explode(F.concat("base", "wider")).alias("span"))
    counts = written(ownership(found), "owners")
    judged = spread_join(each.withColumn("value", F.col("span.value")), counts, ["value"], hot_keys(counts, ["value"]), ["_row", "span"])
    judged = judged.withColumn("copied", (F.col("n_owners") > most_owners) | (F.col("n_repositories") > most_repositories))
    span = F.col("span").withField("example", F.col("copied"))
    kept = judged.where("NOT copied OR span.kind <> 'owned'").groupBy("_row").agg(F.array_sort(F.collect_set(span)).alias("judged"))
    all_spans = F.coalesce("judged", "base")
    joined = found.join(kept, "_row", "left").select("doc_id", "base", all_spans.alias("spans"))
    return joined.select("*", F.size(F.filter("spans", lambda s: ~s["example"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: s["example"])).cast("long").alias("n_example"))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text), n_live and n_example of each row."""
    n = [F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(BASE)]
    return secret_spans(docs).select("doc_id", *n, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_live", "n_example")
