"""Removal of repeated multi-line passages by content-defined chunks, with DataFrame functions alone.

A rolling hash runs over the line hashes: a polynomial in those of the last two lines. A chunk ends after a line where it is small;
the choice depends on these two lines only, so insertions elsewhere do not move it. Chunks of two or more lines that occur again
anywhere in the corpus are removed except where they come first. Equal keys lead to a comparison of the bytes themselves: chunks are
grouped by key and text, summed in each task before the shuffle, and texts that share a key by chance are told apart by their bytes.
A chunk that is everywhere makes no hot task: its occurrences are spread before they meet its first place.

A repeated passage that holds no whole chunk keeps its lines then. ``remove_repeated_passages``, which the pipeline uses, finds
these too, by the pairs of neighbouring lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.llm.skew import hot_keys, spread_join
from intervale.llm.store import written

#: A chunk ends where the rolling hash, modulo 16, is below this: after every fourth line on average.
CUT_BELOW = 4
#: Base of the rolling hash.
BASE = 1_000_003


#: In a joined text each line starts with LINE; a line of CUT alone ends a chunk. No line holds a \n, so both stay apart from the text.
LINE, CUT = "a", "b"


def chunked(df: DataFrame, text: Column, cut_below: int = CUT_BELOW) -> DataFrame:
    """``df`` with _lines, and with _chunks: the chunks of ``text``, each one string of lines that start with LINE.

    Lines, hashes and chunks come step by step, and functions of elements see no other array, so each is computed once.
    """
    lines = df.withColumn("_lines", F.split(text, "\n", -1))
    hashed = lines.withColumn("_hashes", F.transform("_lines", lambda line: F.conv(F.substring(F.md5(line), 1, 6), 16, 10).cast("long")))
    before = F.slice(F.concat(F.array(F.lit(0).cast("long")), F.col("_hashes")), 1, F.size("_lines"))
    ends = F.zip_with(before, "_hashes", lambda b, h: (b * BASE + h) % 16 < cut_below)
    marked = F.zip_with("_lines", ends, lambda line, end: F.concat(F.lit(LINE), line, F.when(end, "\n" + CUT).otherwise("")))
    pieces = F.split(F.array_join(marked, "\n"), rf"\n{CUT}(?:\n|\z)", -1)
    return hashed.withColumn("_chunks", F.filter(pieces, lambda piece: piece != "")).drop("_hashes")


def key_of(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _twin() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def repeated_chunks(docs: DataFrame, cut_below: int = CUT_BELOW) -> DataFrame:
    """(doc_id, _twin, gone): of each document that has any, the sorted numbers of its chunks that occur earlier.

    _twin is a hash of the text, which tells documents under one doc_id apart.
    """
    text = docs.where("doc_id IS NOT NULL").select("doc_id", _twin().alias("_twin"), F.coalesce("text", F.lit("")).alias("text"))
    each = chunked(text, F.col("text"), cut_below).select("doc_id", "_twin", F.posexplode("_chunks").alias("number", "chunk")).where(F.col("chunk").contains("\n"))
    keyed = written(each.select(key_of(F.col("chunk")).alias("key"), "chunk", "doc_id", "_twin", "number"), "chunks", compression="zstd")
    place = F.struct("doc_id", "_twin", "number")
    by_bytes = keyed.groupBy("key", "chunk").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    by_key = by_bytes.groupBy("key").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    repeated = written(by_key.where("n > 1"), "repeated")
    later = spread_join(keyed.select("key", "doc_id", "_twin", "number"), repeated.where("texts = 1").select("key", "first"), ["key"], hot_keys(repeated, ["key"]), ["doc_id", "number"])
    shared = repeated.where("texts > 1").select("key")
    if not shared.isEmpty():  # texts with one key by chance meet each on their own
        apart = keyed.join(shared, "key")
        firsts = apart.groupBy("key", "chunk").agg(F.min(place).alias("first"))
        later = later.unionByName(apart.join(firsts, ["key", "chunk"]).drop("chunk"))
    return later.where(place != F.col("first")).groupBy("doc_id", "_twin").agg(F.array_sort(F.collect_set("number")).alias("gone"))


def remove_repeated_chunks(docs: DataFrame, cut_below: int = CUT_BELOW) -> DataFrame:
    """``docs`` with later copies of repeated multi-line chunks cut from ``text``; n_lines and n_removed are added.

    Lines end at \\n. Earlier is a smaller doc_id, or an earlier place in the same document; the first copy stays. All columns of
    ``docs`` stay, and n_chars, where it is one of them, becomes the new length; columns already named n_lines or n_removed are
    replaced. A text that loses all its lines becomes empty, and its row stays.

    Null and empty texts lose nothing (a null stays null, with no lines). A row with a null doc_id is left whole. Rows that repeat a doc_id
    with the same text count as that document and get a row each; one with another text is a document of its own. Blank lines are lines. An empty table gives an empty one.
    """
    gone = repeated_chunks(docs, cut_below).select(F.col("doc_id").alias("_gone_doc"), F.col("_twin").alias("_gone_twin"), F.col("gone").alias("_gone"))
    joined = docs.withColumn("_twin", _twin()).join(gone, (F.col("doc_id") == F.col("_gone_doc")) & (F.col("_twin") == F.col("_gone_twin")), "left")
    touched = F.when(F.col("_gone").isNotNull(), F.coalesce("text", F.lit("")))
    cut = chunked(joined, touched, cut_below).withColumn("_flags", _flags(F.col("_gone")))
    told = F.zip_with("_chunks", "_flags", lambda c, f: F.struct(c.alias("chunk"), F.coalesce(f, F.lit(False)).alias("gone")))
    cut = cut.withColumn("_left", F.transform(F.filter(told, lambda x: ~x["gone"]), lambda x: x["chunk"]))
    left = F.array_join("_left", "\n")
    plain = F.substr(F.replace(F.concat(F.lit("\n"), left), F.lit("\n" + LINE), F.lit("\n")), F.lit(2))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(plain)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_left = F.when(F.size("_left") > 0, F.length(left) - F.length(F.replace(left, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    n_removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_lines") - n_left).cast("long")
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    same = [new.get(c, F.col(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut.select(*same, n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def _spans(df: DataFrame, cut_below: int) -> DataFrame:
    """``df`` with _lines and _chunks of its text, exploded to key, chunk, start and end: its chunks and its pairs.

    A pair is two neighbouring non-blank lines with the blank ones between them. Any run of non-blank lines that occurs twice has
    all its pairs twice, wherever the chunks' boundaries lie. Keys are 128 bits of the text's SHA-256; pairs and chunks start with other letters.
    """
    both = chunked(df, F.coalesce("text", F.lit("")), cut_below)
    full = F.filter(F.transform("_lines", lambda line, i: F.struct(line.alias("line"), i.alias("at"))), lambda x: F.trim(x["line"], F.lit(" \t\r")) != "")
    both = both.withColumn("_full", full).withColumn("_many", F.greatest(F.size("_full") - 1, F.lit(0)))
    pair = lambda a, b: F.struct(_digest(F.concat(F.lit("p"), a["line"], F.repeat(F.lit("\n"), b["at"] - a["at"]), b["line"])).alias("key"), F.lit(False).alias("chunk"), a["at"].alias("start"), b["at"].alias("end"))
    pairs = F.zip_with(F.slice("_full", 1, F.col("_many")), F.slice("_full", 2, F.col("_many")), pair)
    numbered = F.filter(F.transform("_chunks", lambda c, i: F.struct(c.alias("text"), i.alias("at"))), lambda x: F.contains(x["text"], F.lit("\n")))
    chunks = F.transform(numbered, lambda x: F.struct(_digest(x["text"]).alias("key"), F.lit(True).alias("chunk"), x["at"].alias("start"), x["at"].alias("end")))
    return both.select("doc_id", "_twin", F.inline(F.concat(pairs, chunks)))


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _flags(numbers: Column) -> Column:
    """An array that is true at ``numbers`` (sorted) and ends with the last of them; linear in its length."""
    before = F.slice(F.concat(F.array(F.lit(-1)), numbers), 1, F.size(numbers))
    return F.flatten(F.zip_with(before, numbers, lambda b, n: F.concat(F.array_repeat(F.lit(False), n - b - 1), F.array(F.lit(True)))))


def remove_repeated_passages(docs: DataFrame, cut_below: int = CUT_BELOW) -> DataFrame:
    """``docs`` with every passage of two or more non-blank lines that occurs earlier cut from ``text``, and the repeated chunks too.

    The lines that ``remove_repeated_chunks`` finds go, and also all lines of runs that no chunk fits into. Earlier is a smaller
    doc_id, or an earlier line of the same document; a line goes only if an equal line stays at an earlier place. A document that
    repeats a passage which is whole nowhere else, but in overlapping parts, loses it. Columns and cases as in
    ``remove_repeated_chunks``, but rows that repeat a doc_id with another text are judged by their own text.
    """
    named = docs.withColumn("_twin", _twin())
    each = written(_spans(named.where("doc_id IS NOT NULL").select("doc_id", "text", "_twin"), cut_below), "spans", compression="zstd")
    place = F.struct("doc_id", "_twin", "start")
    repeated = written(each.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    later = spread_join(each, repeated.select("key", "first"), ["key"], hot_keys(repeated, ["key"]), ["doc_id", "start"]).where(place != F.col("first"))
    lines = F.flatten(F.collect_list(F.when(~F.col("chunk"), F.sequence("start", "end"))))
    gone = later.groupBy(F.col("doc_id").alias("_gone_doc"), F.col("_twin").alias("_gone_twin")).agg(
        F.array_sort(F.collect_set(F.when(F.col("chunk"), F.col("start")))).alias("_gone_chunks"), F.array_sort(F.array_distinct(lines)).alias("_gone_lines"))
    joined = named.join(gone, (F.col("doc_id") == F.col("_gone_doc")) & (F.col("_twin") == F.col("_gone_twin")), "left")
    touched = F.when(F.col("_gone_doc").isNotNull(), F.coalesce("text", F.lit("")))
    cut = chunked(joined, touched, cut_below).withColumn("_flag_chunks", _flags(F.col("_gone_chunks"))).withColumn("_flag_lines", _flags(F.col("_gone_lines")))
    of_chunk = lambda c, f: F.transform(F.split(c, "\n", -1), lambda line: F.struct(F.substr(line, F.lit(2)).alias("line"), F.coalesce(f, F.lit(False)).alias("gone")))
    by_chunk = F.flatten(F.zip_with("_chunks", "_flag_chunks", of_chunk))
    by_line = F.zip_with(by_chunk, "_flag_lines", lambda x, f: F.struct(x["line"].alias("line"), (x["gone"] | F.coalesce(f, F.lit(False))).alias("gone")))
    cut = cut.withColumn("_left", F.transform(F.filter(by_line, lambda x: ~x["gone"]), lambda x: x["line"]))
    text = F.when(F.col("_gone_doc").isNull(), F.col("text")).otherwise(F.array_join("_left", "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_removed = F.when(F.col("_gone_doc").isNull(), 0).otherwise(F.size("_lines") - F.size("_left")).cast("long")
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    same = [new.get(c, F.col(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut.select(*same, n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def chunk_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars_kept and kept_sha256 (of the text left, a null as empty) of each row."""
    found = remove_repeated_chunks(docs.select("doc_id", "text"))
    left = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_removed", F.length(left).cast("long").alias("n_chars_kept"), F.sha2(left, 256).alias("kept_sha256"))


CHUNK_SQL = """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i, len(lines) AS n FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 6))::BIGINT AS h FROM l),
r AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 1000003 + h AS rolled FROM h),
c AS (SELECT *, coalesce(sum(CASE WHEN rolled % 16 < 4 THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS number FROM r),
k AS (SELECT doc_id, number, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n_lines FROM c GROUP BY doc_id, number),
f AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, number) AS turn FROM k WHERE n_lines > 1),
g AS (SELECT doc_id, number, n_lines, chunk, FALSE AS gone FROM k WHERE n_lines = 1
      UNION ALL SELECT doc_id, number, n_lines, chunk, turn > 1 FROM f),
o AS (SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY number) FILTER (NOT gone), '') AS kept,
        sum(CASE WHEN gone THEN n_lines ELSE 0 END) AS n_removed, sum(n_lines) AS n_lines FROM g GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE o.n_lines END::BIGINT AS n_lines, o.n_removed::BIGINT AS n_removed,
  length(o.kept)::BIGINT AS n_chars_kept, sha256(o.kept) AS kept_sha256
FROM d JOIN o USING (doc_id)
"""
