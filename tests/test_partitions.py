"""Stored partitions: interrupted runs, changed parameters, half-written and empty partitions."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from intervale.sources.partitions import PartitionStore

SCHEMA = StructType().add("band", "string").add("subject", "long").add("session", "long").add("value", "double").add("run", "long")
KEYS = ["band", "subject", "session"]
ALL = [(b, s, k) for b in ("low", "high/é") for s in (1, 2, None) for k in (0, 1)]


def wanted(spark, keys=ALL):
    return spark.createDataFrame(keys, "band string, subject long, session long")


def maker(run, asked, fail_at=None):
    """Two rows for each partition, none for session 1 of subject 2; fails when it is called for the ``fail_at``-th time."""

    def make(missing):
        asked.append(sorted(map(str, map(tuple, missing.collect()))))
        if fail_at is not None and len(asked) == fail_at:
            raise RuntimeError("interrupted")
        rows = missing.withColumn("value", F.explode(F.array(F.lit(1.0), F.lit(2.0)))).withColumn("run", F.lit(run).cast("long"))
        return rows.where(~F.coalesce((F.col("subject") == 2) & (F.col("session") == 1), F.lit(False)))

    return make


def store(spark, path, **parameters):
    return PartitionStore(spark, str(path), "power", parameters, SCHEMA, KEYS)


def test_an_interrupted_run_is_taken_up(spark, tmp_path):
    s, first, second, third = store(spark, tmp_path, rate=400), [], [], []
    with pytest.raises(RuntimeError):
        s.completed(wanted(spark), maker(1, first, fail_at=3), lots=4)
    done = {str(tuple(r)[:3]) for r in s.manifest().collect()}
    assert done == {k for lot in first[:2] for k in lot} and 0 < len(done) < len(ALL)
    found = s.completed(wanted(spark), maker(2, second), lots=4).collect()
    asked = [k for lot in second for k in lot]
    assert sorted(asked) == sorted({str(k) for k in ALL} - done)  # nothing that is stored is made again
    assert len(found) == 2 * (len(ALL) - 2) and {r["run"] for r in found} == {1, 2}
    assert all(r["run"] == (1 if str(tuple(r)[:3]) in done else 2) for r in found)
    again = s.completed(wanted(spark), maker(3, third)).collect()
    assert third == [] and sorted(map(str, again)) == sorted(map(str, found))
    assert {str(tuple(r)[:3]): r["n"] for r in s.manifest().collect()} == {str(k): 0 if k[1:] == (2, 1) else 2 for k in ALL}


def test_half_written_partitions_are_not_seen_and_replaced(spark, tmp_path):
    s = store(spark, tmp_path)
    half = spark.createDataFrame([("low", 1, 0, 9.0, 9), ("low", 2, 0, 9.0, 9)], SCHEMA)
    half.write.partitionBy(*KEYS).parquet(f"{s.path}/data")
    assert s.rows().count() == 0
    found = s.completed(wanted(spark, [("low", 1, 0)]), maker(1, [])).collect()
    assert sorted(r["value"] for r in found) == [1.0, 2.0] and s.rows().count() == 2


def test_other_parameters_and_other_partitions(spark, tmp_path):
    a, b, asked = store(spark, tmp_path, rate=1), store(spark, tmp_path, rate=2), []
    assert a.completed(wanted(spark, ALL[:3]), maker(1, [])).count() > 0
    assert b.rows().count() == 0
    b.completed(wanted(spark, ALL[:3]), maker(1, asked))
    assert len(asked[0]) == 3
    # more is asked for: only that is made, and only what is asked for comes back
    more = []
    assert a.completed(wanted(spark, ALL[2:4]), maker(2, more)).select(*KEYS).distinct().count() == 1 and more == [[str(ALL[3])]]
    assert a.completed(wanted(spark, ALL[:1]), maker(3, more)).select(*KEYS).distinct().count() == 1 and len(more) == 1
    assert a.completed(wanted(spark, ALL[:0]), maker(3, more)).count() == 0


def test_rows_of_other_partitions_are_dropped(spark, tmp_path):
    s = store(spark, tmp_path)
    stray = lambda missing: maker(1, [])(missing.unionByName(wanted(spark, [("stray", 7, 7)])))
    s.completed(wanted(spark, ALL[:2]), stray)
    assert s.rows().where("band = 'stray'").count() == 0 and s.rows().count() == 4
