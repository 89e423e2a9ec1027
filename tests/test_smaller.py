"""Session files, bundles, nested waveforms, bounded jitter and typed empty results."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from intervale.operators import longsignals as L
from intervale.operators import relational as R
from intervale.operators import replicates as B
from intervale.operators import sampled as D
from intervale.sources import files as S


@pytest.fixture(scope="module")
def sessions(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sessions")
    for sub, ses in (("1", "1"), ("1", "2"), ("2", "1"), ("10", "1")):
        spark.createDataFrame([(int(sub), float(ses)), (int(sub), 0.0)], "unit long, value double").coalesce(1).write.parquet(f"{root}/sub-{sub}/sub-{sub}_ses-{ses}_units.parquet")
    (root / "sub-1" / "notes.txt").write_text("x")
    return str(root)


def test_session_files(spark, sessions):
    every = S.session_files(spark, sessions, "*.parquet").collect()
    assert [(r["subject"], r["session"]) for r in every] == [("1", "1"), ("1", "2"), ("10", "1"), ("2", "1")] and all(r["length"] > 0 for r in every)
    assert [r["session"] for r in S.session_files(spark, sessions, "*.parquet", subject="1").collect()] == ["1", "2"]
    assert [r["subject"] for r in S.session_files(spark, sessions, "*.parquet", session="ses-1", most=2).collect()] == ["1", "10"]
    assert S.session_files(spark, sessions, "*.nwb").count() == 0 and S.session_files(spark, sessions).count() >= 5


def test_tables_of_many_files(spark, sessions, tmp_path):
    schema = StructType().add("unit", "long").add("value", "double")
    found = S.session_tables(spark, sessions, schema).where("value > 0")
    assert sorted((r["subject"], r["session"], r["unit"], r["value"]) for r in found.collect()) == [("1", "1", 1, 1.0), ("1", "2", 1, 2.0), ("10", "1", 10, 1.0), ("2", "1", 2, 1.0)]
    (tmp_path / "sub-9_ses-1.parquet").write_bytes(b"no parquet at all")
    assert S.session_tables(spark, str(tmp_path), schema).count() == 0


def test_bundles(spark):
    df = spark.createDataFrame([(1, "a", "x", None), (2, "a", "y", None), (3, "a", "y", "q")], "id long, one string, two string, some string")
    assert D.detected_bundle(df, ["gone", "id", "one", "two"]) == "two"  # unique and constant ones do not bundle
    assert D.detected_bundle(df, ["id", "some"]) == "some"  # a missing value is a value
    assert D.detected_bundle(df, ["id"]) is None and D.detected_bundle(df, ["id"], "one") == "one"


def test_nested_waveforms(spark):
    dice = np.random.default_rng(1)
    for shape in ((5, 7), (12, 7), (4, 3, 7), (1, 1, 7)):
        x = dice.standard_normal(shape)
        if len(shape) == 3:
            means = x.mean(axis=0)
            want = means[np.ptp(means, axis=1).argmax()]
        else:
            want = x[np.ptp(x, axis=1).argmax()] if len(x) <= 8 else x.mean(axis=0)
        kind = "array<" * len(shape) + "double" + ">" * len(shape)
        df = spark.createDataFrame([(x.tolist(),), ([],), (None,)], f"w {kind}")
        found = [r["w"] for r in df.select(D.mean_wave(F.col("w"), len(shape)).alias("w")).collect()]
        assert found[0] == pytest.approx(want) and found[1:] == [None, None]


def test_jitter_stays_inside(spark):
    df = spark.range(300).select("id", (F.col("id") % 20).alias("t"))
    found = df.select("t", B.jittered_inside(F.col("t"), F.lit(0), F.lit(19), 15, F.col("id"), 20).alias("x")).collect()
    assert all(0 <= r["x"] <= 19 and -15 <= r["x"] - r["t"] < 15 for r in found) and len({r["x"] - r["t"] for r in found}) > 20
    far = df.select(B.jittered_inside(F.col("t") + 100, F.lit(0), F.lit(19), 5, F.col("id"), 3).alias("x")).collect()
    assert {r["x"] for r in far} == {19}  # none fits: cut


def test_rows_in_the_order_of_a_list(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    assert [tuple(r) for r in R.in_order_of(df, "k", ["b", "x", "a", "b"], "string").orderBy("place").select("place", "k", "v").collect()] == [(0, "b", 2), (1, "x", None), (2, "a", 1), (3, "b", 2)]


def test_typed_results_without_rows(spark):
    curve = spark.createDataFrame([("a", "b", -2, 10, 0.25), ("a", "b", 0, 10, None), ("a", "c", 4, 9, 0.5)], "phase_key string, amplitude_key string, lag long, n long, mi double")
    wide = L.wide_lags(curve, [-2, 0, 4])
    assert {tuple(r) for r in wide.collect()} == {("a", "b", 0.25, None, None), ("a", "c", None, None, 0.5)}
    assert L.no_coupling(curve, [-2, 0, 4]).schema == wide.schema and L.no_coupling(curve, [1]).count() == 0
    assert L.no_locking(curve).columns == ["unit", "channel", "n", "mvl", "z", "p"]
