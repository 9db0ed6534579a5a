import numpy as np
import pytest
from pyspark.sql import functions as F

from picotick.operators import matching, resampling, selection
from picotick.streaming.hits import longest_valid_pulses, state_store


def test_stream_equals_batch(spark, tmp_path):
    """Three files as micro-batches, out of order within the allowed lateness."""
    r = np.random.default_rng(3)
    t = np.sort(r.integers(0, 4_000, 300)) * 1_000_000
    rows = [(int(b), int(x), int(k)) for b, x, k in zip(r.integers(0, 3, 300), t, r.integers(0, 2, 300), strict=True)]
    late = [(i % 3, 9_000_000_000 + i, 0) for i in range(3)]  # moves the watermark past everything
    df = spark.createDataFrame(rows + late, "board int, t long, kind int").withColumn("ts", F.timestamp_micros("t"))
    for i, (a, b) in enumerate(((0, 2_000), (2_000, 3_000), (3_000, 100_000))):
        df.where((F.col("t") >= a * 1_000_000) & (F.col("t") < b * 1_000_000)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    state_store(spark)
    found = longest_valid_pulses(stream, "board", "ts", "t", "kind", 2_000_000, 60_000_000)
    q = found.writeStream.format("memory").queryName("pulses").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT board, lead, trail FROM pulses").collect()))
    batch = matching.longest_valid_pulses(spark.createDataFrame(rows, "board int, t long, kind int"), ["board"], F.col("kind"), "t", 2_000_000, 60_000_000)
    assert got == sorted((x.board, x.lead, x.trail) for x in batch.collect())


def test_stream_of_parts_in_several_files(spark, tmp_path):
    """A part of many files is taken whole: none of its hits is late by another of its files."""
    from picotick.plans import peaks

    r = np.random.default_rng(8)
    day = 86_400_000_000
    at = np.sort(r.integers(0, 30 * day, 3000)) + 1_704_067_200_000_000
    rows = [(i, int(t), int(u), ("view", "purchase")[k]) for i, (t, u, k) in enumerate(zip(at, r.integers(0, 20, 3000), r.integers(0, 2, 3000), strict=True))]
    e = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string").select("event_id", F.timestamp_micros("t").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"))
    e.repartition(6, F.hash("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # a split a file
    try:
        got = sorted(map(tuple, peaks.stream_longest_valid(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    hits = spark.createDataFrame([(u, t, int(k == "purchase")) for _, t, u, k in rows], "board long, t long, kind int")
    batch = matching.longest_valid_pulses(hits, ["board"], F.col("kind"), "t", peaks.SHORTEST, peaks.LONGEST)
    last = (int(at.max()) // 1000 - 2 * day // 1000) * 1000
    assert got == sorted(tuple(x) for x in batch.collect() if x.trail <= last) and len(got) > 500


def test_peak_interval_and_fit(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(100, 5, 4000), r.uniform(0, 90, 2000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    low, high = selection.peak_interval(df, "x", 1.0, 2.0, 2.0, bandwidth=0.3)
    assert 84 < low < 95 and 105 < high < 116
    fit = selection.gaussian_peak(df, "x", 1.0)
    assert fit["centre"] == pytest.approx(100, abs=0.5) and fit["sigma"] == pytest.approx(5, abs=0.6)


def test_peaks_of_many_groups(spark):
    """Each group as on its own; errors as large as the spread of the fits."""
    r = np.random.default_rng(6)
    rows = [(g, float(v)) for g, centre in (("a", 40), ("b", -7), (None, 1000)) for v in np.concatenate([r.normal(centre, 3, 3000), r.uniform(centre - 60, centre - 20, 400)])]
    rows += [("one", 5.0), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    found = {q.g: q for q in selection.peak_intervals(df, "x", ["g"], 0.5, 2.0, 2.0, bandwidth=0.3).collect()}
    fits = {q.g: q for q in selection.gaussian_peaks(df, "x", ["g"], 0.5).collect()}
    assert set(found) == set(fits) == {"a", "b", None, "one"} and not fits["one"].success and fits["one"].centre_error is None
    for g, centre in (("a", 40), ("b", -7), (None, 1000)):
        own = df.where(F.col("g").eqNullSafe(F.lit(g)))
        assert selection.peak_interval(own, "x", 0.5, 2.0, 2.0, bandwidth=0.3) == (found[g].low, found[g].high)
        assert found[g].n == 3400 and found[g].centre == pytest.approx(centre, abs=0.5) and found[g].sigma == pytest.approx(3, abs=0.8)
        assert abs(fits[g].centre - centre) < 5 * fits[g].centre_error and 0.03 < fits[g].centre_error < 0.2 and fits[g].chi2 < 3 * fits[g].n_bins
    with pytest.raises(ValueError, match="no peak"):
        selection.peak_interval(df.limit(0), "x", 0.5, 1, 1)
    assert selection._weighted_median(np.array([1.0, 2.0, 9.0]), np.array([1.0, 1.0, 2.0])) == 5.5


def test_uniformity_of_nothing_and_of_one_side(spark):
    df = spark.createDataFrame([("in", 0.1)] * 5 + [("up", 0.6 + i / 10) for i in range(20)] + [(None, None)], "g string, x double")
    got = {q.g: q for q in resampling.uniformity(df, "x", ["g"], 0.5, 3.0, 4).collect()}
    assert set(got) == {"in", "up"} and (got["in"].k, got["in"].density, got["in"].density_low, got["in"].side_p, got["in"].chi2_p, got["in"].ks_p) == (0, 0.0, 0.0, None, None, None)
    assert got["up"].positive == 20 and got["up"].side_p < 1e-5 and got["up"].ks_p < 1e-3 and got["up"].chi2_p < 0.01 and got["up"].density == 4.0
    whole = resampling.uniformity(df, "x", [], 0.5, 3.0, 4).first()
    assert whole.n == 25 and whole.k == 20 and whole.ks == got["up"].ks


def test_sample_mask(spark):
    rows = [([1.0, 0.2, 1.0], [0.0, 0.3, 0.4]) for _ in range(100)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert selection.sample_mask(df, "a", "b") == [False, True, True]
    assert selection.sample_mask(df.select(F.slice("a", 1, 1).alias("a"), F.slice("b", 1, 1).alias("b")), "a", "b") == [True]


def test_choice_and_threshold(spark):
    df = spark.sql("SELECT array(named_struct('duration', 5, 'n', 1), named_struct('duration', 9, 'n', 2), named_struct('duration', 11, 'n', 3)) AS h")
    assert df.select(selection.nearest_duration(F.col("h"), 10, 4, 12).alias("x")).collect()[0].x.n == 2
    scan = spark.createDataFrame([(10.0, 50.0, 0.9), (20.0, 40.0, 0.2), (30.0, 50.0, 0.95)], "threshold double, ctr double, efficiency double")
    assert selection.best_threshold(scan, 0.5).collect()[0].threshold == 10.0
