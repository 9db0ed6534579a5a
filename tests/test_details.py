import math

import pytest
from pyspark.sql import functions as F

from picotick.functions import arrays as A
from picotick.operators import histogram, matching, order
from picotick.sources import tables, trc

from .test_sources import trace


def test_bins(spark):
    x = [0.0, 0.999, 1.0, 4.0, 4.001, -0.1, None]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert [r.b for r in df.select(histogram.uniform_bin(F.col("x"), 0.0, 4.0, 4).alias("b")).collect()] == [0, 0, 1, 3, None, None, None]
    angles = [0.0, math.pi, 2 * math.pi, -0.01, -2 * math.pi, 7 * math.pi, None]
    df = spark.createDataFrame([(v,) for v in angles], "a double")
    assert [r.b for r in df.select(histogram.circular_bin(F.col("a"), 4).alias("b")).collect()] == [0, 2, 0, 3, 0, 2, None]


def test_positions_and_quality(spark):
    df = spark.createDataFrame([(1, [0.0, 5.0, 1.0, 6.0, 0.0]), (2, [0.0]), (3, []), (4, None), (5, [None, 7.0])], "id int, x array<double>")
    got = {r.id: r for r in df.select("id", A.first_position(F.col("x"), lambda v: v > 4).alias("f"), A.last_position(F.col("x"), lambda v: v > 4).alias("l"), A.baseline_quality(F.col("x"), F.lit(-1.0), F.lit(7.0), 1.0).alias("q")).collect()}
    assert [(got[i].f, got[i].l) for i in range(1, 6)] == [(1, 3), (None, None), (None, None), (None, None), (1, 1)]
    assert (got[1].q.clearance, got[1].q.clipped) == (1.0, True) and got[2].q.rms is None and got[2].q.clearance is None and not got[2].q.clipped and not got[3].q.clipped


def test_quantile_groups_without_keys(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    found = order.quantile_groups(df, "x", [], [(0, 25), (20, 60)]).groupBy("band").agg(F.min("x").alias("a"), F.max("x").alias("z"), F.count("*").alias("n"))
    assert {r.band: (r.a, r.z, r.n) for r in found.collect()} == {0: (0.0, 24.0, 25), 1: (20.0, 59.0, 40)}


def test_both_sides(spark):
    energy = spark.createDataFrame([(1, 100, 200), (1, 300, 400), (2, 100, 200)], "k int, ea long, eb long")
    timing = spark.createDataFrame([(1, 95, 199), (1, 95, 150), (1, 100, 190), (1, 90, 195), (1, 89, 195), (2, 95, 201)], "k int, ta long, tb long")
    got = sorted((r.ea, r.ta, r.tb) for r in matching.both_sides(energy, timing, ["k"], ("ea", "eb"), ("ta", "tb"), 11).collect())
    assert got == [(100, 90, 195), (100, 95, 199)]


def test_events_and_what_holds_for_all(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a"), (2, 1.5, "b")], "event int, v double, run string")
    tables.write_events(df, str(tmp_path), "run", {"channels": 4, "mode": "x"})
    events, about = tables.read_events(spark, str(tmp_path), ["event", ("run", ""), ("offset", 7.0)])
    assert sorted(map(tuple, events.collect())) == [(1, "a", 7.0), (2, "b", 7.0)] and about.first().asDict() == {"channels": 4, "mode": "x"}
    with pytest.raises(Exception, match="nothing"):
        tables.read_events(spark, str(tmp_path), ["nothing"])
    assert "offset" not in events.select("event")._jdf.queryExecution().optimizedPlan().toString()


def test_channels_meet_by_place_where_ids_differ(spark, tmp_path):
    """Channels that number their events on their own meet in order of their ids."""
    for c in range(1, 5):
        for e in range(4):
            (tmp_path / f"C{c}--run--{100 * c + e:05d}.trc").write_bytes(trace(n=10 + e))
    found = {r.event_id: r for r in trc.events(trc.read_traces(spark, str(tmp_path))).collect()}
    assert sorted(found) == [0, 1, 2, 3] and all(len(found[e][f"ch{c}"].samples) == 10 + e for e in found for c in range(1, 5))
