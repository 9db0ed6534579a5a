import random

import pytest
from pyspark.sql import functions as F

from picotick.operators import outcomes as O
from picotick.sources import metadata, tables


def sides(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2.0, 3.0, 4.0, 5, False) for r in rows], "event int, side string, deviation double, duration double, average_delay double, selected_delay double, baseline_delay double, candidate_count int, candidate_changed boolean")


def test_a_bad_side_takes_the_other_with_it(spark):
    rows = [(1, "a", 0.1), (1, "b", -0.2), (2, "a", None), (2, "b", 0.0), (3, "a", 0.0), (3, "b", 9.0), (4, "a", None), (4, "b", -9.0), (5, "b", 0.0), (None, "a", 0.0)]
    found = O.settled(sides(spark, rows), "event", 1.0)
    assert {(q.event, q.side): q.status for q in found.collect() if q.event} == {
        (1, "a"): "accepted", (1, "b"): "accepted", (2, "a"): "no_timing_candidate", (2, "b"): "other_side_missing_candidate", (3, "a"): "other_side_deviation_too_large", (3, "b"): "deviation_too_large",
        (4, "a"): "no_timing_candidate", (4, "b"): "deviation_too_large", (5, "b"): "other_side_missing_candidate"}
    kept = O.compact(found, "event")
    assert {q.event: q.status_code for q in kept.collect() if q.event} == {1: 0, 2: 1, 3: 7, 4: 1, 5: 6}
    back = {(q.event, q.side): q for q in O.expanded(kept, "event").collect()}
    assert back[1, "a"].status == "accepted" and back[1, "b"].deviation == -0.2 and back[5, "a"].deviation is None and back[3, "a"].status == "other_side_deviation_too_large"
    told = O.summary(kept.where("event is not null")).first()
    assert (told.events, told.accepted_events, told.rejected_events, told.mean_deviation_a) == (5, 1, 4, 0.1)
    with pytest.raises(Exception, match="comes twice"):
        O.settled(sides(spark, [(1, "a", 0.0), (1, "a", 0.0)]), "event", 1.0).collect()
    assert O.compact(found.limit(0), "event").count() == 0


def test_codes_and_back(spark):
    df = spark.createDataFrame([(k,) for k in [*O.STATUSES, "new", None]], "s string").select("s", O.code_of(F.col("s")).alias("c"))
    got = {q.s: (q.c, q.t) for q in df.select("s", "c", O.status_of(F.col("c")).alias("t")).collect()}
    assert all(got[k] == (v, k) for k, v in O.STATUSES.items()) and got["new"] == got[None] == (255, "unknown")


def write(spark, path, files):
    tables.write_binary(spark.createDataFrame([(n, bytearray(t.encode())) for n, t in files.items()], "name string, content binary"), str(path), F.col("name"))


def test_datasets(spark, tmp_path):
    counts = '"raw_events": 10, "selected_events": 4'
    write(spark, tmp_path, {
        "a/manifest.json": '{"source": "x", "condition": {"bias voltage": 48.5}, ' + counts + "}", "b/manifest.json": '{"source": "x", "voltage_V": "48.5", ' + counts + "}",
        "c/manifest.json": '{"source": "Run_50.25V_2", ' + counts + "}", "HV52V/deep/manifest.json": "{" + counts + "}", "d/manifest.json": '{"source": "y", "voltage": 1}', "e/manifest.json": "no json", "f/other.json": "{" + counts + ', "voltage": 3}'})
    found = {q.source: q for q in metadata.datasets(spark, str(tmp_path)).collect()}
    assert {s: q.voltage for s, q in found.items()} == {"x": 48.5, "Run_50.25V_2": 50.25, "deep": 52.0} and found["x"].retained_percent == 40.0
    write(spark, tmp_path, {"g/manifest.json": '{"source": "x", "voltage": 48.5, "raw_events": 11, "selected_events": 4}'})
    with pytest.raises(Exception, match="disagree on x"):
        metadata.datasets(spark, str(tmp_path)).collect()


def test_the_driver_lists_no_tree(spark, tmp_path):
    write(spark, tmp_path, {f"a b/bias_{40 + i}V/s{i}/manifest.json": '{"raw_events": 10, "selected_events": %d}' % i for i in range(5)} | {"_hidden/manifest.json": "{}", "a b/other.json": "{}"})
    found = metadata.datasets(spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if f.endswith(".json")]
    assert {(q.voltage, q.source, q.selected_events) for q in found.collect()} == {(40.0 + i, f"s{i}", i) for i in range(5)}


def test_results(spark, tmp_path):
    write(spark, tmp_path, {f"b/r{i}/metadata/{n}.json": t for i, files in enumerate([
        {"config": "{}", "manifest": '{"status": "complete"}', "best": '{"id": 1}'}, {"config": "{}", "manifest": '{"status": "running"}'}, {"config": "{}"}, {"manifest": '{"status": "complete"}'}]) for n, t in files.items()})
    runs = {q.folder.rsplit("/", 1)[-1]: q for q in metadata.results(spark, str(tmp_path), complete=False).collect()}
    assert set(runs) == {"r0", "r1"} and runs["r0"].best == '{"id": 1}' and runs["r1"].best is None
    assert [q.folder.rsplit("/", 1)[-1] for q in metadata.results(spark, str(tmp_path)).collect()] == ["r0"]


def test_results_list_no_tree_on_the_driver(spark, tmp_path):
    write(spark, tmp_path, {f"b/r{i}/metadata/{n}.json": '{"status": "complete"}' for i in range(3) for n in ("config", "manifest")} | {"b/r9/config.json": "{}", "b/r9/manifest.json": "{}"})
    found = metadata.results(spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if f.endswith(".json")] and found.count() == 3


def test_duration_timing_without_a_dependence(spark):
    from picotick.operators import bivariate

    r = random.Random(1)
    rows = [("a", r.gauss(50, 5), r.gauss(50, 5), r.gauss(0, 1)) for _ in range(300)] + [("b", float(i), float(i % 3), 2.0 * i) for i in range(40)] + [("few", 1.0, 2.0, 3.0)] * 5
    df = spark.createDataFrame(rows, "run string, x double, y double, t double").withColumn("ok", F.col("run").isNotNull())
    got = {q.run: q for q in bivariate.duration_timing(df, "run", "x", "y", "t", F.col("ok")).collect()}
    assert set(got) == {"a", "b"} and abs(got["a"].pearson_first) < 0.2 and got["a"].improvement_percent < 3
    assert got["b"].slope_first == pytest.approx(2) and got["b"].spearman_first == pytest.approx(1) and got["b"].sigma_corrected == pytest.approx(0, abs=1e-6) and len(got["a"]) == 20


def test_correlation_of_a_constant_side_is_null(spark):
    from picotick.operators.ranking import guarded_corr

    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("c", 1.0, 2.0), ("c", 2.0, 1.0)], "g string, x double, y double")
    assert {q.g: q.r for q in df.groupBy("g").agg(guarded_corr("x", "y").alias("r")).collect()} == {"a": None, "b": None, "c": -1.0}


def test_a_tree_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Orders of one split are written by several tasks."""
    from picotick.plans import outcomes

    orders = spark.createDataFrame([(20 * i, "FO"[i % 2], 1.0) for i in range(40)], "o_orderkey long, o_orderstatus string, o_totalprice double")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    tasks = []
    monkeypatch.setattr(outcomes.tables, "write_binary", lambda df, *_: tasks.append(df.select(F.spark_partition_id().alias("p")).distinct().count()))
    monkeypatch.setattr(outcomes.metadata, "results", lambda s, _: s.createDataFrame([], "folder string, status string, config string, best string"))
    outcomes.src_result_tree(spark, str(tmp_path))
    assert tasks[0] > 1
