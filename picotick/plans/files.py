"""Queries that write the driver's tables in the formats of the sources and read them back."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.scratch import folder
from ..sources import tables, tdc, trc
from .registry import register
from .stages import Stage, StageRun
from .tables import read, rounded


def _hit_files(spark, sf_dir, mode: int) -> str:
    """The events as hit lists, a file for each of three runs; returns their folder."""
    e = read(spark, sf_dir, "events").select(
        F.concat(F.lit("Run"), F.col("user_id") % 3).alias("run"), F.floor(F.col("event_id") / 4).alias("event_index"), (F.floor(F.col("event_id") / 4) * 10).alias("timestamp"),
        F.floor(F.col("event_id") / 4).alias("trigger_id"), (F.col("user_id") % 4).alias("board"), F.length("event_type").alias("channel"), (F.col("event_id") % 2).alias("edge"), F.col("event_id").alias("toa"), (F.col("user_id") % 1000).alias("tot"))
    path = folder(spark)
    tdc.write_hits(e, "run", path, mode, tdc.LEAD_TRAIL, 3.125, 3.125)
    return path


_HITS = """SELECT user_id % 3 AS run, (event_id // 4 * 10)::DECIMAL(20, 0) AS stamp, (user_id % 4)::SMALLINT AS board, length(event_type)::SMALLINT AS channel, (event_id % 2)::SMALLINT AS edge, event_id AS toa, {tot} AS tot FROM events"""


def _scanned(spark, sf_dir, mode: int) -> DataFrame:
    h = tdc.read_hits(spark, _hit_files(spark, sf_dir, mode), ["path", "timestamp", "board", "channel", "edge", "toa", "tot"])
    run = F.regexp_extract("path", r"Run(\d+)_list", 1).cast("long")
    return h.select(run.alias("run"), F.col("timestamp").alias("stamp"), "board", "channel", "edge", F.col("toa").cast("long").alias("toa"), "tot")


@register("src_hits_streaming", _HITS.format(tot="(user_id % 1000)::INT"))
def src_hits_streaming(spark, sf_dir):
    return _scanned(spark, sf_dir, tdc.STREAMING)


@register("src_hits_trigger", _HITS.format(tot="(user_id % 1000)::INT"))
def src_hits_trigger(spark, sf_dir):
    return _scanned(spark, sf_dir, tdc.TRIGGER)


@register("src_headers", "SELECT DISTINCT 'TRG_MATCHING' AS acquisition_mode, 3 AS measurement_mode, 3.125::DOUBLE AS toa_lsb_ps, 3.125::DOUBLE AS tot_lsb_ps, user_id % 3 AS run FROM events")
def src_headers(spark, sf_dir):
    h = tdc.read_headers(spark, _hit_files(spark, sf_dir, tdc.TRIGGER), expected="TRG_MATCHING")
    return h.select("acquisition_mode", "measurement_mode", "toa_lsb_ps", "tot_lsb_ps", F.regexp_extract("path", r"Run(\d+)_list", 1).cast("long").alias("run"))


@register("src_concatenated", "SELECT count(*) AS hits, count(DISTINCT event_id // 4) AS stamps, max(event_id) AS last FROM events")
def src_concatenated(spark, sf_dir):
    path = _hit_files(spark, sf_dir, tdc.STREAMING)
    whole = tdc.concatenated(tdc.read_headers(spark, path), tdc.read_hits(spark, path, ["timestamp", "toa"]))
    return whole.agg(F.count("*").alias("hits"), F.count_distinct("timestamp").alias("stamps"), F.max("toa").cast("long").alias("last"))


@register("src_run_info", """SELECT n_nationkey AS run, CASE WHEN n_nationkey % 2 = 0 THEN 'STREAMING' ELSE 'TRG_MATCHING' END AS acquisition_mode, (n_nationkey + 5)::DOUBLE AS energy_threshold_mv,
  CASE WHEN n_nationkey % 3 = 0 THEN 20 ELSE n_nationkey + 5 END::DOUBLE AS timing_threshold_mv, n_nationkey % 3 <> 0 OR n_nationkey = 15 AS consistent FROM nation""")
def src_run_info(spark, sf_dir):
    n = F.col("n_nationkey")
    mode = F.when(n % 2 == 0, "STREAMING").otherwise("trigger_matching")
    lines = F.array_compact(F.array(F.concat(F.lit("DiscrThreshold "), n + 5), F.concat(F.lit("AcquisitionMode "), mode), F.lit("# comment"), F.when(n % 3 == 0, F.lit("DiscrThreshold[0][3] 20"))))
    info = read(spark, sf_dir, "nation").select(n.cast("string").alias("path"), F.explode(lines).alias("value"))
    return tdc.parse_info(info).select(F.col("path").cast("long").alias("run"), "acquisition_mode", "energy_threshold_mv", "timing_threshold_mv", "consistent")


@register("src_discovered_runs", "SELECT (user_id % 3)::VARCHAR AS run_id, 'Run' || user_id % 3 || '_list.dat' AS data, 'Run' || user_id % 3 || '_Info.txt' AS info FROM events GROUP BY ALL")
def src_discovered_runs(spark, sf_dir):
    path = _hit_files(spark, sf_dir, tdc.TRIGGER)
    info = read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("r")).distinct().select(F.concat(F.lit("Run"), "r", F.lit("_Info.txt")).alias("name"), F.lit("AcquisitionMode STREAMING").cast("binary").alias("content"))
    tables.write_binary(info, path, F.col("name"))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    return tdc.discover_runs(spark, path).select("run_id", last("data_path").alias("data"), last("info_path").alias("info"))


@register("src_traces", """SELECT vec_id AS event_id, channel::INT AS channel, round(list_sum(list_transform(embedding[(channel - 1) * 16 + 1 : channel * 16], lambda x: round_even(x::DOUBLE * 1000, 0))), 3) + 0.0 AS total, 16 AS n
  FROM embeddings, range(1, 5) t(channel)""")
def src_traces(spark, sf_dir):
    """Embeddings as traces, a file for each event and channel, read back and met by event."""

    def encode(batches):
        for pdf in batches:
            names, contents = [], []
            for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                for c in range(4):
                    head = bytearray(trc.SAMPLES_AT)
                    struct.pack_into("<i", head, trc.COUNT_AT, 16)
                    struct.pack_into("<f", head, trc.GAIN_AT, 0.001)
                    struct.pack_into("<f", head, trc.INTERVAL_AT, 0.5)
                    names.append(f"C{c + 1}--run--{i:08d}.trc")
                    contents.append(bytes(head) + np.rint(np.asarray(v[16 * c : 16 * c + 16], dtype=float) * 1000).astype("<i2").tobytes())
            yield pd.DataFrame({"name": names, "content": contents})

    path = folder(spark)
    tables.write_binary(read(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(encode, "name string, content binary"), path, F.col("name"))
    wide = trc.events(trc.read_traces(spark, path))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"ch{c}.samples").alias("s")) for c in (1, 2, 3, 4)])).alias("t")
    return rounded(wide.select("event_id", each).select("event_id", "t.channel", F.aggregate("t.s", F.lit(0.0), lambda a, v: a + v).alias("total"), F.size("t.s").alias("n")), 3)


@register("src_csv_table", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def src_csv_table(spark, sf_dir):
    given = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = f"{folder(spark)}/t.csv"
    tables.write_table(given, path)
    return tables.read_table(spark, path, given.schema)


@register("src_parquet_union", "SELECT o_orderstatus, count(*) * 2 AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def src_parquet_union(spark, sf_dir):
    given = read(spark, sf_dir, "orders")
    path = f"{folder(spark)}/t.parquet"
    tables.write_table(given, path)
    back = tables.read_table(spark, path, given.schema)
    return tables.merged([back, given]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@register("src_fit_row", "SELECT count(*) AS n, [min(o_totalprice), max(o_totalprice)] AS limits FROM orders")
def src_fit_row(spark, sf_dir):
    """A fit of one row with an array, as text and back."""
    fit = read(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.array(F.min("o_totalprice"), F.max("o_totalprice")).alias("limits"))
    path = f"{folder(spark)}/fit.csv"
    tables.write_table(tables.fit_row_to_text(fit), path)
    return tables.fit_row_from_text(tables.read_table(spark, path, "n long, limits string"), ["limits"])


@register("src_json_documents", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_regionkey::DOUBLE END AS share FROM nation")
def src_json_documents(spark, sf_dir):
    share = F.when(F.col("n_nationkey") % 2 == 1, F.col("n_regionkey").cast("double"))
    text = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", share.alias("share")).select(tables.json_document(["n_nationkey", "n_name", "share"]).alias("value"))
    path = folder(spark)
    text.write.text(path)
    return spark.read.schema("n_nationkey long, n_name string, share double").json(path)


@register("src_canonical_hash", "SELECT r_regionkey, sha256('{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}') AS digest FROM region")
def src_canonical_hash(spark, sf_dir):
    return read(spark, sf_dir, "region").select("r_regionkey", F.sha2(tables.json_document(["r_name", "r_regionkey"]), 256).alias("digest"))


@register("src_alias_lookup", "SELECT n_nationkey, n_name AS found FROM nation")
def src_alias_lookup(spark, sf_dir):
    doc = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct(F.col("n_name").alias("Bias-Voltage")))).otherwise(F.to_json(F.struct(F.col("n_name").alias("bias_voltage"))))
    return read(spark, sf_dir, "nation").select("n_nationkey", tables.alias_lookup(doc, ["voltage", "bias voltage"]).alias("found"))


@register("src_complete_runs", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'status is ' || o_orderstatus END AS reason FROM orders")
def src_complete_runs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "complete").otherwise(F.col("o_orderstatus"))
    done, others = tables.complete_runs(read(spark, sf_dir, "orders").select("o_orderkey", status.alias("status")))
    return done.select("o_orderkey", F.lit(None).cast("string").alias("reason")).unionByName(others.select("o_orderkey", "reason"))


@register("orc_stage_cache", "SELECT 'first' AS run, 2::BIGINT AS made, count(*) AS n FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT 'again', 0, count(*) FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT 'changed', 1, count(*) FROM orders WHERE o_totalprice > 100000")
def orc_stage_cache(spark, sf_dir):
    """A chain of two stages made, found again, and remade from the changed stage on."""
    path = folder(spark)

    def run(least: int):
        stages = [Stage("read", lambda: read(spark, sf_dir, "orders")), Stage("select", lambda t, least: t.where(F.col("o_totalprice") > least), ("read",), {"least": least})]
        r = StageRun(spark, path, stages)
        return r.table("select").agg(F.count("*").alias("n")), r

    parts = []
    for name, least in (("first", 1000), ("again", 1000), ("changed", 100000)):
        n, r = run(least)
        parts.append(n.select(F.lit(name).alias("run"), F.lit(len(r.made)).cast("long").alias("made"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("orc_role_isolation", "SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'development' ELSE 'blind' END AS role FROM events")
def orc_role_isolation(spark, sf_dir):
    """Roles by source; an event in two roles would raise."""
    role = F.when(F.col("user_id") % 3 == 0, "control").when(F.col("user_id") % 3 == 1, "development").otherwise("blind")
    return tables.one_role(read(spark, sf_dir, "events").select("event_id", role.alias("role")), "event_id", "role", ["control", "development", "blind"])


@register("fn_tri_state_words", "SELECT CASE n_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE NULL END AS kept, n_nationkey FROM nation")
def fn_tri_state_words(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(w) for w in ("Selected", " drop", "PASS", "perhaps")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "nation").select(scalars.tri_state(word, selection=True).alias("kept"), "n_nationkey")
