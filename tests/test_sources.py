import struct
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from picotick.sources import tables, tdc, trc


def hits_table(spark, mode):
    rows = [("r1", e, 1000 + e, 7 * e, h % 2, h, h % 2, 10**6 * e + h, 5 + h) for e in range(4) for h in range(e + 1)]
    return spark.createDataFrame(rows, "run string, event_index long, timestamp long, trigger_id long, board int, channel int, edge int, toa long, tot int")


def as_rows(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.event_index, int(r.timestamp), int(r.trigger_id), r.board, r.channel, r.edge, int(r.toa), r.tot) for r in df.collect())


@pytest.mark.parametrize("mode", [tdc.STREAMING, tdc.TRIGGER])
@pytest.mark.parametrize("split", [1, 64, tdc.SPLIT_BYTES])
def test_round_trip(spark, tmp_path, monkeypatch, mode, split):
    """Files of several parts, read whole and in splits of an event or a few."""
    monkeypatch.setattr(tdc, "PART_EVENTS", 3)
    folder = tmp_path / "a folder"
    hits = hits_table(spark, mode).unionByName(hits_table(spark, mode).withColumn("run", F.lit("r2")).withColumn("event_index", F.col("event_index") + 5))
    assert tdc.write_hits(hits.repartition(5), "run", str(folder), mode, tdc.LEAD_TRAIL, 3.125, 3.125, 12.5) == 2
    read = tdc.read_hits(spark, str(folder), split_bytes=split)
    assert {1: 8, 64: 4, tdc.SPLIT_BYTES: 2}[split] <= read.rdd.getNumPartitions() <= 8
    # events are numbered by their place in the file
    want = sorted((f"{r.run}_list.dat", r.event_index - 5 * (r.run == "r2"), r.timestamp, r.trigger_id if mode == tdc.TRIGGER else 0, r.board, r.channel, r.edge, r.toa, r.tot) for r in hits.collect())
    assert as_rows(read) == want
    some = tdc.read_hits(spark, str(folder), ["toa", "board"], split_bytes=split)
    assert some.columns == ["toa", "board"] and sorted(int(r.toa) for r in some.collect()) == sorted(w[7] for w in want)
    meta = tdc.read_headers(spark, str(folder)).collect()
    assert [(m.acquisition_mode, m.toa_lsb_ps) for m in meta] == [(tdc.MODE_NAMES[mode], 3.125)] * 2
    with pytest.raises(Exception, match="is of mode"):
        tdc.read_headers(spark, str(folder), "STREAMING" if mode == tdc.TRIGGER else "TRG_MATCHING").collect()


def test_batches_keep_every_hit(monkeypatch):
    table = pa.table({"event_index": pa.array(np.repeat(np.arange(50), 7)), "timestamp": pa.array(np.repeat(np.arange(50), 7)), "board": pa.array([1] * 350), "channel": pa.array([2] * 350), "edge": pa.array([0] * 350), "toa": pa.array(range(350)), "tot": pa.array([3] * 350)})
    data = tdc.packed(table.take(pa.array(list(range(349, -1, -1)))), tdc.STREAMING, tdc.LEAD_TRAIL)
    monkeypatch.setattr(tdc, "BATCH_HITS", 20)
    found = list(tdc.decoded(data, 100, tdc.STREAMING, tdc.LEAD_TRAIL, ["event_index", "toa"]))
    assert len(found) > 10 and sorted(int(x) for b in found for x in b.column("toa").to_pylist()) == list(range(350))
    assert [x for b in found for x in b.column("event_index").to_pylist()] == np.repeat(np.arange(100, 150), 7).tolist()
    assert sum(b.num_rows for b in tdc.decoded(b"", 0, tdc.STREAMING, tdc.LEAD_TRAIL, ["toa"])) == 0


def test_times_beyond_doubles_stay_exact():
    head, record = tdc.layout(tdc.STREAMING, tdc.LEAD_ONLY)
    hit = np.array([(1, 2, 0, 2**63 + 1)], dtype=record)
    data = struct.pack(tdc.HEADER, 3, 2, 0, 0, tdc.STREAMING, tdc.LEAD_ONLY, 0, 1.0, 0.0, 1.0, 0) + struct.pack("<H", 2 + struct.calcsize(head) + hit.nbytes) + struct.pack(head, 5, 1) + hit.tobytes()
    assert next(tdc.events_of(data)) == (5, 0, [2**63 + 1])
    wide = pa.table({"event_index": pa.array([0]), "timestamp": pa.array([1]), "board": pa.array([1]), "channel": pa.array([1]), "edge": pa.array([0]), "toa": pa.array([Decimal(2**64 - 1)], pa.decimal128(20, 0)), "tot": pa.array([None], pa.int32())})
    assert [int(x) for x in next(tdc.decoded(tdc.packed(wide, tdc.STREAMING, tdc.LEAD_TRAIL), 0, tdc.STREAMING, tdc.LEAD_TRAIL, ["toa"])).column("toa").to_pylist()] == [2**64 - 1]


def spoiled(spark, tmp_path, spoil):
    folder = tmp_path / "run"
    tdc.write_hits(hits_table(spark, tdc.STREAMING), "run", str(folder), tdc.STREAMING, tdc.LEAD_TRAIL, 1.0, 1.0)
    file = folder / "r1_list.dat"
    file.write_bytes(spoil(file.read_bytes()))
    return str(folder)


BAD = [lambda d: d[:20], lambda d: d[:-1], lambda d: d + b"\x01", lambda d: b"\x02" + d[1:], lambda d: d[:33] + b"\x05\x00" + d[35:], lambda d: d[:33] + b"\xff\xff" + d[35:], lambda d: d[:13] + b"\x00" * 8 + d[21:], lambda d: d[:43] + b"\x07" + d[44:], lambda d: d[:47] + b"\x09" + d[48:]]


@pytest.mark.parametrize("spoil", BAD)
def test_bad_files_raise(spark, tmp_path, spoil):
    path = spoiled(spark, tmp_path, spoil)
    with pytest.raises(Exception, match="TdcError"):
        tdc.read_hits(spark, path).collect()
    with pytest.raises(tdc.TdcError):
        list(tdc.events_of(open(f"{path}/r1_list.dat", "rb").read()))  # noqa: SIM115


def test_fields_that_do_not_fit(spark):
    hits = hits_table(spark, tdc.TRIGGER).toArrow()
    spoil = lambda c, v: hits.set_column(hits.schema.get_field_index(c), c, pa.array([v] * len(hits), pa.int64()))
    for c, v in (("toa", 1 << 32), ("tot", 70_000), ("board", -1), ("timestamp", -5)):
        with pytest.raises(tdc.TdcError, match=c):
            tdc.packed(spoil(c, v), tdc.TRIGGER, tdc.LEAD_TRAIL)
    with pytest.raises(tdc.TdcError, match="too large"):
        tdc.packed(pa.concat_tables([spoil("event_index", 1)] * 800), tdc.TRIGGER, tdc.LEAD_TRAIL)


def test_a_header_alone(spark, tmp_path):
    path = spoiled(spark, tmp_path, lambda d: d[:33])
    assert tdc.read_hits(spark, path).collect() == [] and tdc.read_headers(spark, path).count() == 1


def test_run_info(spark):
    lines = ["DiscrThreshold 40", "  discrthreshold[0][3]  20 # timing", "DiscrThreshold[0][7] 20", "DiscrThreshold[1][5] 99", "AcquisitionMode streaming"]
    df = spark.createDataFrame([("a", x) for x in lines] + [("b", "DiscrThreshold[0][1] 3"), ("b", "DiscrThreshold 1.5"), ("b", "AcquisitionMode TRIGGER_MATCHING")], "path string, value string")
    got = {r.path: tuple(r)[1:] for r in tdc.parse_info(df).collect()}
    assert got == {"a": ("STREAMING", 40.0, 20.0, True), "b": ("TRG_MATCHING", 3.0, 1.5, False)}


def test_discovery(spark, tmp_path):
    for name in ("Run5_list.dat", "Run5_Info.txt", "Run12_list.dat"):
        (tmp_path / name).write_bytes(b"x")
    with pytest.raises(Exception, match="info file"):
        tdc.discover_runs(spark, str(tmp_path)).collect()
    (tmp_path / "Run12_Info.txt").write_bytes(b"x")
    assert {r.run_id for r in tdc.discover_runs(spark, str(tmp_path)).collect()} == {"5", "12"}


def trace(n=50, gain=0.00025, interval=2.5e-12, short=0):
    head = bytearray(trc.SAMPLES_AT)
    struct.pack_into("<i", head, trc.COUNT_AT, n)
    struct.pack_into("<f", head, trc.GAIN_AT, gain)
    struct.pack_into("<f", head, trc.INTERVAL_AT, interval)
    struct.pack_into("<d", head, trc.START_AT, -1e-8)
    return bytes(head) + np.arange(n - short, dtype="<i2").tobytes()


def test_the_driver_lists_no_traces(spark, tmp_path):
    for c in range(1, 5):
        (tmp_path / f"C{c}--run--00001.trc").write_bytes(trace())
    rows = trc.read_traces(spark, str(tmp_path))
    assert not [f for f in rows.inputFiles() if f.endswith(".trc")] and rows.count() == 4


def test_traces(spark, tmp_path):
    for c in range(1, 5):
        for e in range(5):
            bad = c == 2 and e == 3
            (tmp_path / f"C{c}--run--{e:05d}.trc").write_bytes(trace(short=2 if bad else 0))
    rows = trc.read_traces(spark, str(tmp_path))
    assert [r.error for r in rows.collect() if r.error] == ["file is shorter than its samples"]
    events = {r.event_id: r for r in trc.events(rows).collect()}
    assert set(events) == {0, 1, 2, 4}
    assert events[0].ch3.samples == list(range(50)) and events[0].ch1.h_offset == -1e-8
    assert trc.decode(trace(interval=0.0))[-1] and trc.decode(b"")[-1] and trc.decode(trace(n=1))[-1]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "k int, s string, x double")
    for end in ("csv", "parquet"):
        path = str(tmp_path / f"t.{end}")
        tables.write_table(df, path)
        assert sorted(map(tuple, tables.read_table(spark, path, df.schema).collect())) == [(1, "a", None), (2, None, 0.5)]
    with pytest.raises(ValueError, match="differs"):
        tables.merged([df, df.withColumnRenamed("s", "t")])
    fit = spark.createDataFrame([(1.5, [1.0, 2.0])], "fwhm double, edges array<double>")
    assert tables.fit_row_from_text(tables.fit_row_to_text(fit), ["edges"]).collect()[0].edges == [1.0, 2.0]
    doc = spark.createDataFrame([('{"Bias-Voltage V": "48", "n": "3"}',)], "d string")
    assert doc.select(tables.alias_lookup(doc.d, ["voltage", "bias_voltage_v"])).collect()[0][0] == "48"
