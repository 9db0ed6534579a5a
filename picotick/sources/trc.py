"""Oscilloscope traces: one binary file per channel and event."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import placed
from ..operators.scratch import stored
from .tables import read_binary

#: Byte offsets of the trace header's fields and of the samples.
COUNT_AT, GAIN_AT, OFFSET_AT, INTERVAL_AT, START_AT, SAMPLES_AT = 127, 167, 171, 187, 191, 357
MOST_SAMPLES = 10_000_000
SCHEMA = "path string, gain float, offset float, interval float, h_offset double, samples array<short>, error string"


def decode(data: bytes) -> tuple:
    """(gain, offset, interval, horizontal offset, samples, error) of a trace; bad ones have only an error."""
    bad = lambda why: (None, None, None, None, None, why)
    if len(data) < SAMPLES_AT:
        return bad("file is shorter than its header")
    (n,) = struct.unpack_from("<i", data, COUNT_AT)
    if not 1 < n <= MOST_SAMPLES:
        return bad(f"{n} samples")
    gain, offset, interval = (struct.unpack_from("<f", data, at)[0] for at in (GAIN_AT, OFFSET_AT, INTERVAL_AT))
    (start,) = struct.unpack_from("<d", data, START_AT)
    if not all(map(np.isfinite, (gain, offset, interval, start))) or interval <= 0:
        return bad("calibration is not finite")
    if len(data) < SAMPLES_AT + 2 * n:
        return bad("file is shorter than its samples")
    return gain, offset, interval, start, np.frombuffer(data, "<i2", n, SAMPLES_AT), None


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """One row of SCHEMA per file, decoded in tasks; invalid traces keep their error."""
    kinds = (pa.string(), pa.float32(), pa.float32(), pa.float32(), pa.float64(), pa.list_(pa.int16()), pa.string())
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]

    def run(batches):
        for b in batches:
            rows = [(name, *decode(data.as_py())) for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    found = read_binary(spark, path, ["*"])
    return found.select(F.concat("folder", F.lit("/"), "name").alias("path"), "content").mapInArrow(run, SCHEMA)


def named(traces: DataFrame) -> DataFrame:
    """Adds ``channel`` (1-4) and ``event_id`` from names like C1--run--00012.trc; other names are left out."""
    at = lambda g: F.regexp_extract("path", r"(?i)(?:^|/)C([1-4])[^/]*?(\d+)\.trc$", g)
    return traces.withColumn("channel", F.try_to_number(F.nullif(at(1), F.lit("")), F.lit("9")).cast("int")).withColumn("event_id", F.nullif(at(2), F.lit("")).cast("long")).where("channel is not null")


def events(traces: DataFrame, share: float = 0.8) -> DataFrame:
    """One row per event with the four channels' traces; an event with an invalid trace is left out.

    Channels meet by id if at least ``share`` of the smallest channel's ids are common to all,
    otherwise by place in order of (id, path). A repeated id or an empty channel raises.
    """
    t = stored(named(traces))  # files are read once
    counts = t.groupBy("channel").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
    common = t.groupBy("event_id").agg(F.count_distinct("channel").alias("c")).where("c = 4").agg(F.count("*").alias("common"))
    # one row decides for the whole table
    about = counts.agg(F.count("*").alias("channels"), F.min("n").alias("least"), F.max(F.col("n") - F.col("ids")).alias("repeats")).select("*", common.scalar().alias("common")).first()
    if about.channels is not None and 0 < about.channels < 4:
        raise ValueError("a channel has no trace")
    by_id = bool(about.least) and about.common >= share * about.least
    if by_id and about.repeats:
        raise ValueError("a channel repeats an event id")
    keyed = t.withColumn("key", F.col("event_id")) if by_id else placed(t, ["channel"], ["event_id", "path"], "key")
    trace = F.struct("gain", "offset", "interval", "h_offset", "samples")
    wide = keyed.groupBy("key").agg(F.count_if(F.col("error").isNull()).alias("good"), *[F.first(F.when(F.col("channel") == c, trace), ignorenulls=True).alias(f"ch{c}") for c in (1, 2, 3, 4)])
    return wide.where("good = 4").select(F.col("key").alias("event_id"), "ch1", "ch2", "ch3", "ch4")
