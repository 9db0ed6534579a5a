"""Hit lists of a time-to-digital converter: a binary file per run.

A file is a 33-byte header and size-prefixed events without sync marks. It is read in ranges:

1. ``index`` hops over the size prefixes of each file once, in tasks, and writes where every
   ``split_bytes`` or so an event begins (a row a split; tables of millions of files are fine);
2. the data source ``tdc_hits`` plans a partition for each split from that table, and a partition
   reads and decodes its own bytes, for the asked columns only.

So a file of any size is read by many tasks, and memory is one split. Headers are read as 33 bytes
a file. Files are opened through ``tables.opened``, by full addresses that the driver resolves
with Spark's own file systems.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.scratch import folder
from .tables import Appender, opened, qualified, store

HEADER = "<BB3xHHHBBfffQ"
HEADER_SIZE = struct.calcsize(HEADER)
#: Codes of the acquisition and measurement modes.
TRIGGER, STREAMING = 0x32, 0x22
LEAD_ONLY, LEAD_TRAIL = 0x01, 0x03
MEASUREMENTS = (0x01, 0x03, 0x05, 0x09)
MODE_NAMES = {TRIGGER: "TRG_MATCHING", STREAMING: "STREAMING"}

META_SCHEMA = "path string, run_number int, acquisition_mode string, measurement_mode int, toa_lsb_ps double, tot_lsb_ps double, timestamp_lsb_ps double"
#: Times are unsigned 64-bit in the file; decimals keep them exact.
HIT_SCHEMA = "path string, event_index long, timestamp decimal(20,0), trigger_id decimal(20,0), board short, channel short, edge short, toa decimal(20,0), tot int"


class TdcError(ValueError):
    """A file that does not follow the format."""


def header_of(data: bytes) -> dict:
    if len(data) < HEADER_SIZE:
        raise TdcError("truncated header")
    major, minor, _, run, mode, measurement, unit, toa, tot, stamp, _ = struct.unpack_from(HEADER, data)
    checks = (
        (major == 3 and minor >= 2, f"format {major}.{minor} is not 3.2 or later"), (mode in MODE_NAMES, f"acquisition mode {mode:#x}"),
        (measurement in MEASUREMENTS, f"measurement mode {measurement:#x}"), (unit == 0, "times are not in ticks"), (np.isfinite(toa) and toa > 0, f"tick {toa}"),
        (measurement != LEAD_TRAIL or (np.isfinite(tot) and tot > 0), f"duration tick {tot}"), (np.isfinite(stamp) and stamp > 0, f"timestamp tick {stamp}"),
    )
    for good, what in checks:
        if not good:
            raise TdcError(f"bad header: {what}")
    return {"run_number": run, "mode": mode, "measurement": measurement, "toa": float(toa), "tot": float(tot), "stamp": float(stamp)}


def layout(mode: int, measurement: int) -> tuple[str, np.dtype]:
    """Event header (after its size) and hit record of a mode."""
    streaming = mode == STREAMING
    with_tot = measurement == LEAD_TRAIL if streaming else measurement != LEAD_ONLY
    fields = [("board", "u1"), ("channel", "u1"), ("edge", "u1"), ("toa", "<u8" if streaming else "<u4")] + [("tot", "<u2")] * with_tot
    return "<QH" if streaming else "<QQH", np.dtype(fields)


#: Bytes of a split, and hits of a batch.
SPLIT_BYTES, BATCH_HITS = 32 << 20, 100_000
#: Bytes that the pass over size prefixes reads at a time.
_READ = 8 << 20


def _hops(read, start: int, end: int, head_size: int) -> Iterator[tuple[int, int]]:
    """(place, size) of each event between two places of a file; ``read(at, n)`` gives its bytes."""
    at, base, held = start, start, b""
    while at < end:
        if at + 2 > base + len(held):
            base, held = at, read(at, min(_READ, end - at))
            if len(held) < min(2, end - at) or end - at < 2:
                raise TdcError("truncated event")
        (size,) = struct.unpack_from("<H", held, at - base)
        if size < 2 + head_size:
            raise TdcError(f"event of {size} bytes")
        if at + size > end:
            raise TdcError("truncated event")
        yield at, size
        at += size


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``length`` of the files below a path; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _meta(file) -> dict:
    return header_of(file.read_at(HEADER_SIZE, 0) if file.size() >= HEADER_SIZE else b"")


def index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> str:
    """Writes the splits of the files below a path; returns the table's address.

    A row is ``path``, ``start`` and ``stop`` in bytes, ``first`` (the place of its first event in the
    file) and the file's ``mode`` and ``measurement``. Files that end inside an event raise.
    """

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                with opened(name) as file:
                    meta, end = _meta(file), file.size()
                    head_size = struct.calcsize(layout(meta["mode"], meta["measurement"])[0])
                    cuts = [(HEADER_SIZE, 0)]
                    for i, (at, _) in enumerate(_hops(lambda at, n: file.read_at(n, at), HEADER_SIZE, end, head_size)):  # noqa: B023
                        if at - cuts[-1][0] >= split_bytes:
                            cuts.append((at, i))
                rows = [(name, at, stop, i, meta["mode"], meta["measurement"]) for (at, i), (stop, _) in pairwise([*cuts, (end, 0)]) if stop > at]
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "start", "stop", "first", "mode", "measurement"])

    to = qualified(spark, folder(spark))
    files = _files(spark, path).select("path")
    files.repartition(min(files.count(), 10_000) or 1).mapInArrow(run, "path string, start long, stop long, first long, mode int, measurement int").write.parquet(to)
    return to


def decoded(data: bytes, first: int, mode: int, measurement: int, columns: list[str], name: str = "") -> Iterator[pa.RecordBatch]:
    """Batches of the hits of whole events; raises on sizes and edges that do not fit."""
    head, record = layout(mode, measurement)
    stamps = [("timestamp", "<u8")] + [("trigger_id", "<u8")] * (mode == TRIGGER)
    event = np.dtype([("size", "<u2"), *stamps, ("n", "<u2")])
    raw = np.frombuffer(data, np.uint8)
    places = np.array([at for at, _ in _hops(lambda at, n: data[at : at + n], 0, len(data), struct.calcsize(head))], np.int64)
    heads = raw[places[:, None] + np.arange(event.itemsize)].view(event)[:, 0] if len(places) else np.zeros(0, event)
    counts = heads["n"].astype(np.int64)
    wrong = heads["size"] != event.itemsize + counts * record.itemsize
    if wrong.any():
        raise TdcError(f"event of {heads['size'][wrong][0]} bytes with {counts[wrong][0]} hits")
    # events of a batch: as many as hold about BATCH_HITS hits
    ends = np.cumsum(counts)
    cuts = [0, *np.searchsorted(ends, np.arange(BATCH_HITS, int(ends[-1]) if len(ends) else 0, BATCH_HITS), side="right").tolist(), len(places)]
    for a, z in pairwise(dict.fromkeys(cuts)):
        n = counts[a:z]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(places[a:z] + event.itemsize, n) + within * record.itemsize
        hits = raw[at[:, None] + np.arange(record.itemsize)].view(record)[:, 0] if len(at) else np.zeros(0, record)
        if (hits["edge"] > 1).any():
            raise TdcError("bad edge code")
        spread = lambda v, n=n: np.repeat(v, n)
        make = {
            "path": lambda m=len(at): pa.array([name], pa.string()).take(pa.array(np.zeros(m, np.int64))), "event_index": lambda: pa.array(spread(first + np.arange(a, z))),  # noqa: B023
            "timestamp": lambda: _wide(spread(heads["timestamp"][a:z])), "trigger_id": lambda: _wide(spread(heads["trigger_id"][a:z] if mode == TRIGGER else np.zeros(z - a, np.uint64))),  # noqa: B023
            **{k: lambda k=k: pa.array(hits[k].astype(np.int16)) for k in ("board", "channel", "edge")}, "toa": lambda: _wide(hits["toa"]),  # noqa: B023
            "tot": lambda: pa.array(hits["tot"].astype(np.int32)) if "tot" in record.names else pa.nulls(len(hits), pa.int32()),  # noqa: B023
        }
        yield pa.RecordBatch.from_arrays([make[c]() for c in columns], names=columns)


def _wide(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as decimals."""
    return pc.cast(pa.array(values.astype(np.uint64)), pa.decimal128(20, 0))


def events_of(data: bytes):
    """(timestamp, trigger id, toa of its hits) per event of a whole file; raises on sizes and edges that do not fit."""
    meta = header_of(data)
    columns = ["event_index", "timestamp", "trigger_id", "toa"]
    for b in decoded(data[HEADER_SIZE:], 0, meta["mode"], meta["measurement"], columns):
        rows = zip(*(b.column(c).to_pylist() for c in columns), strict=True)
        found: dict = {}
        for i, stamp, trigger, toa in rows:
            found.setdefault((i, int(stamp), int(trigger)), []).append(int(toa))
        yield from ((stamp, trigger, toas) for (_, stamp, trigger), toas in found.items())


class _Split(InputPartition):
    def __init__(self, row: dict):
        super().__init__(row)


class _HitReader(DataSourceReader):
    def __init__(self, table: str, columns: list[str]):
        self.table, self.columns = table, columns

    def partitions(self) -> list[_Split]:
        """One for each split of the index, the file's rows of which are only addresses."""
        import pyarrow.parquet as pq

        files, at = store(self.table)
        return [_Split(row) for row in pq.read_table(at, filesystem=files).sort_by([("path", "ascending"), ("start", "ascending")]).to_pylist()]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        s = partition.value
        with opened(s["path"]) as file:
            data = file.read_at(s["stop"] - s["start"], s["start"])
        yield from decoded(data, s["first"], s["mode"], s["measurement"], self.columns, s["path"])


class HitSource(DataSource):
    """``spark.read.format("tdc_hits")`` with the options ``index`` (a table of ``index``) and ``columns``."""

    @classmethod
    def name(cls) -> str:
        return "tdc_hits"

    def _columns(self) -> list[str]:
        return [c for c in (self.options.get("columns") or "").split(",") if c] or list(_KINDS)

    def schema(self) -> str:
        return ", ".join(f"{c} {_KINDS[c]}" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return _HitReader(self.options["index"], self._columns())


#: Column -> type of HIT_SCHEMA.
_KINDS = dict(c.strip().split(" ", 1) for c in HIT_SCHEMA.replace("20,0", "20;0").split(","))
_KINDS = {k: v.replace(";", ",") for k, v in _KINDS.items()}


def read_hits(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row of HIT_SCHEMA (or the asked columns of it) per hit. ``event_index`` is the event's place in its file, for good."""
    table = index(spark, path, split_bytes)
    if spark.read.parquet(table).limit(1).count() == 0:
        return spark.createDataFrame([], HIT_SCHEMA).select(*(columns or list(_KINDS)))
    spark.dataSource.register(HitSource)
    return spark.read.format("tdc_hits").option("index", table).option("columns", ",".join(columns or [])).load()


def read_headers(spark: SparkSession, path: str, expected: str | None = None) -> DataFrame:
    """One row of META_SCHEMA per file, of which 33 bytes are read. A mode other than the expected one raises."""
    schema = _arrow(spark, META_SCHEMA)

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                with opened(name) as file:
                    m = _meta(file)
                if expected not in (None, MODE_NAMES[m["mode"]]):
                    raise TdcError(f"{name} is of mode {MODE_NAMES[m['mode']]}, its run of {expected}")
                yield pa.RecordBatch.from_pylist([{
                    "path": name, "run_number": m["run_number"], "acquisition_mode": MODE_NAMES[m["mode"]], "measurement_mode": m["measurement"],
                    "toa_lsb_ps": m["toa"], "tot_lsb_ps": m["tot"], "timestamp_lsb_ps": m["stamp"]}], schema=schema)

    return _files(spark, path).select("path").mapInArrow(run, META_SCHEMA)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def packed(table: pa.Table, mode: int, measurement: int) -> bytes:
    """The events of some hits, in order of ``event_index``, as they stand in a file.

    Times that do not fit the mode's record, durations over 16 bits and events over 64 KiB raise.
    """
    head, record = layout(mode, measurement)
    names = ["timestamp"] + ["trigger_id"] * (mode == TRIGGER)
    event = np.dtype([("size", "<u2"), *((n, "<u8") for n in names), ("n", "<u2")])

    def numbers(name: str, kind: np.dtype) -> np.ndarray:
        column = table.column(name)
        try:
            values = pc.cast(column.fill_null(pa.scalar(0, pa.int64()).cast(column.type)), pa.uint64()).to_numpy()
        except pa.ArrowInvalid as e:
            raise TdcError(f"{name} does not fit its field") from e
        if len(values) and values.max() > np.iinfo(kind).max:
            raise TdcError(f"{name} does not fit its field")
        return values.astype(kind)

    at = table.column("event_index").to_numpy()
    order = np.argsort(at, kind="stable")
    hits = np.zeros(len(at), record)
    for k in record.names:
        hits[k] = numbers(k, record[k])[order]
    starts = np.flatnonzero(np.diff(at[order], prepend=at[order[0]] - 1)) if len(at) else np.zeros(0, np.int64)
    counts = np.diff(starts, append=len(at))
    sizes = event.itemsize + counts * record.itemsize
    if len(sizes) and sizes.max() > 0xFFFF:
        raise TdcError("event is too large")
    heads = np.zeros(len(starts), event)
    heads["size"], heads["n"] = sizes, counts
    for name in names:
        heads[name] = numbers(name, event[name])[order][starts]
    out = np.zeros(int(sizes.sum()), np.uint8)
    places = np.cumsum(sizes) - sizes
    out[places[:, None] + np.arange(event.itemsize)] = heads.view(np.uint8).reshape(len(heads), event.itemsize)
    to = np.repeat(places + event.itemsize, counts) + (np.arange(len(at)) - np.repeat(starts, counts)) * record.itemsize
    out[to[:, None] + np.arange(record.itemsize)] = hits.view(np.uint8).reshape(len(hits), record.itemsize)
    return out.tobytes()


#: Events of a part of a file that one task packs.
PART_EVENTS = 1 << 16


def parts(hits: DataFrame, run: str, mode: int, measurement: int, toa_lsb_ps: float, tot_lsb_ps: float = 0.0, timestamp_lsb_ps: float = 1.0) -> DataFrame:
    """``run``, ``part``, ``content``: the pieces of each run's file in their order, the first with its header.

    Events without hits have no rows and are left out.
    """
    top = struct.pack(HEADER, 3, 2, 0, 0, mode, measurement, 0, toa_lsb_ps, tot_lsb_ps, timestamp_lsb_ps, 0)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        name, part = (k.as_py() for k in key)
        return pa.table({"run": [name], "part": pa.array([part], pa.int64()), "content": pa.array([packed(table, mode, measurement)], pa.binary())})

    named = hits.withColumn("run", F.col(run).cast("string")).withColumn("part", F.floor(F.col("event_index") / PART_EVENTS).cast("long"))
    pieces = named.groupBy("run", "part").applyInArrow(pack, "run string, part long, content binary")
    return pieces.unionByName(named.select("run").distinct().select("run", F.lit(-(1 << 62)).cast("long").alias("part"), F.lit(top).alias("content")))


def write_hits(hits: DataFrame, run: str, folder_: str, mode: int, measurement: int, toa_lsb_ps: float, tot_lsb_ps: float = 0.0, timestamp_lsb_ps: float = 1.0) -> int:
    """Writes a file for each run, named ``<run>_list.dat``, of any size; returns their number.

    Parts are packed by many tasks; a file's parts are then appended in order by one, a part at a time.
    """
    spark = hits.sparkSession
    to = qualified(spark, folder_)

    def append(batches):
        out, done = None, 0
        for b in batches:
            for name, content in zip(b.column("run").to_pylist(), b.column("content"), strict=True):
                if out is None or out.name != f"{name}_list.dat":
                    if out:
                        out.close()
                    out, done = Appender(to, f"{name}_list.dat"), done + 1
                out.write(content.as_buffer())
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    pieces = parts(hits, run, mode, measurement, toa_lsb_ps, tot_lsb_ps, timestamp_lsb_ps)
    in_order = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "run").sortWithinPartitions("run", "part").select("run", "content")
    return in_order.mapInArrow(append, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def parse_info(lines: DataFrame) -> DataFrame:
    """Run-info text (``path``, ``value`` per line) -> mode and thresholds per path.

    A board-0 channel override beats the default. ``consistent`` says whether channels 1 and 5,
    and 3 and 7, agree; a file without default or mode has nulls there.
    """
    at = lambda pattern, g: F.nullif(F.regexp_extract("value", pattern, g), F.lit(""))
    number = r"([-+]?\d+(?:\.\d+)?)\b"
    default = at(rf"(?i)^\s*DiscrThreshold\s+{number}", 1).cast("double")
    channel = at(rf"(?i)^\s*DiscrThreshold\s*\[\s*0\s*\]\s*\[\s*(\d+)\s*\]\s+{number}", 1).cast("int")
    level = at(rf"(?i)^\s*DiscrThreshold\s*\[\s*0\s*\]\s*\[\s*(\d+)\s*\]\s+{number}", 2).cast("double")
    mode = F.upper(at(r"(?i)^\s*AcquisitionMode\s+([A-Za-z0-9_]+)\b", 1))
    found = lines.select("path", default.alias("default"), channel.alias("channel"), level.alias("level"), mode.alias("mode"))
    by = found.groupBy("path").agg(F.max("default").alias("default"), F.max("mode").alias("mode"), *[F.max(F.when(F.col("channel") == c, F.col("level"))).alias(f"o{c}") for c in (1, 3, 5, 7)])
    t = {c: F.coalesce(f"o{c}", "default") for c in (1, 3, 5, 7)}
    agree = (F.abs(t[1] - t[5]) <= 1e-12) & (F.abs(t[3] - t[7]) <= 1e-12)
    return by.select("path", F.when(F.col("mode") == "TRIGGER_MATCHING", "TRG_MATCHING").otherwise(F.col("mode")).alias("acquisition_mode"), t[1].alias("energy_threshold_mv"), t[3].alias("timing_threshold_mv"), agree.alias("consistent"))


def discover_runs(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Runs below a folder: ``run_id``, ``data_path``, ``info_path``; repeated ids or a missing info file raise."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path")
    named = files.select("path", F.regexp_extract("path", r"(?i)Run[_-]?(\d+)[^/]*$", 1).alias("run_id"), F.col("path").rlike(r"(?i)_Info\.txt$").alias("info")).where("run_id <> ''")
    one = lambda c, what: F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit(f"not one {what} of run "), F.col("run_id"))).cast("string"))
    found = named.groupBy("run_id").agg(F.collect_list(F.when(~F.col("info"), F.col("path"))).alias("d"), F.collect_list(F.when(F.col("info"), F.col("path"))).alias("i"))
    return found.select("run_id", one("d", "data file").alias("data_path"), one("i", "info file").alias("info_path"))


def concatenated(metas: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of several files as one relation, if their headers agree; otherwise reading it raises."""
    kinds = metas.agg(F.count_distinct(F.struct("acquisition_mode", "measurement_mode", "toa_lsb_ps", "tot_lsb_ps", "timestamp_lsb_ps"))).scalar()
    ok = F.when(kinds <= 1, F.lit(True)).otherwise(F.raise_error(F.lit("files of different modes or ticks")).cast("boolean"))
    return hits.where(ok)
