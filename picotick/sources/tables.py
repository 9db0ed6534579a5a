"""Tables and documents: reading and writing with declared schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV or Parquet by the path's ending; the committer makes the folder appear whole."""
    if path.endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    elif path.endswith(".parquet"):
        df.write.mode(mode).option("compression", "zstd").parquet(path)
    else:
        raise ValueError(f"no format for {path}")


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Columns of a declared schema; empty CSV fields are null."""
    reader = spark.read.schema(schema)
    if path.endswith(".csv"):
        return reader.option("header", True).option("mode", "FAILFAST").csv(path)
    if path.endswith(".parquet"):
        return reader.parquet(path)
    raise ValueError(f"no format for {path}")


def write_events(df: DataFrame, path: str, run: str, about: dict) -> None:
    """An event table as Parquet by run, and beside it one row of what holds for all of it."""
    df.write.option("compression", "lz4").partitionBy(run).parquet(f"{path}/events")
    df.sparkSession.createDataFrame([about]).coalesce(1).write.parquet(f"{path}/metadata")


def read_events(spark: SparkSession, path: str, columns: list[str | tuple[str, object]]) -> tuple[DataFrame, DataFrame]:
    """Asked columns of an event table, and its row of metadata. A (column, default) may be missing; others raise."""
    events = spark.read.parquet(f"{path}/events")
    return events.select(*[F.col(c) if isinstance(c, str) else optional(events, *c) for c in columns]), spark.read.parquet(f"{path}/metadata")


def schema_differences(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns that are missing in b, extra in b, or of another type."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return {"missing": sorted(x.keys() - y.keys()), "extra": sorted(y.keys() - x.keys()), "changed": sorted(k for k in x.keys() & y.keys() if x[k] != y[k])}


def merged(tables: list[DataFrame]) -> DataFrame:
    """Union of tables of one schema; any difference raises with a report."""
    first, *rest = tables
    for i, t in enumerate(rest, 1):
        found = schema_differences(first, t)
        if any(found.values()):
            raise ValueError(f"table {i} differs: {found}")
        first = first.unionByName(t)
    return first


def optional(df: DataFrame, column: str, default) -> Column:
    """The column if the table has it, else a constant."""
    return F.col(column) if column in df.columns else F.lit(default).alias(column)


def fit_row_to_text(df: DataFrame) -> DataFrame:
    """Array columns as JSON text, for a one-row CSV."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def fit_row_from_text(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Back to arrays; reading anything but one row raises."""
    n = df.agg(F.count("*")).scalar()
    ok = F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a fit has exactly one row")).cast("boolean"))
    return df.where(ok).select(*[F.from_json(c, "array<double>").alias(c) if c in arrays else F.col(c) for c in df.columns])


def json_document(columns: list[str]) -> Column:
    """A canonical JSON text: keys in order, NaN and infinity as null."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def alias_lookup(document: Column, names: list[str]) -> Column:
    """Value of the first of several names in a JSON object, whatever their case and punctuation."""
    plain = F.transform_keys(F.from_json(document, "map<string,string>"), lambda k, _: F.regexp_replace(F.lower(k), "[^a-z0-9]", ""))
    return F.coalesce(*[F.element_at(plain, "".join(c for c in n.lower() if c.isalnum())) for n in names])


def complete_runs(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifests whose status is complete, and the others with a reason."""
    status = F.col("status")
    reason = F.when(status.isNull(), "no status").otherwise(F.concat(F.lit("status is "), status))
    return manifests.where(status == "complete"), manifests.where(status.isNull() | (status != "complete")).withColumn("reason", reason)


def qualified(spark: SparkSession, path: str) -> str:
    """The full address of a path, as Spark's file systems see it: with the scheme of the default one if it has none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def store(address: str):
    """(file system, path) of a full address."""
    from pyarrow import fs

    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address)


def opened(address: str):
    """A file for reading at any place, inside tasks."""
    files, path = store(address)
    return files.open_input_file(path)


class Appender:
    """A file that appears under its name once it is closed, so a task that is run again replaces it."""

    def __init__(self, folder: str, name: str):
        import uuid

        self.files, base = store(folder)
        where, _, file = f"{base}/{name}".rpartition("/")  # the name may lead into folders below
        self.name, self.path, self.part = name, f"{where}/{file}", f"{where}/.{file}.{uuid.uuid4().hex}"
        try:
            self.out = self.files.open_output_stream(self.part)
        except FileNotFoundError:  # most often the folder is there, and making it is several calls
            self.files.create_dir(where, recursive=True)
            self.out = self.files.open_output_stream(self.part)
        self.write = self.out.write

    def close(self) -> None:
        self.out.close()
        self.files.move(self.part, self.path)


def write_binary(df: DataFrame, folder: str, name: Column) -> int:
    """Writes each row's ``content`` as a file of its own, inside tasks; returns their number."""
    to = qualified(df.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = Appender(to, file)
                out.write(content.as_buffer())
                out.close()
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return df.select(name.alias("name"), "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: Bytes and numbers of files that a task hands on at once.
READ_AT_ONCE, LISTED_AT_ONCE = 16 << 20, 10_000


def _listed(files, at: str) -> list[tuple[str, bool]]:
    """(name, is it a file) of what a folder holds, without what Spark takes as hidden."""
    from pyarrow import fs

    found = ((f.base_name, f.type == fs.FileType.File) for f in files.get_file_info(fs.FileSelector(at)))
    return [(n, is_file) for n, is_file in found if not n.startswith(".") and (not n.startswith("_") or "=" in n)]


def read_binary(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """``folder``, ``name``, ``content`` of all files of these names (``*`` and ``?`` stand for others) at any depth below a folder.

    Folders are listed level by level, each by a task, and files are read in tasks: a tree of any number
    of files passes the driver by. A store that only Spark can open is read by Spark.
    """
    from fnmatch import fnmatchcase

    from ..operators.scratch import stored

    root = qualified(spark, folder).rstrip("/")
    try:
        store(root)
    except pa.ArrowInvalid:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
        return found.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listing(batches: Iterator[pa.RecordBatch]):
        files, base = store(root)

        def batch(entries: list) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*entries, strict=True), (pa.string(), pa.string(), pa.bool_()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["below", "name", "is_file"])

        entries: list = []  # of many folders: one with a file or two is no batch of its own
        for b in batches:
            for below in b.column(0).to_pylist():
                entries += [(below, n, f) for n, f in _listed(files, base + below) if not f or any(fnmatchcase(n, w) for w in names)]
                if len(entries) >= LISTED_AT_ONCE:
                    yield batch(entries)
                    entries = []
        if entries:
            yield batch(entries)

    def reading(batches: Iterator[pa.RecordBatch]):
        files, base = store(root)

        def batch(rows: list) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["folder", "name", "content"])

        rows, size = [], 0
        for b in batches:
            for below, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{base}{below}/{name}") as f:
                    rows.append((root + below, name, f.read()))
                size += len(rows[-1][2])
                if size > READ_AT_ONCE or len(rows) == LISTED_AT_ONCE:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    level, found = spark.range(1).select(F.lit("").alias("below")), None
    while True:
        entries = stored(level.repartition(tasks, "below").mapInArrow(listing, "below string, name string, is_file boolean"))
        here = entries.where("is_file").drop("is_file")
        found = here if found is None else found.unionAll(here)
        level = entries.where("not is_file").select(F.concat("below", F.lit("/"), "name").alias("below"))
        if level.isEmpty():
            return found.repartition(tasks, "below", "name").mapInArrow(reading, "folder string, name string, content binary")


def one_role(df: DataFrame, id_col: str, role: str, roles: list[str]) -> DataFrame:
    """The rows; reading them raises where a role is unknown or an id is in several roles."""
    of = df.groupBy(id_col).agg(F.count_distinct(role).alias("_roles"))
    ok = F.when(F.col(role).isin(*roles) & (F.col("_roles") == 1), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("roles are not kept apart at id "), F.col(id_col).cast("string"))).cast("boolean"))
    return df.join(of, id_col).where(ok).drop("_roles")
