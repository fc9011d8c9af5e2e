"""Contracts of landed sources, and a Python data source that reads and follows folders under them.

A contract names the columns of a record, its key and its two clocks. `spark.read.format("landed")` takes a contract and
a list of files; comparisons of columns with constants are applied to Arrow batches before rows reach the JVM.
`spark.readStream.format("landed")` follows a folder, file by file in the order of names. Lists of files come from
Spark's own listing (batch) or from the store's file system (stream), never from a local glob.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


@dataclass(frozen=True)
class Contract:
    name: str
    schema: str
    key: tuple[str, ...]
    event: str
    known: str


CONTRACTS = {c.name: c for c in (
    Contract("bars", "symbol string, session date, open double, high double, low double, close double, volume double, available_at timestamp", ("symbol", "session"), "session", "available_at"),
    Contract("quotes", "symbol string, quoted_at timestamp, price double, received_at timestamp", ("symbol", "quoted_at"), "quoted_at", "received_at"),
    Contract("universe", "symbol string, start date, end date, available_at timestamp", ("symbol", "start"), "start", "available_at"),
    Contract("events", "event_id bigint, symbol string, kind string, event_day date, available_at timestamp", ("event_id",), "event_day", "available_at"),
    Contract("intraday", "symbol string, kind string, event_time timestamp, price double, size double, available_at timestamp", ("symbol", "kind", "event_time"), "event_time", "available_at"),
)}


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, n): rows without a key or clock, keys that stand more than once, rows known before they happened."""
    missing = [F.col(c).isNull() for c in (*contract.key, contract.event, contract.known)]
    bad = missing[0]
    for m in missing[1:]:
        bad = bad | m
    copies = df.groupBy(*contract.key).agg(F.count("*").alias("_c")).agg(F.count_if(F.col("_c") > 1).alias("REPEATED_KEY"))
    own = df.agg(F.count("*").alias("ROWS"), F.count_if(bad).alias("MISSING_VALUE"), F.count_if(F.col(contract.known) < F.col(contract.event).cast("timestamp")).alias("KNOWN_BEFORE_EVENT"))
    rules = ("ROWS", "MISSING_VALUE", "REPEATED_KEY", "KNOWN_BEFORE_EVENT")
    return own.join(copies).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])))


def land(df: DataFrame, contract: Contract, folder: str) -> None:
    names = [f.split()[0] for f in contract.schema.split(", ")]
    text = {c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss") for c, k in (f.split() for f in contract.schema.split(", ")) if k == "timestamp"}
    df.select(*[text.get(c, F.col(c)).alias(c) for c in names]).write.mode("append").csv(folder)


def landed_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of a folder's files as Spark lists them, whatever store they are in."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).where("length > 0").select("path").collect()
    return sorted(r.path for r in rows)


def read(spark: SparkSession, contract: Contract, folder: str) -> DataFrame:
    spark.dataSource.register(Landed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("landed").option("contract", contract.name).option("files", json.dumps(landed_files(spark, folder))).load()


def follow(spark: SparkSession, contract: Contract, folder: str) -> DataFrame:
    spark.dataSource.register(Landed)
    return spark.readStream.format("landed").option("contract", contract.name).option("folder", folder).load()


def _store(path: str):
    from pyarrow import fs

    path = path if "://" in path else path.replace("file:", "", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class LandedFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


_TESTS = {EqualTo: "equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}


def _batches(contract: Contract, path: str, tests: list[tuple[str, str, object]]):
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyarrow import csv

    kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "date": pa.date32(), "timestamp": pa.timestamp("us", "UTC")}
    columns = {n: kinds[k] for n, k in (f.split() for f in contract.schema.split(", "))}
    raw = {n: pa.timestamp("us") if pa.types.is_timestamp(k) else k for n, k in columns.items()}
    store, name = _store(path)
    with store.open_input_stream(name) as source:
        options = csv.ConvertOptions(column_types=raw, strings_can_be_null=True, timestamp_parsers=["%Y-%m-%d %H:%M:%S"])
        for batch in csv.open_csv(source, read_options=csv.ReadOptions(column_names=list(columns)), convert_options=options):
            keep = None
            for column, test, value in tests:
                hit = getattr(pc, test)(batch.column(column), pa.scalar(value, raw[column]))
                keep = hit if keep is None else pc.and_(keep, hit)
            batch = batch if keep is None else batch.filter(keep)
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(k) for n, k in columns.items()], list(columns))


class LandedReader(DataSourceReader):
    """One partition for each file."""

    def __init__(self, contract: Contract, files: list[str]):
        self.contract, self.files, self.tests = contract, files, []

    def pushFilters(self, filters):
        plain = {n for n, k in (f.split() for f in self.contract.schema.split(", ")) if k in ("string", "double", "bigint", "date")}
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in plain and f.value is not None:
                self.tests.append((f.attribute[0], _TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        return [LandedFile(p) for p in self.files] or [LandedFile("")]

    def read(self, partition):
        if partition.path:
            yield from _batches(self.contract, partition.path, self.tests)


class LandedStream(DataSourceStreamReader):
    """The offset is the name of the last file that has been read; names must grow with arrival."""

    def __init__(self, contract: Contract, folder: str):
        self.contract, self.folder = contract, folder

    def _names(self) -> list[str]:
        from pyarrow import fs

        store, root = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(i.base_name for i in found if i.type == fs.FileType.File and i.base_name.endswith(".csv") and i.size)

    def initialOffset(self):
        return {"last": ""}

    def latestOffset(self):
        return {"last": max(self._names(), default="")}

    def partitions(self, start, end):
        return [LandedFile(f"{self.folder.rstrip('/')}/{n}") for n in self._names() if start["last"] < n <= end["last"]]

    def read(self, partition):
        yield from _batches(self.contract, partition.path, [])


class Landed(DataSource):
    """Options: `contract`; `files` (a JSON list) to read, `folder` to follow."""

    @classmethod
    def name(cls):
        return "landed"

    @property
    def contract(self) -> Contract:
        return CONTRACTS[self.options["contract"]]

    def schema(self):
        return self.contract.schema

    def reader(self, schema):
        return LandedReader(self.contract, json.loads(self.options["files"]))

    def streamReader(self, schema):
        return LandedStream(self.contract, self.options["folder"])
