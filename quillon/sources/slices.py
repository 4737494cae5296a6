"""Recordings as blocks of streams in Parquet with a block index, and a data source that reads slices of them.

A block is a row: stream, start (the number of its first sample in the stream), count, and an array of samples for each receiver.  The index has a row for
each row group: which streams and samples it holds, and how large it is.  A slice [start, start + count) of a stream is planned from the index
alone: only the row groups that it touches become partitions, only the receivers that are asked for are read from them, and
blocks are cut at the slice's ends.

    write_blocks(blocks, folder)
    read_slice(spark, folder, stream=7, start=1_000_000, count=4096, receivers=["i"])

``spark.read.format("sample_blocks")`` is the source itself; where the session has spark.sql.python.filterPushdown.enabled it also takes filters on stream,
start and end from the query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_INDEX = "file string, row_group int, first_stream long, last_stream long, start long, end long, bytes long"
_MOST = (1 << 63) - 1


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file in batch.column("file").to_pylist():
            system, path = _opened(file)
            with system.open_input_file(path) as f:
                meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                held = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
                streams, starts, ends = (held[c].statistics for c in ("stream", "start", "end"))
                rows.append((file, g, streams.min, streams.max, starts.min, ends.max, group.total_byte_size))
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "row_group", "first_stream", "last_stream", "start", "end", "bytes"), r, strict=True)) for r in rows], pa.schema([("file", pa.string()), ("row_group", pa.int32()), *[(c, pa.int64()) for c in ("first_stream", "last_stream", "start", "end", "bytes")]]))


def write_blocks(blocks: DataFrame, folder: str, row_group_bytes: int = 32 << 20) -> None:
    """Writes blocks (stream, start, count and an array for each receiver) in order of stream and start, then their index.

    A folder without an index isn't a recording yet: what a failed job left is never read.
    """
    spark = blocks.sparkSession
    rows = blocks.withColumns({"stream": F.col("stream").cast("long"), "start": F.col("start").cast("long"), "end": (F.col("start") + F.col("count")).cast("long")}).drop("count")
    rows = rows.repartitionByRange("stream", "start").sortWithinPartitions("stream", "start")
    rows.write.option("parquet.block.size", row_group_bytes).option("parquet.block.size.row.check.min", 16).option("parquet.page.size.row.check.min", 16).parquet(f"{folder}/data")
    files = spark.read.parquet(f"{folder}/data").select(F.col("_metadata.file_path").alias("file")).distinct()
    files.mapInArrow(_footers, _INDEX).write.parquet(f"{folder}/index")


@dataclass
class Groups(InputPartition):
    """Row groups of one file."""

    file: str
    row_groups: list[int]
    bytes: int


class BlockReader(DataSourceReader):
    """slices: (stream, start, end), or none for all; each row group that holds a part of one is read once."""

    def __init__(self, folder: str, slices: list[tuple[int, int, int]] | None, columns: list[str]) -> None:
        self.folder, self.slices, self.columns = folder, slices, columns
        self.stream: int | None = None
        self.low, self.high = 0, _MOST  # samples that the query's own filters leave

    def wanted(self) -> pc.Expression:
        """Row groups of the index that can hold what is asked for."""
        def touched(stream: int | None, low: int, high: int) -> pc.Expression:
            inside = (pc.field("start") < high) & (pc.field("end") > low)
            return inside if stream is None else inside & (pc.field("first_stream") <= stream) & (pc.field("last_stream") >= stream)

        any_slice = pc.scalar(self.slices is None)
        for s in self.slices or []:
            any_slice = any_slice | touched(*s)
        return any_slice & touched(self.stream, self.low, self.high)

    def partitions(self) -> list[Groups]:
        system, path = _opened(f"{self.folder}/index")
        rows = ds.dataset(path, filesystem=system, format="parquet").to_table(filter=self.wanted()).sort_by([("file", "ascending"), ("row_group", "ascending")]).to_pylist()
        out: list[Groups] = []
        for r in rows:
            if out and out[-1].file == r["file"] and out[-1].bytes + r["bytes"] <= 64 << 20:
                out[-1].row_groups.append(r["row_group"])
                out[-1].bytes += r["bytes"]
            else:
                out.append(Groups(r["file"], [r["row_group"]], r["bytes"]))
        return out

    def _rows(self) -> pc.Expression:
        keep = pc.scalar(self.slices is None)
        for stream, low, high in self.slices or []:
            keep = keep | ((pc.field("stream") == stream) & (pc.field("start") < high) & (pc.field("end") > low))
        return keep

    def read(self, partition: Groups | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        system, path = _opened(partition.file)
        with system.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            for group in partition.row_groups:
                table = file.read_row_group(group, columns=self.columns).filter(self._rows())
                yield from table.select(self.columns).to_batches(max_chunksize=4096)


class PushedBlockReader(BlockReader):
    """The reader that also takes what a query's filters say of stream, start and end; Spark holds the rows against them again."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("stream",):
                self.stream = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("start",):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("end",):
                self.low = max(self.low, f.value - isinstance(f, GreaterThanOrEqual))
        return filters


class SampleBlocks(DataSource):
    """Options: path; slices (JSON: lists of stream, start, end); pushed (true where the session pushes filters to Python sources).  A schema must be given: stream,
    start, end and the receivers to read."""

    @classmethod
    def name(cls) -> str:
        return "sample_blocks"

    def reader(self, schema: StructType) -> BlockReader:
        told = self.options.get("slices")
        kind = PushedBlockReader if self.options.get("pushed") == "true" else BlockReader
        return kind(self.options["path"], None if told is None else [tuple(s) for s in json.loads(told)], schema.names)


def _source(spark: SparkSession, folder: str, receivers: list[str], kind: str, slices: list[tuple[int, int, int]] | None) -> DataFrame:
    spark.dataSource.register(SampleBlocks)
    arrays = ", ".join(f"`{c}` array<{kind}>" for c in receivers)
    read = spark.read.format("sample_blocks").schema(f"stream long, start long, end long, {arrays}")
    if slices is not None:
        read = read.option("slices", json.dumps(slices))
    return read.option("pushed", str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()).load(folder)


def read_blocks(spark: SparkSession, folder: str, receivers: list[str], kind: str = "bigint") -> DataFrame:
    """All blocks: stream, start, end and the receivers' arrays."""
    return _source(spark, folder, receivers, kind, None)


def read_slices(spark: SparkSession, folder: str, slices: list[tuple[int, int, int]], receivers: list[str], kind: str = "bigint") -> DataFrame:
    """Samples of slices (stream, start, count): stream, slice (its place in the list), start, and the receivers' arrays cut at the slice's ends, a row for
    each block that a slice touches; what lies beyond a stream's end isn't there."""
    if any(count < 0 or start < 0 for _, start, count in slices):
        raise ValueError("a slice begins at 0 or later and has no negative length")
    ends = [(stream, start, start + count) for stream, start, count in slices if count]
    rows = _source(spark, folder, receivers, kind, ends)
    if not ends:
        return rows.where("false").select("stream", F.lit(0).alias("slice"), "start", *receivers)
    part = lambda i, lo, hi: F.struct(F.lit(i).alias("slice"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
    touched = [F.when((F.col("stream") == s) & (F.col("start") < s0 + n) & (F.col("end") > s0), part(i, s0, s0 + n)) for i, (s, s0, n) in enumerate(slices)]
    of = F.explode(F.array_compact(F.array(*touched))).alias("x")
    rows = rows.select("stream", "start", "end", *receivers, of).select("*", "x.*")
    first = F.greatest(F.col("start"), F.col("lo"))
    size = (F.least(F.col("end"), F.col("hi")) - first).cast("int")
    return rows.select("stream", "slice", first.alias("start"), *[F.slice(c, (first - F.col("start") + 1).cast("int"), size).alias(c) for c in receivers])


def read_slice(spark: SparkSession, folder: str, stream: int, start: int, count: int, receivers: list[str], kind: str = "bigint") -> DataFrame:
    """Samples [start, start + count) of a stream: start and the receivers' arrays, a row for each block."""
    return read_slices(spark, folder, [(stream, start, count)], receivers, kind).drop("slice", "stream")
