"""Timelines as zstd-compressed JSON lines: packed payloads and files, read with an explicit schema."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_AT_ONCE = 4096


def packed(rows: DataFrame, order: list[str], chunk: str) -> DataFrame:
    """rows as payloads: for each chunk (an expression) the JSON lines of its rows in order, compressed; chunk, lines and payload.

    A chunk is one row of the result, as it is one file of a recording, so it must be an expression that bounds it.
    """
    lines = rows.select(F.expr(chunk).alias("chunk"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.to_json(F.struct(*rows.columns)).alias("line"))
    listed = lines.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct(*[f"_o{i}" for i in range(len(order))], "line"))).alias("x")).select("chunk", F.col("x.line").alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [zstandard.ZstdCompressor(level=3).compress(("\n".join(x) + "\n").encode()) for x in batch.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array([len(x) for x in batch.column("lines").to_pylist()], pa.int64()), pa.array(found, pa.binary())], ["chunk", "lines", "payload"])

    return listed.mapInArrow(run, f"chunk {listed.schema['chunk'].dataType.simpleString()}, lines long, payload binary")


def unpacked(payloads: DataFrame, name: str, schema: str) -> DataFrame:
    """The rows of compressed payloads (columns: name, payload), with the payload's name and the line's number from 0.  Payloads are read as
    streams, a few thousand lines at a time; a line that isn't of the schema gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, payload in zip(batch.column(name).to_pylist(), batch.column("payload"), strict=True):
                reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(payload.as_buffer()), read_across_frames=True), encoding="utf-8")
                at, held = 0, []
                for line in reader:
                    held.append(line.rstrip("\n"))
                    if len(held) == LINES_AT_ONCE:
                        yield _lines(own, at, held, batch.schema.field(name).type)
                        at, held = at + len(held), []
                yield _lines(own, at, held, batch.schema.field(name).type)

    def _lines(own, at: int, held: list[str], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([own] * len(held), kind), pa.array(range(at, at + len(held)), pa.int64()), pa.array(held, pa.string())], [name, "line_no", "line"])

    kind = payloads.schema[name].dataType.simpleString()
    lines = payloads.select(name, "payload").mapInArrow(run, f"{name} {kind}, line_no long, line string")
    return lines.select(name, "line_no", F.from_json("line", schema).alias("x")).select(name, "line_no", "x.*")


def read_timeline(spark: SparkSession, folder: str, schema: str, pattern: str = "*.jsonl.zst") -> DataFrame:
    """The rows of a folder's compressed JSON-lines files, with the file's path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return unpacked(files.select("path", F.col("content").alias("payload")), "path", schema)
