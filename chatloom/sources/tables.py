"""Spark data sources in Python: a matrix file with its id index, read by ranges of rows, and an append-only trace.

Files are opened through Arrow's filesystems, by path or URI, so executors and driver must see the same store.

    spark.dataSource.register(MatrixSource); spark.read.format("matrix").load("…/embeddings.npy")
    spark.dataSource.register(TraceSource); rows.write.format("trace").mode("append").save("…/trace")
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from chatloom.functions.text import SECRET

#: Rows of a matrix that a task reads, and bytes that it holds at once.
RANGE_ROWS, HELD_BYTES = 1 << 18, 1 << 23


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _npy_header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and where the numbers begin."""
    version = np.lib.format.read_magic(f)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if by_column or len(shape) != 2:
        raise ValueError(f"a matrix in row order is wanted, not shape {shape}{' by column' * by_column}")
    return shape, kind, f.tell()


@dataclass
class Rows(InputPartition):
    start: int
    stop: int


class MatrixReader(DataSourceReader):
    """Each partition seeks to its own rows of the matrix; ids come from a JSON list beside it."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.index = options.get("index", self.path.removesuffix(".npy") + "_index.json")
        self.rows = int(options.get("rows", RANGE_ROWS))

    def _ids(self) -> list:
        files, path = opened(self.index)
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def partitions(self) -> list[Rows]:
        files, path = opened(self.path)
        with files.open_input_file(path) as f:
            (n, width), kind, start = _npy_header(f)
            size = f.size()
        ids = self._ids()
        if size != start + n * width * kind.itemsize:
            raise ValueError(f"{self.path} holds {size - start} bytes of numbers, {n} x {width} need {n * width * kind.itemsize}")
        if len(ids) != n or len(set(ids)) != n:
            raise ValueError(f"{len(ids)} ids, {len(set(ids))} of them different, for {n} rows of {self.path}")
        return [Rows(k, min(n, k + self.rows)) for k in range(0, n, self.rows)]

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of an empty matrix
            return
        files, path = opened(self.path)
        ids = self._ids()[partition.start : partition.stop]
        with files.open_input_file(path) as f:
            (_, width), kind, start = _npy_header(f)
            step = max(1, HELD_BYTES // (width * kind.itemsize))
            for at in range(partition.start, partition.stop, step):
                n = min(step, partition.stop - at)
                f.seek(start + at * width * kind.itemsize)
                m = np.frombuffer(f.read(n * width * kind.itemsize), kind).reshape(n, width).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(m.ravel()))
                own = ids[at - partition.start : at - partition.start + n]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.array(list(map(str, own))), vectors], names=["place", "id", "vector"])


class MatrixSource(DataSource):
    """Options: path, index (a JSON list of ids; by default <path>_index.json), rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "place long, id string, vector array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)


# --- trace ---------------------------------------------------------------------------------------------

TRACE = "pos long, query_id string, event_id string, record_type string, payload string"


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    first: int
    last: int


def commits(path: str) -> list[dict]:
    """The commits of a trace in order; files without one are not part of it."""
    files, at = opened(path)
    found = files.get_file_info(fs.FileSelector(f"{at}/_commits", allow_not_found=True))
    out = []
    for info in sorted((x for x in found if x.base_name.endswith(".json")), key=lambda x: x.base_name):
        with files.open_input_stream(info.path) as f:
            out.append(json.loads(f.read()))
    return out


class TraceWriter(DataSourceWriter):
    """Tasks write files of their own; the commit makes them visible at once, after it has seen that the trace goes on where it ended.

    A row with a secret, without an id, or out of place ends the write and nothing of it is ever read.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, rows: Iterator) -> Written:
        import re

        secret, own, lines, places = re.compile(SECRET), uuid.uuid4().hex, [], []
        for row in rows:
            if row["pos"] is None or not row["event_id"] or not row["query_id"]:
                raise ValueError(f"a trace record needs a place, an event and a query: {row}")
            if secret.search(row["payload"] or ""):
                raise ValueError(f"record {row['event_id']} holds a secret")
            places.append(row["pos"])
            lines.append(json.dumps(row.asDict(), sort_keys=True, ensure_ascii=False))
        if len(set(places)) != len(places):
            raise ValueError("a place is taken twice")
        if lines:
            files, path = opened(self.path)
            files.create_dir(f"{path}/records", recursive=True)
            with files.open_output_stream(f"{path}/records/{own}.jsonl") as f:
                f.write(("\n".join(lines) + "\n").encode())
        return Written(own, len(lines), min(places, default=0), max(places, default=-1))

    def commit(self, messages: list[Written]) -> None:
        done = commits(self.path)
        end = done[-1]["last"] if done else -1
        new = [m for m in messages if m and m.rows]
        if not new:
            return
        first, last, n = min(m.first for m in new), max(m.last for m in new), sum(m.rows for m in new)
        if first != end + 1 or last - first + 1 != n:
            self.abort(messages)
            raise ValueError(f"{n} records from place {first} to {last} do not follow place {end}")
        files, path = opened(self.path)
        files.create_dir(f"{path}/_commits", recursive=True)
        name = f"{path}/_commits/{len(done):012d}"
        with files.open_output_stream(f"{name}.tmp") as f:
            f.write(json.dumps({"files": [m.file for m in new], "first": first, "last": last}).encode())
        files.move(f"{name}.tmp", f"{name}.json")

    def abort(self, messages: list[Written]) -> None:
        files, path = opened(self.path)
        for m in messages:
            if m and m.rows:
                files.delete_file(f"{path}/records/{m.file}.jsonl")


class TraceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for c in commits(self.path) for name in c["files"]]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # of an empty trace
            return
        files, path = opened(self.path)
        with files.open_input_stream(f"{path}/records/{partition.value}.jsonl") as f:
            for line in f.read().decode().splitlines():
                row = json.loads(line)
                yield tuple(row.get(c.split()[0]) for c in TRACE.split(", "))


class TraceSource(DataSource):
    """Option: path. Appends only; each write is one commit."""

    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> str:
        return TRACE

    def reader(self, schema) -> TraceReader:
        return TraceReader(self.options)

    def writer(self, schema, overwrite: bool) -> TraceWriter:
        if overwrite:
            raise ValueError("a trace is appended to, never overwritten")
        return TraceWriter(self.options)
