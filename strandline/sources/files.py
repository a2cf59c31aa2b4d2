"""Byte ranges of text files, indexed by line counts in parallel, so that records get their ordinals without a shuffle."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession

BLOCK = 32 << 20
_STEP = 1 << 20


def opened(path: str):
    """A random-access file, from any store that Arrow reads by URI or from a local path."""
    if "://" in path:
        store, inner = pafs.FileSystem.from_uri(path)
    else:
        store, inner = pafs.LocalFileSystem(), path
    return store.open_input_file(inner)


def is_gzip(path: str) -> bool:
    if path.lower().endswith(".gz"):
        return True
    with opened(path) as f:
        return f.read(2) == b"\x1f\x8b"


@dataclass(frozen=True)
class Block:
    """Bytes [start, end) of a file, and how many marks (newlines, or headers) come before it."""

    path: str
    start: int
    end: int
    before: int
    gz: bool = False


def _count(path: str, start: int, end: int, headers: bool, gz: bool) -> tuple[int, bool]:
    """(marks in the range, whether the range's last byte is a newline); a header is a `>` at a line's start."""
    marks, last = 0, True
    if gz:
        with opened(path) as raw, gzip.open(raw) as f:
            while data := f.read(_STEP):
                marks += (data.count(b"\n>") + (last and data[:1] == b">")) if headers else data.count(b"\n")
                last = data[-1:] == b"\n"
        return marks, last
    with opened(path) as f:
        if start:
            f.seek(start - 1)
            last = f.read(1) == b"\n"
        f.seek(start)
        while start < end and (data := f.read(min(_STEP, end - start))):
            marks += (data.count(b"\n>") + (last and data[:1] == b">")) if headers else data.count(b"\n")
            last = data[-1:] == b"\n"
            start += len(data)
    return marks, last


@dataclass(frozen=True)
class Index:
    blocks: list[Block]
    marks: int
    ends_in_newline: bool

    @property
    def lines(self) -> int:
        return self.marks + (not self.ends_in_newline)


def tasks(spark: SparkSession, blocks: int, size: int) -> int:
    """How many tasks read so many blocks of so many bytes in all: small blocks are read several by one task."""
    return max(1, min(blocks, max(spark.sparkContext.defaultParallelism, -(-size // BLOCK))))


def index(spark: SparkSession | None, path: str, block: int = BLOCK, headers: bool = False) -> Index:
    """The file's blocks with their counts; counted by tasks in parallel, or here if there is no session. The driver holds a row a block."""
    gz = is_gzip(path)
    with opened(path) as f:
        size = f.size()
    starts = [0] if gz else list(range(0, size, block)) or [0]
    ends = [size] if gz else [*starts[1:], size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(s, *_count(path, s, e, headers, gz)) for s, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["start", "marks", "last"])

    if spark is None or len(starts) == 1:
        with ThreadPoolExecutor(8) as pool:  # counting lets go of the interpreter while it reads
            counts = dict(zip(starts, pool.map(lambda x: _count(path, *x, headers, gz), zip(starts, ends, strict=True)), strict=True))
    else:
        ranges = spark.createDataFrame(list(zip(starts, ends, strict=True)), "start long, finish long").repartition(tasks(spark, len(starts), size))
        counts = {r["start"]: (r["marks"], r["last"]) for r in ranges.mapInArrow(run, "start long, marks long, last boolean").collect()}
    marks = np.array([counts[s][0] for s in starts])
    before = np.cumsum(marks) - marks
    return Index([Block(path, s, e, int(n), gz) for s, e, n in zip(starts, ends, before, strict=True)], int(marks.sum()), counts[starts[-1]][1] or size == 0)


def lines_from(block: Block, start: int, chunk: int = _STEP) -> Iterator[tuple[int, bytes]]:
    """(byte offset, line without its newline) of the lines that begin at or after byte `start`, to the file's end."""
    if block.gz:
        with opened(block.path) as raw, gzip.open(raw) as f:
            at = 0
            for line in io.BufferedReader(f, chunk):
                yield at, line[:-1] if line.endswith(b"\n") else line
                at += len(line)
        return
    with opened(block.path) as f:
        aligned = start == 0
        if not aligned:
            f.seek(start - 1)
            aligned = f.read(1) == b"\n"
        f.seek(start)
        rest, at, read, beyond = b"", start, start, 1 << 12
        while data := f.read(min(chunk, block.end - read) if read < block.end else beyond):
            if read >= block.end:  # the rest of a record that crosses the end
                beyond = min(chunk, 2 * beyond)
            read += len(data)
            *full, tail = (rest + data).split(b"\n")
            for line in full:
                if aligned:
                    yield at, line
                aligned = True
                at += len(line) + 1
            rest = tail
        if rest and aligned:
            yield at, rest
