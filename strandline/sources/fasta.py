"""FASTA source: multi-line records, plain or gzip, with ordinals from header counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import fastq, files

SCHEMA = "idx long, name string, seq string"
ARROW = pa.schema([("idx", pa.int64()), ("name", pa.string()), ("seq", pa.string())])


def records(block: files.Block) -> Iterator[tuple[int, str, str]]:
    """(ordinal, name, upper-case sequence) of the records whose header begins in the block; those without a name are dropped."""
    idx, name, parts = block.before, None, []
    for at, line in files.lines_from(block, block.start):
        line = line.rstrip(b"\r")
        if line.startswith(b">"):
            if name:
                yield idx - 1, name, b"".join(parts).upper().decode("latin-1")
            name, parts = None, []
            if not block.gz and at >= block.end:
                return
            name, idx = line[1:].strip().decode(errors="replace"), idx + 1
        elif name:
            parts.append(line.strip())
    if name:
        yield idx - 1, name, b"".join(parts).upper().decode("latin-1")


def read_fasta(spark: SparkSession, path: str | list[str], block: int = files.BLOCK) -> DataFrame:
    """idx, name and seq of one or several files; lines before a file's first header are ignored. A task reads neighbouring blocks, and a record that crosses a block's end."""
    blocks, bases, base = [], [], 0
    for one in [path] if isinstance(path, str) else path:
        found = files.index(spark, one, block, headers=True)
        blocks += found.blocks
        bases += [base] * len(found.blocks)
        base += found.marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from fastq._batches(((i + row["base"], *r) for i, *r in records(fastq._block(row))), ARROW)

    return fastq._blocks_frame(spark, blocks, bases).mapInArrow(run, SCHEMA)
