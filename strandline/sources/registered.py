"""The sources as formats for spark.read.format(...) and CREATE TABLE ... USING."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import fasta, fastq, files


@dataclass
class _Part(InputPartition):
    block: files.Block
    mate: files.Block | None = None


class _Reader(DataSourceReader):
    """Options: path (or path and path2 for pairs), mode, offset, block (bytes)."""

    def __init__(self, kind: str, options: dict[str, str]):
        self.kind, self.path, self.path2 = kind, options.get("path"), options.get("path2")
        self.mode, self.offset, self.block = options.get("mode", "strict"), int(options.get("offset", 33)), int(options.get("block", files.BLOCK))
        if not self.path or (kind == "fastq_pairs" and not self.path2):
            raise ValueError("give the option path, and path2 for pairs")

    def partitions(self) -> list[_Part]:
        one = files.index(None, self.path, self.block, headers=self.kind == "fasta")
        if self.kind != "fastq_pairs":
            return [_Part(b) for b in one.blocks]
        two = files.index(None, self.path2, self.block)
        return [_Part(b, m) for b, m in zip(one.blocks, fastq.mates(one, two), strict=True)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if self.kind == "fasta":
            return fastq._batches(fasta.records(part.block), fasta.ARROW)
        if self.kind == "fastq_pairs":
            return fastq.paired_batches(part.block, part.mate, self.offset)
        return fastq.strict_batches(part.block, self.offset) if self.mode == "strict" else fastq._batches(fastq.records(part.block, self.mode, self.offset), fastq.READ_ARROW)


def _format(kind: str, columns: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return _Reader(kind, dict(self.options))

    return Source


def register(spark: SparkSession) -> None:
    for kind, columns in (("fastq", fastq.READ_SCHEMA), ("fastq_pairs", fastq.PAIR_SCHEMA), ("fasta", fasta.SCHEMA)):
        spark.dataSource.register(_format(kind, columns))
