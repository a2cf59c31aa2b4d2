"""FASTQ sources: single files, pairs of files, and text already in columns.

Modes: `strict` (checked four-line records, letters made canonical), `lenient` (four lines, upper-cased, nothing checked, a
short last record filled with empty lines). Records carry their ordinal `idx`, from line counts by block; `@` is a legal
quality character, so record starts are found by counting.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import MergeParams
from . import files

READ_SCHEMA = "idx long, tag string, seq string, qual string"
PAIR_SCHEMA = "idx long, tag1 string, seq1 string, qual1 string, tag2 string, seq2 string, qual2 string"
_CANON = bytes(c if c in b"ACGT" else c - 32 if c in b"acgt" else ord("N") for c in range(256))
_BATCH = 4096
_PIECE = 1 << 20  # bytes of a block that are held at once


#: What is said of two files that are no pair.
UNEQUAL = "the files of a pair hold different numbers of reads"


class FastqError(ValueError):
    pass


def checked(lines: list[bytes], idx: int, offset: int) -> tuple[str, str, str]:
    """A strict record of four lines; letters canonical, qualities as they are written."""
    if len(lines) < 4:
        raise FastqError(f"record {idx} ends early")
    tag, seq, plus, qual = (x.rstrip(b"\r\n") for x in lines)
    if not tag.startswith(b"@"):
        raise FastqError(f"record {idx}: the tag does not start with @")
    if not plus.startswith(b"+"):
        raise FastqError(f"record {idx}: the separator does not start with +")
    if len(seq) != len(qual):
        raise FastqError(f"record {idx}: sequence and quality differ in length")
    if qual and min(qual) < offset:
        raise FastqError(f"record {idx}: quality below the offset {offset}")
    return tag.decode(), seq.translate(_CANON).decode(), qual.decode("latin-1")


def lenient(lines: list[bytes]) -> tuple[str, str, str]:
    tag, seq, _, qual = (x.rstrip(b"\r\n") for x in [*lines, b"", b"", b""][:4])
    return tag.decode(errors="replace"), seq.upper().decode("latin-1"), qual.decode("latin-1")


def records(block: files.Block, mode: str = "strict", offset: int = 33) -> Iterator[tuple[int, str, str, str]]:
    """The records whose first line begins in the block."""
    lines = files.lines_from(block, block.start)
    number = None
    while True:
        group = []
        for at, line in lines:
            if number is None:  # a block that begins inside a line: that line is the one before
                number = 0 if block.gz or at == 0 else block.before + (at != block.start)
            if not group and number % 4:
                number += 1
                continue
            if not group and not block.gz and at >= block.end:
                return
            group.append(line)
            number += 1
            if len(group) == 4:
                break
        if not group:
            return
        idx = (number - len(group)) // 4
        yield (idx, *(checked(group, idx, offset) if mode == "strict" else lenient(group)))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while chunk := list(islice(rows, _BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk, strict=True), schema.types, strict=True)], schema=schema)


READ_ARROW = pa.schema([("idx", pa.int64()), *((n, pa.string()) for n in ("tag", "seq", "qual"))])
PAIR_ARROW = pa.schema([("idx", pa.int64()), *((n, pa.string()) for n in ("tag1", "seq1", "qual1", "tag2", "seq2", "qual2"))])
_CANON_BYTES = np.frombuffer(_CANON, dtype=np.uint8)


def _fields(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges of a buffer as strings: of an array of the ranges and the gaps between them every other one."""
    offsets = np.empty(2 * len(starts), dtype=np.int32)
    offsets[::2], offsets[1::2] = starts, ends
    whole = pa.StringArray.from_buffers(max(0, len(offsets) - 1), pa.py_buffer(offsets), pa.py_buffer(buf))
    return whole.take(pa.array(np.arange(0, len(offsets), 2)))


def _arrays(block: files.Block, offset: int, first: int | None = None, count: int | None = None) -> tuple[int, list[pa.Array]] | None:
    """(ordinal of the first, tags, letters and qualities) of the strict records that begin in a plain block, or of `count` from `first` on.

    Lines are found by one search for newlines, and the strings are cut from the buffer. None if anything is not plain ASCII or
    not a valid record: then the records are read one by one, which says what is wrong.
    """
    with files.opened(block.path) as f:
        f.seek(max(0, block.start - 1))
        aligned = block.start == 0 or f.read(1) == b"\n"
        f.seek(block.start)
        data = [f.read(block.end - block.start if first is None else min(block.end - block.start, _PIECE))]
        number = 0 if block.start == 0 else block.before + (not aligned)
        lines = data[0].count(b"\n") - (not aligned)
        if first is None:
            begun = lines + (not data[0].endswith(b"\n")) if data[0] else 0  # lines that begin in the block
            skip = -number % 4
            count = max(0, -(-(begun - skip) // 4))
        else:
            skip = 4 * first - number
        beyond = 1 << 12
        while lines < skip + 4 * count and (more := f.read(beyond)):
            data.append(more)
            lines += more.count(b"\n")
            beyond = min(_PIECE, 2 * beyond)
    if not count:
        return (number + skip) // 4, [pa.array([], pa.string())] * 3
    text = b"".join(data)
    buf = np.frombuffer(text if text.endswith(b"\n") else text + b"\n", dtype=np.uint8)
    at = np.flatnonzero(buf == 10)
    starts, ends = (np.concatenate(([0], at[:-1] + 1)), at) if aligned else (at[:-1] + 1, at[1:])
    starts, ends = (x[skip : skip + 4 * count] for x in (starts, ends))
    if len(ends) < 4 * count or len(buf) >= 2**31 or (buf >= 128).any():
        return None
    ends = ends - ((ends > starts) & (buf[ends - 1] == 13))
    (t, s, p, q), (t2, s2, p2, q2) = ([x[k::4] for k in range(4)] for x in (starts, ends))
    low = np.concatenate(([0], np.cumsum(buf < offset)))
    valid = (buf[t] == 64) & (t2 > t) & (buf[p] == 43) & (p2 > p) & (s2 - s == q2 - q) & (low[q2] == low[q])
    if not valid.all() or ((ends > starts) & (buf[ends - 1] == 13)).any():
        return None
    return (number + skip) // 4, [_fields(buf, t, t2), _fields(_CANON_BYTES[buf], s, s2), _fields(buf, q, q2)]


def _sliced(columns: list[pa.Array], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), _BATCH):
        yield pa.RecordBatch.from_arrays([c.slice(at, _BATCH) for c in columns], schema=schema)


def _pieces(block: files.Block) -> Iterator[files.Block]:
    """A plain block as blocks of at most _PIECE bytes, in order."""
    if block.end - block.start <= _PIECE:
        yield block
        return
    start, before = block.start, block.before
    with files.opened(block.path) as f:
        f.seek(start)
        while start < block.end and (data := f.read(min(_PIECE, block.end - start))):
            yield files.Block(block.path, start, start + len(data), before)
            start, before = start + len(data), before + data.count(b"\n")


def strict_batches(block: files.Block, offset: int, base: int = 0) -> Iterator[pa.RecordBatch]:
    for piece in [block] if block.gz else _pieces(block):
        found = None if block.gz else _arrays(piece, offset)
        if found is None:
            yield from _batches(((r[0] + base, *r[1:]) for r in records(piece, "strict", offset)), READ_ARROW)
        else:
            idx, columns = found
            yield from _sliced([pa.array(np.arange(idx + base, idx + base + len(columns[0]))), *columns], READ_ARROW)


def _joined(block: files.Block, mate: files.Block, offset: int) -> Iterator[tuple]:
    other = None
    for r in records(block, "strict", offset):
        other = other or _from_record(mate, r[0], offset)
        found = next(other, None)
        if found is None or found[0] != r[0]:
            raise FastqError(UNEQUAL)
        yield (*r, *found[1:])


def paired_batches(block: files.Block, mate: files.Block, offset: int) -> Iterator[pa.RecordBatch]:
    """The records of a block beside those of the same ordinals that the other file has from `mate` on; a piece of each is held."""
    if block.gz or mate.gz:
        yield from _batches(_joined(block, mate, offset), PAIR_ARROW)
        return
    others, ahead, far = _pieces(replace(mate, end=1 << 62)), None, mate.end - mate.start > _PIECE
    for n, piece in enumerate(_pieces(block)):
        first = 4 * -(-piece.before // 4)  # the first line of the piece's first record, or an earlier record's
        while (n or far) and (ahead := ahead or next(others, None)) and ahead.before + (ahead.start > 0) <= first:
            mate, ahead = ahead, None
        own = _arrays(piece, offset)
        other = None if own is None else _arrays(mate, offset, own[0], len(own[1][0]))
        if other is None:
            yield from _batches(_joined(piece, mate, offset), PAIR_ARROW)
        else:
            idx, columns = own
            yield from _sliced([pa.array(np.arange(idx, idx + len(columns[0]))), *columns, *other[1]], PAIR_ARROW)


_BLOCK = "path string, start long, finish long, before long, gz boolean"


def _block(row: dict, prefix: str = "") -> files.Block:
    return files.Block(*(row[prefix + c] for c in ("path", "start", "finish", "before", "gz")))


def _blocks_frame(spark: SparkSession, blocks: list[files.Block], bases: list[int] | None = None) -> DataFrame:
    rows = [(i, b.path, b.start, b.end, b.before, b.gz, base) for i, (b, base) in enumerate(zip(blocks, bases or [0] * len(blocks), strict=True))]
    return _dealt(spark, spark.createDataFrame(rows, f"i long, {_BLOCK}, base long"), blocks)


def _dealt(spark: SparkSession, frame: DataFrame, blocks: list[files.Block]) -> DataFrame:
    """Rows of blocks, neighbours in one task and in order."""
    return frame.repartitionByRange(files.tasks(spark, len(blocks), sum(b.end - b.start for b in blocks)), "i").sortWithinPartitions("i")


def read_fastq(spark: SparkSession, path: str | list[str], mode: str = "strict", offset: int = 33, block: int = files.BLOCK) -> DataFrame:
    """idx, tag, seq, qual of one or several FASTQ files, plain or gzip; a task reads neighbouring blocks, a piece at a time. idx goes on from file to file."""
    blocks, bases, base = [], [], 0
    for one in [path] if isinstance(path, str) else path:
        found = files.index(spark, one, block)
        blocks += found.blocks
        bases += [base] * len(found.blocks)
        base += -(-found.lines // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                if mode == "strict":
                    yield from strict_batches(_block(row), offset, row["base"])
                else:
                    yield from _batches(((r[0] + row["base"], *r[1:]) for r in records(_block(row), mode, offset)), READ_ARROW)

    return _blocks_frame(spark, blocks, bases).mapInArrow(run, READ_SCHEMA)


def mates(one: files.Index, two: files.Index) -> list[files.Block]:
    """For each block of a file the block of the other that its first record begins in, or one before it; both lists are in order."""
    if -(-one.lines // 4) != -(-two.lines // 4):
        raise FastqError(UNEQUAL)
    begins = [b.before + (b.start > 0) for b in two.blocks]
    firsts = [-(-b.before // 4) for b in one.blocks]  # a block may begin at a line's start
    return [two.blocks[max(0, bisect_right(begins, 4 * i) - 1)] for i in firsts]


def _from_record(block: files.Block, idx: int, offset: int) -> Iterator[tuple[int, str, str, str]]:
    whole = files.Block(block.path, block.start, 1 << 62, block.before, block.gz)
    return (r for r in records(whole, "strict", offset) if r[0] >= idx)


def read_pairs(spark: SparkSession, forward: str, reverse: str, offset: int = 33, block: int = files.BLOCK) -> DataFrame:
    """idx and both reads of each pair. A task reads its blocks of the first file and the same ordinals of the second; no shuffle.

    Files with different numbers of records are an error before any row is made.
    """
    MergeParams(phred_offset=offset)
    one, two = files.index(spark, forward, block), files.index(spark, reverse, block)
    rows = [(i, *x) for i, x in enumerate((a.path, a.start, a.end, a.before, a.gz, b.path, b.start, b.end, b.before, b.gz) for a, b in zip(one.blocks, mates(one, two), strict=True))]
    other = ", ".join(f"m_{c}" for c in _BLOCK.split(", "))
    frame = _dealt(spark, spark.createDataFrame(rows, f"i long, {_BLOCK}, {other}"), one.blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from paired_batches(_block(row), _block(row, "m_"), offset)

    return frame.mapInArrow(run, PAIR_SCHEMA)


def parse_text(text: str | None, offset: int = 33) -> list[tuple[str, str, str]]:
    """Strict records of a text; blank lines between records are skipped."""
    out, lines = [], iter((text or "").encode().split(b"\n"))
    for line in lines:
        if not line.strip(b"\r"):
            continue
        out.append(checked([line, *islice(lines, 3)], len(out), offset))
    return out


def parse_column(df: DataFrame, column: str = "text", offset: int = 33) -> DataFrame:
    """A row (pos, tag, seq, qual) for each record of FASTQ text in a column, beside the other columns."""
    rest = [c for c in df.columns if c != column]
    own = df.select(*rest, F.col(column).cast("string").alias(column))
    schema = T.StructType([*own.drop(column).schema.fields, *(T.StructField(n, T.IntegerType() if n == "pos" else T.StringType()) for n in ("pos", "tag", "seq", "qual"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, *r) for k, t in enumerate(b.column(len(rest)).to_pylist()) for i, r in enumerate(parse_text(t, offset))]
            at, *cols = list(zip(*rows, strict=True)) or [()] * 5
            take = pa.array(at, pa.int64())
            new = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.string()] * 3), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(rest))), *new], names=[*rest, "pos", "tag", "seq", "qual"])

    return own.mapInArrow(run, schema)
