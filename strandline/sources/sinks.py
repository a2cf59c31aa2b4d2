"""Sinks: FASTQ and TSV files in record order, published under their own names only when they are complete."""

from __future__ import annotations

import shutil
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fastq_line(tag: str = "tag", seq: str = "seq", qual: str = "qual") -> Column:
    """The four lines of a record as one text (the writer adds the last newline)."""
    return F.concat_ws("\n", F.col(tag), F.col(seq), F.lit("+"), F.col(qual))


def write_lines(df: DataFrame, line: Column, path: str | Path, order: list | None = None, before: str = "", after: str = "") -> Path:
    """One text file of a line a row, sorted by `order`: sorted part files, joined in partition order, then renamed.

    Executors and driver must share the folder of `path`, as for any file output that ends as a single file.
    """
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    parts = path.parent / f".{path.name}-{uuid.uuid4().hex}"
    rows = df.orderBy(*order) if order else df
    rows.select(line.alias("value")).write.text(parts.as_uri() if parts.is_absolute() else str(parts))
    whole = parts / "whole"
    with whole.open("wb") as out:
        out.write(before.encode())
        for p in sorted(parts.glob("part-*")):
            with p.open("rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
        out.write(after.encode())
    whole.replace(path)
    shutil.rmtree(parts)
    return path


def _whole(reads: DataFrame) -> DataFrame:
    """The rows without a null in tag, seq and qual.

    The test reads a column that is not deterministic, so the optimizer does not move it below what makes the reads, where it would
    hold a copy of their expressions for each use, nor below an exchange that orders them, where each row would be made once more.
    """
    whole = F.col("tag").isNotNull() & F.col("seq").isNotNull() & F.col("qual").isNotNull()
    return reads.withColumn("__row", F.monotonically_increasing_id()).where(whole & (F.col("__row") >= 0)).drop("__row")


def write_fastq(reads: DataFrame, path: str | Path, order: list | None = None) -> Path:
    """(tag, seq, qual) as FASTQ; rows with a null in them are left out. Sorted by idx if it is there; an empty order takes the rows as they come."""
    if order is None and "idx" in reads.columns:
        order = ["idx"]
    return write_lines(_whole(reads), fastq_line(), path, order)


def write_shards(reads: DataFrame, path: str, order: list | None = None, mode: str = "error") -> None:
    """(tag, seq, qual) as FASTQ part files of a folder in any store that Spark writes to, in order from part to part; nothing passes the driver."""
    rows = _whole(reads)
    order = order or (["idx"] if "idx" in reads.columns else None)
    (rows.orderBy(*order) if order else rows).select(fastq_line().alias("value")).write.mode(mode).text(path)


# The columns of the published files.
MATCH_COLUMNS = ("seq_name", "start", "end", "canonical", "length", "strand", "num_units", "motif")
STATS_COLUMNS = ("class", "strand", "motif_len", "instances", "reads", "covered_bases", "instances_per_million_reads", "bases_per_million_bases")


def write_matches(matches: DataFrame, totals: DataFrame, source: str, path: str | Path) -> Path:
    """The matches as TSV without a header, then four comment lines with the totals of `totals` (one row)."""
    t = totals.first()
    footer = f"# file: {source}\n# total_sequences: {t['total_sequences']}\n# total_bases: {t['total_bases']}\n# gc_pct: {t['gc_pct']:.2f}\n"
    return write_lines(matches, F.concat_ws("\t", *[F.col(c).cast("string") for c in MATCH_COLUMNS]), path, ["idx", "start", F.desc("length"), "canonical"], after=footer)


def write_class_stats(stats: DataFrame, totals: DataFrame, path: str | Path) -> Path:
    """Class statistics as TSV with a header, rates with four decimals, and two comment lines with the totals."""
    t = totals.first()
    rates = ("instances_per_million_reads", "bases_per_million_bases")
    line = F.concat_ws("\t", *[F.format_string("%.4f", F.col(c)) if c in rates else F.col(c).cast("string") for c in STATS_COLUMNS])
    footer = f"# total_reads\t{t['total_reads']}\n# total_bases\t{t['total_bases']}\n"
    return write_lines(stats, line, path, ["motif_len", "class", "strand"], "\t".join(STATS_COLUMNS) + "\n", footer)
