"""Operator S: microsatellites as maximal runs, found a batch of sequences at a time.

For a period p a run is a stretch in which every base equals the one p places on. All sequences of a batch lie in one buffer,
apart from each other, so one comparison of the buffer with itself finds the runs of a period for all of them; the work is
linear in the bases. Where keys of two classes can clash (short minimum lengths) or motifs are given, the dictionary scan with
its first-wins rule is used instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..params import SsrParams
from . import motifs

_BASE = np.zeros(256, dtype=bool)
_BASE[list(b"ACGT")] = True
COLUMNS = "idx long, seq_name string, start long, end long, canonical string, length long, strand string, num_units long, motif string"


def runs(seqs: list[bytes], p: SsrParams) -> list[tuple[int, int, int, str, int, str, int, str]]:
    """(sequence, start, end, class, length, strand, units, motif) of the maximal runs, unsorted."""
    gap = b"\0" * p.max_motif
    text = gap.join(seqs) + gap
    buf = np.frombuffer(text, dtype=np.uint8)
    begin = np.cumsum([0, *(len(s) + p.max_motif for s in seqs)])[:-1]
    base = _BASE[buf]
    out = []
    for size in range(p.min_motif, p.max_motif + 1):
        same = (buf[:-size] == buf[size:]) & base[:-size]
        # places where `need` marks follow on each other, by doubling; random bases leave next to none
        need, have = max(1, p.min_length - size), 1
        while have < need:
            step = min(have, need - have)
            same = same[:-step] & same[step:]
            have += step
        at = np.flatnonzero(same)
        if not len(at):
            continue
        apart = np.flatnonzero(np.diff(at) > 1)
        start, end = at[np.append(0, apart + 1)], at[np.append(apart, len(at) - 1)] + need + size
        owner = np.searchsorted(begin, start, side="right") - 1
        for s, e, k, b in zip(start.tolist(), end.tolist(), owner.tolist(), begin[owner].tolist(), strict=True):
            motif = text[s : s + size].decode()
            units = (e - s) // size
            if base[s : s + size].all() and motifs.atomic(motif) and units >= p.min_units.get(size, 1):
                label, strand = motifs.classified(motif)
                out.append((k, s - b, e - b, label, e - s, strand, units, motif))
    return out


def scanned(seq: str, p: SsrParams) -> list[tuple[int, int, str, int, str, int, str]]:
    """(start, end, class, length, strand, units, motif) by the dictionary: at every place the key, extended to the right as long as it repeats; of a class, a match inside the reach of earlier ones is dropped."""
    keys, n = motifs.dictionary(p), p.min_length
    reach: dict[str, int] = {}
    out = []
    for i in range(len(seq) - n + 1):
        found = keys.get(seq[i : i + n])
        if not found:
            continue
        label, size, strand = found
        end = i + n
        while end < len(seq) and seq[end] == seq[end - size]:
            end += 1
        if end > reach.get(label, 0):
            reach[label] = end
            if (end - i) // size >= p.min_units.get(size, 1):
                out.append((i, end, label, end - i, strand, (end - i) // size, seq[i : i + size]))
    return out


def find_ssrs(seqs: DataFrame, params: SsrParams | None = None) -> DataFrame:
    """The matches in seqs (idx, name, seq): a row each, without a shuffle. Null sequences have none; sequences outside the length limits are not searched."""
    p = params or SsrParams()
    kept = seqs.select("idx", F.col("name").alias("seq_name"), F.upper("seq").alias("seq")).where(F.length("seq") >= max(p.min_seq_len, p.min_length))
    if p.max_seq_len is not None:
        kept = kept.where(F.length("seq") <= p.max_seq_len)
    if p.motifs is None and not p.by_runs:
        motifs.dictionary(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("seq").to_pylist()
            if p.by_runs:
                rows = runs([t.encode() for t in texts], p)
            else:
                rows = [(k, *m) for k, t in enumerate(texts) for m in scanned(t, p)]
            rows.sort(key=lambda r: (r[0], r[1], -r[4], r[3]))
            owner = pa.array([r[0] for r in rows], pa.int64())
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[1:] or [()] * 7, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("idx").take(owner), b.column("seq_name").take(owner), *columns], names=["idx", "seq_name", "start", "end", "canonical", "length", "strand", "num_units", "motif"])

    return kept.mapInArrow(run, COLUMNS)


def fasta_totals(seqs: DataFrame) -> DataFrame:
    """One row: total_sequences, total_bases (all letters) and gc_pct, over all sequences whatever their length."""
    own = seqs.select(F.length("seq").alias("n"), dna.gc_count(F.upper("seq")).alias("gc"))
    sums = own.agg(F.count("n").alias("total_sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_bases"), F.coalesce(F.sum("gc"), F.lit(0)).alias("gc"))
    return sums.select("total_sequences", "total_bases", dna.gc_percent(F.col("gc"), F.col("total_bases")).alias("gc_pct"))


def read_totals(reads: DataFrame, params: SsrParams | None = None) -> DataFrame:
    """One row: total_reads and total_bases of the reads inside the length limits."""
    p = params or SsrParams()
    n = F.length("seq")
    kept = reads.where((n >= p.min_seq_len) & (F.lit(True) if p.max_seq_len is None else n <= p.max_seq_len))
    return kept.agg(F.count("seq").alias("total_reads"), F.coalesce(F.sum(n), F.lit(0)).alias("total_bases"))


def class_stats(matches: DataFrame, totals: DataFrame) -> DataFrame:
    """Instances, distinct reads (by idx), covered bases and their rates of each (class, strand, motif size)."""
    by = matches.groupBy(F.col("canonical").alias("class"), "strand", F.length("canonical").alias("motif_len"))
    sums = by.agg(F.count(F.lit(1)).alias("instances"), F.count_distinct("idx").alias("reads"), F.sum("length").alias("covered_bases"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) * F.lit(1e6) / F.col(b)).otherwise(F.lit(0.0))
    joined = sums.crossJoin(totals)  # the totals are one row
    return joined.select("class", "strand", "motif_len", "instances", "reads", "covered_bases", rate("instances", "total_reads").alias("instances_per_million_reads"), rate("covered_bases", "total_bases").alias("bases_per_million_bases"))


def overlap_filter(matches: DataFrame) -> DataFrame:
    """Of each sequence and class the matches that reach beyond all earlier ones (by start, then longest)."""
    from pyspark.sql import Window

    order = Window.partitionBy("idx", "canonical").orderBy("start", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    return matches.withColumn("__reach", F.coalesce(F.max("end").over(order), F.lit(0))).where(F.col("end") > F.col("__reach")).drop("__reach")


def distinct_matches(matches: DataFrame) -> DataFrame:
    """One match of each sequence, place, motif, class and strand."""
    return matches.dropDuplicates(["idx", "start", "end", "motif", "canonical", "strand"])


def ordered(matches: DataFrame) -> DataFrame:
    """In the order of the sequences, their places, and the longest first."""
    return matches.orderBy("idx", "start", F.desc("length"), "canonical")
