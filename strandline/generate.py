"""Deterministic synthetic reads and sequences, made by SQL expressions in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dna


# The published generators' period, tags, repeat units, their length and distance.


def read_pairs(spark: SparkSession, pairs: int, read_length: int = 150, prefix: str = "SEQ") -> DataFrame:
    """Pair k: base j is ACGT[(k + j) mod 4], the second read its reverse complement, all qualities I."""
    if read_length <= 0:
        raise ValueError("read_length must be above 0")
    whole = "ACGT" * (read_length // 4 + 2)
    seq = F.substring(F.lit(whole), (F.col("idx") % 4 + 1).cast("int"), F.lit(read_length))
    qual = F.lit("I" * read_length)
    tag = lambda n: F.format_string(f"@{prefix}%010d.{n}", F.col("idx") + 1)
    return spark.range(pairs).withColumnRenamed("id", "idx").select("idx", tag(1).alias("tag1"), seq.alias("seq1"), qual.alias("qual1"), tag(2).alias("tag2"), dna.reverse_complement(seq).alias("seq2"), qual.alias("qual2"))


def repeat_sequences(spark: SparkSession, count: int, length: int = 50_000, every: int = 997, seed: int = 42) -> DataFrame:
    """idx, name, seq: hashed bases, with 24 bases of a repeat (A, AC, ATG, CAGT or AACGTT in turn) at every `every`-th place."""
    units = F.array(*[F.lit((u * 24)[:24]) for u in ("A", "AC", "ATG", "CAGT", "AACGTT")])
    words = F.transform(F.sequence(F.lit(0), F.lit(length // 32)), lambda i: F.translate(F.md5(F.concat_ws("-", F.col("idx"), i, F.lit(seed)).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT"))
    plain = F.substring(F.concat_ws("", words), 1, length)
    spots = F.sequence(F.lit(0), F.lit(max(0, length - 25) // every))
    seq = F.aggregate(spots, plain, lambda s, k: F.overlay(s, F.element_at(units, (k % 5 + 1).cast("int")), (k * every + 1).cast("int"), F.lit(24)))
    return spark.range(count).withColumnRenamed("id", "idx").select("idx", F.format_string("seq%d", F.col("idx") + 1).alias("name"), seq.alias("seq"))
