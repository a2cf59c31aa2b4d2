"""Operator M: merging of read pairs as a DataFrame transformation.

One pass of the kernel for each pair (mapInArrow, which the optimizer never duplicates); no shuffle. The outputs are filters
over the annotated frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dna
from ..params import MergeParams
from . import merge_kernel

# The columns of a pair and of the outputs.
READS = ("tag1", "seq1", "qual1", "tag2", "seq2", "qual2")


class Outputs(NamedTuple):
    combined: DataFrame
    not_combined_left: DataFrame
    not_combined_right: DataFrame


def annotate(pairs: DataFrame, params: MergeParams | None = None) -> DataFrame:
    """pairs with is_combined, combined_tag, combined_seq and combined_qual; columns besides the six reads pass through.

    A null in any of the six gives nulls in all four, so that row is in none of the outputs.
    """
    p = params or MergeParams()
    missing = [c for c in READS if c not in pairs.columns]
    if missing:
        raise ValueError(f"pairs lack the columns {missing}")
    rest = [c for c in pairs.columns if c not in ("is_combined", "combined_tag", "combined_seq", "combined_qual")]
    own = pairs.select(*rest)
    schema = T.StructType([*own.schema.fields, T.StructField("is_combined", T.BooleanType()), T.StructField("combined_seq", T.StringType()), T.StructField("combined_qual", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merged, seq, qual = merge_kernel.merge_batch(*(b.column(c) for c in ("seq1", "qual1", "seq2", "qual2")), p)
            columns = [*b.columns, merged, seq.cast(pa.string()), qual.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "is_combined", "combined_seq", "combined_qual"])

    out = own.mapInArrow(run, schema)
    any_null = F.col("tag1").isNull() | F.col("tag2").isNull()
    flag = F.when(any_null, F.lit(None)).otherwise(F.col("is_combined"))
    text = lambda c: F.when(flag, F.col(c))
    return out.select(*rest, flag.alias("is_combined"), F.when(flag, dna.combined_tag("tag1")).alias("combined_tag"), text("combined_seq").alias("combined_seq"), text("combined_qual").alias("combined_qual"))


def outputs(annotated: DataFrame) -> Outputs:
    """The merged reads, and the first and second reads of pairs that do not merge, as (tag, seq, qual), with idx if it is there."""
    order = ["idx"] if "idx" in annotated.columns else []

    def reads(tag: str, seq: str, qual: str) -> list:
        return [*order, F.col(tag).alias("tag"), F.col(seq).alias("seq"), F.col(qual).alias("qual")]

    left = annotated.where(~F.col("is_combined"))
    return Outputs(annotated.where("is_combined").select(*reads("combined_tag", "combined_seq", "combined_qual")), left.select(*reads("tag1", "seq1", "qual1")), left.select(*reads("tag2", "seq2", "qual2")))


def observed(annotated: DataFrame, name: str = "merge") -> tuple[DataFrame, Observation]:
    """annotated, and counters of its pairs that are read with the first action: pairs, merged, unmerged, null, merged_bases."""
    counters = Observation(name)
    flag = F.col("is_combined")
    counts = [F.count(F.lit(1)).alias("pairs"), F.count_if(flag).alias("merged"), F.count_if(~flag).alias("unmerged"), F.count_if(flag.isNull()).alias("null"), F.coalesce(F.sum(F.length("combined_seq")), F.lit(0)).alias("merged_bases")]
    return annotated.observe(counters, *counts), counters


class Merged(NamedTuple):
    """What becomes of one pair: merged or not, and the merged read."""

    is_combined: bool
    tag: str | None = None
    seq: str | None = None
    qual: str | None = None


def merge_pair(read1: tuple[str, str, str], read2: tuple[str, str, str], params: MergeParams | None = None) -> Merged:
    """One pair of (tag, letters, qualities); a ValueError if lengths differ or a quality is below the offset."""
    found = merge_kernel.merge_one(read1[1], read1[2], read2[1], read2[2], params)
    return Merged(True, merged_tag(read1[0]), *found) if found else Merged(False)


def merged_tag(tag: str) -> str:
    head, slash, tail = tag.rpartition("/")
    return tag if not slash else head + (tail[1:] if tail[1:2] == "#" else "")
