"""The row-wise operators over streams: merging and repeat search hold no state, so the batch plans run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge, ssr
from ..params import MergeParams, SsrParams


def merge_stream(pairs: DataFrame, params: MergeParams | None = None) -> DataFrame:
    """A stream of read pairs, annotated."""
    return merge.annotate(pairs, params)


def ssr_stream(seqs: DataFrame, params: SsrParams | None = None) -> DataFrame:
    """A stream of sequences (idx, name, seq) to a stream of matches."""
    return ssr.find_ssrs(seqs, params)


def merge_rates(annotated: DataFrame, ts: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Pairs and merged pairs of each window of event time; rows later than `late` behind the watermark are left out."""
    by = annotated.withWatermark(ts, late).groupBy(F.window(ts, window))
    return by.agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("is_combined"), 1)).alias("merged"))
