"""The SQL surface: views, functions and jobs over a session."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, merge_kernel, ssr
from ..params import MergeParams, SsrParams
from ..sources import fasta, fastq, registered, sinks

VIEWS = ("flash_combined", "flash_not_combined_left", "flash_not_combined_right")


class Repeats:
    """The repeats of one sequence, for SQL: SELECT t.* FROM reads, LATERAL flash_ssr(seq) t."""

    def eval(self, seq: str):
        if seq is not None:
            p = SsrParams()
            for _, start, end, label, length, strand, units, motif in sorted(ssr.runs([seq.upper().encode()], p), key=lambda r: (r[1], -r[4], r[3])):
                yield start, end, label, length, strand, units, motif


def values_view(spark: SparkSession, name: str, columns: list[str], rows: list[tuple]) -> None:
    """A temporary view of rows of texts, as from VALUES; without rows an empty view with the same columns."""
    spark.createDataFrame([tuple(None if x is None else str(x) for x in r) for r in rows], ", ".join(f"`{c}` string" for c in columns)).createOrReplaceTempView(name)


def parquet_view(spark: SparkSession, name: str, path: str) -> None:
    """A temporary view over Parquet files elsewhere; filters and columns reach the scan."""
    spark.read.parquet(path).createOrReplaceTempView(name)


def drop_view(spark: SparkSession, name: str) -> bool:
    """Whether there was such a view."""
    return spark.catalog.dropTempView(name)


def explain(spark: SparkSession, sql: str, mode: str = "FORMATTED") -> DataFrame:
    """The plan of a query as a table of one text."""
    return spark.sql(f"EXPLAIN {mode} {sql}")


def register_functions(spark: SparkSession, params: MergeParams | None = None) -> None:
    """flash_merge over (tag1, seq1, qual1, tag2, seq2, qual2), a struct of is_combined, tag, seq and qual by one run of the kernel,
    and its fields alone: flash_is_combined, flash_combined_tag, flash_combined_seq and flash_combined_qual. Also flash_ssr(seq), a table.

    Vectorised; a null argument gives null, a malformed pair fails the query. Register again to change the parameters.
    """
    p = params or MergeParams()

    def merged(*reads: pd.Series) -> tuple[pa.Array, pa.Array, pa.Array]:
        null = pd.concat([r.isna() for r in reads], axis=1).any(axis=1)
        own = [pa.array([None if z else x for x, z in zip(r, null, strict=True)], pa.string()) for r in (reads[1], reads[2], reads[4], reads[5])]
        return merge_kernel.merge_batch(*own, p)

    @F.pandas_udf("boolean")
    def is_combined(tag1: pd.Series, seq1: pd.Series, qual1: pd.Series, tag2: pd.Series, seq2: pd.Series, qual2: pd.Series) -> pd.Series:
        return pd.Series(merged(tag1, seq1, qual1, tag2, seq2, qual2)[0].to_pylist(), dtype=object)

    def text(which: int):
        @F.pandas_udf("string")
        def column(tag1: pd.Series, seq1: pd.Series, qual1: pd.Series, tag2: pd.Series, seq2: pd.Series, qual2: pd.Series) -> pd.Series:
            found = merged(tag1, seq1, qual1, tag2, seq2, qual2)
            if which:
                return pd.Series(found[which].to_pylist(), dtype=object)
            return pd.Series([merge.merged_tag(t) if ok else None for t, ok in zip(tag1, found[0].to_pylist(), strict=True)], dtype=object)

        return column

    @F.pandas_udf("is_combined boolean, tag string, seq string, qual string")
    def whole(tag1: pd.Series, seq1: pd.Series, qual1: pd.Series, tag2: pd.Series, seq2: pd.Series, qual2: pd.Series) -> pd.DataFrame:
        ok, seq, qual = (x.to_pylist() for x in merged(tag1, seq1, qual1, tag2, seq2, qual2))
        return pd.DataFrame({"is_combined": pd.Series(ok, dtype=object), "tag": [merge.merged_tag(t) if z else None for t, z in zip(tag1, ok, strict=True)], "seq": seq, "qual": qual})

    spark.udf.register("flash_merge", whole)
    spark.udtf.register("flash_ssr", F.udtf(Repeats, returnType="start long, `end` long, canonical string, length long, strand string, num_units long, motif string"))
    spark.udf.register("flash_is_combined", is_combined)
    for i, name in enumerate(("tag", "seq", "qual")):
        spark.udf.register(f"flash_combined_{name}", text(i))


@dataclass
class MergeJob:
    """Two FASTQ files merged to three, through tables and views of the session."""

    spark: SparkSession
    forward: str
    reverse: str
    params: MergeParams = field(default_factory=MergeParams)
    output_dir: str = "."
    output_prefix: str = "out"

    def pairs(self) -> DataFrame:
        return fastq.read_pairs(self.spark, self.forward, self.reverse, self.params.phred_offset)

    def annotated(self) -> DataFrame:
        return merge.annotate(self.pairs(), self.params)

    def outputs(self) -> merge.Outputs:
        return merge.outputs(self.annotated())

    def create_views(self) -> None:
        """flash_pairs (six columns), flash_input_pairs (with idx), and the three outputs; functions with this job's parameters."""
        pairs = self.pairs()
        pairs.createOrReplaceTempView("flash_input_pairs")
        pairs.select(*merge.READS).createOrReplaceTempView("flash_pairs")
        for name, df in zip(VIEWS, merge.outputs(merge.annotate(pairs, self.params)), strict=True):
            df.select("tag", "seq", "qual").createOrReplaceTempView(name)
        register_functions(self.spark, self.params)

    def run(self) -> list[Path]:
        """The three files, in input order. The merged pairs are written once and filtered three times."""
        annotated = self.annotated()
        stage = Path(self.output_dir) / f".{self.output_prefix}-annotated"
        annotated.write.mode("overwrite").parquet(str(stage))
        done = self.spark.read.schema(annotated.schema).parquet(str(stage))
        names = ("extendedFrags", "notCombined_1", "notCombined_2")
        out = [sinks.write_fastq(df, Path(self.output_dir) / f"{self.output_prefix}.{n}.fastq") for n, df in zip(names, merge.outputs(done), strict=True)]
        import shutil

        shutil.rmtree(stage)
        return out


def merge_text(spark: SparkSession, text1: str, text2: str, params: MergeParams | None = None) -> dict:
    """Two FASTQ texts merged; {status, combined, not_combined_1, not_combined_2}, or {status: error, error}."""
    p = params or MergeParams()
    try:
        one, two = fastq.parse_text(text1, p.phred_offset), fastq.parse_text(text2, p.phred_offset)
        if len(one) != len(two):
            raise fastq.FastqError(fastq.UNEQUAL)
        rows = [(i, *a, *b) for i, (a, b) in enumerate(zip(one, two, strict=True))]
        done = merge.annotate(spark.createDataFrame(rows, fastq.PAIR_SCHEMA), p)
        parts = ["".join(f"{r['tag']}\n{r['seq']}\n+\n{r['qual']}\n" for r in df.orderBy("idx").collect()) for df in merge.outputs(done)]
        return dict(zip(("status", "combined", "not_combined_1", "not_combined_2"), ("ok", *parts), strict=True))
    except ValueError as e:
        return {"status": "error", "error": str(e)}


def ssr_fasta(spark: SparkSession, path: str, output: str | None = None, params: SsrParams | None = None) -> DataFrame:
    """The matches of a FASTA file; written with their footer where output is given."""
    seqs = fasta.read_fasta(spark, path)
    found = ssr.find_ssrs(seqs, params)
    if output:
        sinks.write_matches(found, ssr.fasta_totals(seqs), path, output)
    return found


def ssr_fastq(spark: SparkSession, path: str, output: str | None = None, params: SsrParams | None = None) -> DataFrame:
    """The class statistics of a FASTQ file, read leniently."""
    reads = fastq.read_fastq(spark, path, mode="lenient").select("idx", F.col("tag").alias("name"), "seq")
    totals = ssr.read_totals(reads, params)
    stats = ssr.class_stats(ssr.find_ssrs(reads, params), totals)
    if output:
        sinks.write_class_stats(stats, totals, output)
    return stats


def open_session(spark: SparkSession) -> SparkSession:
    """The session with the formats fastq, fastq_pairs and fasta and the flash_ functions registered."""
    registered.register(spark)
    register_functions(spark)
    return spark
