"""Command line: merge, ssr and generate."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from . import generate
from .params import MergeParams, SsrParams, read_min_units, read_motifs
from .plans import session
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    m = sub.add_parser("merge", help="merge read pairs of two FASTQ files")
    m.add_argument("forward")
    m.add_argument("reverse")
    m.add_argument("-m", "--min-overlap", type=int, default=10)
    m.add_argument("-M", "--max-overlap", type=int, default=65)
    m.add_argument("-x", "--max-mismatch-density", type=float, default=0.25)
    m.add_argument("-p", "--phred-offset", type=int, default=33)
    m.add_argument("-O", "--allow-outies", action="store_true")
    m.add_argument("--cap-mismatch-quals", action="store_true")
    m.add_argument("--lowercase-overhang", action="store_true")
    m.add_argument("--output-dir", default=".")
    m.add_argument("--output-prefix", default="out")
    m.add_argument("--parallel", action="store_true", help="accepted; tasks are always parallel")
    m.add_argument("--batch-size", type=int, default=4096, help="rows of an Arrow batch")
    m.add_argument("--threads", type=int, help="local threads")

    s = sub.add_parser("ssr", help="find microsatellites in a FASTA or FASTQ file")
    s.add_argument("-i", "--input", required=True)
    s.add_argument("-o", "--output")
    s.add_argument("--format", choices=("fasta", "fastq"), default="fasta")
    s.add_argument("-m", "--min-motif", type=int, default=1)
    s.add_argument("-M", "--max-motif", type=int, default=6)
    s.add_argument("-l", "--min-length", type=int, default=12)
    s.add_argument("-u", "--min-units", help="a number, or a file of `motif_len min_units` lines")
    s.add_argument("-s", "--min-seq-len", type=int, default=0)
    s.add_argument("-S", "--max-seq-len", type=int)
    s.add_argument("--rep", help="file of motifs")
    s.add_argument("-t", "--threads", type=int, default=0, help="local threads, 0 for all")

    g = sub.add_parser("generate", help="write synthetic read pairs")
    g.add_argument("forward")
    g.add_argument("reverse")
    g.add_argument("--pairs", type=int, default=1000)
    g.add_argument("--read-length", type=int, default=150)
    g.add_argument("--prefix", default="SEQ")
    return top


def default_output(path: str) -> str:
    p = Path(path)
    return str(p.with_name(f"{p.stem}_perf.tsv"))


def ssr_params(a: argparse.Namespace) -> SsrParams:
    units = read_min_units(a.min_units, a.min_motif, a.max_motif) if a.min_units else {}
    return SsrParams(a.min_motif, a.max_motif, a.min_length, a.min_seq_len, a.max_seq_len, units, read_motifs(a.rep) if a.rep else None)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        threads = getattr(a, "threads", None) or "*"
        spark = SparkSession.builder.master(f"local[{threads}]").appName("strandline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.command == "merge":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(a.batch_size))
        p = MergeParams(a.min_overlap, a.max_overlap, a.max_mismatch_density, a.cap_mismatch_quals, a.allow_outies, a.lowercase_overhang, a.phred_offset)
        session.MergeJob(spark, a.forward, a.reverse, p, a.output_dir, a.output_prefix).run()
    elif a.command == "ssr":
        job = session.ssr_fasta if a.format == "fasta" else session.ssr_fastq
        job(spark, a.input, a.output or default_output(a.input), ssr_params(a))
    else:
        made = generate.read_pairs(spark, a.pairs, a.read_length, a.prefix)
        for n, path in ((1, a.forward), (2, a.reverse)):
            sinks.write_fastq(made.selectExpr("idx", f"tag{n} AS tag", f"seq{n} AS seq", f"qual{n} AS qual"), path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
