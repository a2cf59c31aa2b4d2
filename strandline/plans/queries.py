"""The queries of the engine's own operators, and SQL that computes the same by other means."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import generate
from ..functions import dna
from ..operators import merge, motifs, ssr
from ..params import MergeParams, SsrParams
from . import inputs, relational, session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_PAIRS = inputs.duck(inputs.PAIRS)
_SEQS = inputs.duck(inputs.SEQS)
_RC = "reverse(translate({}, 'ACGTN', 'TGCAN'))"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- sequence functions ----


@query("SELECT c_custkey AS k, regexp_replace(upper(c_name), '[^ACGT]', 'N', 'g') AS name, regexp_replace(upper(md5(cast(c_custkey as string))), '[^ACGT]', 'N', 'g') AS bases FROM customer")
def canonical_bases(spark, sf_dir):
    t = inputs.table(spark, sf_dir, "customer")
    return t.select(F.col("c_custkey").alias("k"), dna.canonical("c_name").alias("name"), dna.canonical(F.md5(F.col("c_custkey").cast("string"))).alias("bases"))


@query(f"SELECT k, {_RC.format('seq1')} AS rc1, {_RC.format('seq2')} AS rc2, reverse(qual2) AS rq2 FROM ({_PAIRS})")
def revcomp(spark, sf_dir):
    return inputs.pairs(spark, sf_dir).select(F.col("idx").alias("k"), dna.reverse_complement("seq1").alias("rc1"), dna.reverse_complement("seq2").alias("rc2"), F.reverse("qual2").alias("rq2"))


@query(f"SELECT k, CAST(length(s) - length(replace(replace(s, 'G', ''), 'C', '')) AS BIGINT) AS gc, round(100.0 * (length(s) - length(replace(replace(s, 'G', ''), 'C', ''))) / length(s), 6) AS pct FROM ({_SEQS})")
def gc_content(spark, sf_dir):
    gc = dna.gc_count("seq").cast("long")
    return inputs.seqs(spark, sf_dir).select(F.col("idx").alias("k"), gc.alias("gc"), F.round(dna.gc_percent(gc, F.length("seq")), 6).alias("pct"))


@query(f"SELECT k, CAST(sum(q) AS BIGINT) AS total, CAST(min(q) AS BIGINT) AS low, CAST(max(q) AS BIGINT) AS high, count(*) AS n FROM (SELECT k, ascii(substr(qual1, CAST(unnest(range(1, length(qual1) + 1)) AS BIGINT), 1)) - 33 AS q FROM ({_PAIRS})) GROUP BY k")
def quality_decode_stats(spark, sf_dir):
    q = dna.phred("qual1")
    return inputs.pairs(spark, sf_dir).select(F.col("idx").alias("k"), F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min(q).cast("long").alias("low"), F.array_max(q).cast("long").alias("high"), F.size(q).cast("long").alias("n"))


_CUT = """CASE WHEN instr(t, '/') = 0 THEN t ELSE concat(substr(t, 1, length(t) - instr(reverse(t), '/')),
  CASE WHEN substr(t, length(t) - instr(reverse(t), '/') + 3, 1) = '#' THEN substr(t, length(t) - instr(reverse(t), '/') + 3) ELSE '' END) END"""


@query(f"SELECT k, {_CUT} AS tag FROM (SELECT c_custkey AS k, {inputs.TAG} AS t FROM (SELECT c_custkey, c_custkey AS k FROM customer))")
def combined_tag(spark, sf_dir):
    return inputs.pairs(spark, sf_dir).select(F.col("idx").alias("k"), dna.combined_tag("tag1").alias("tag"))


# ---- merging ----


def merge_oracle(p: MergeParams, select: str) -> str:
    """All overlaps of all pairs, base by base, the best one by a rank, and the consensus by an ordered join of letters; `select` from r (a row a pair)."""
    edge = "lower({})" if p.lowercase_overhang else "{}"
    unlike = "least(g, h, 2)" if p.cap_mismatch_quals else "greatest(abs(g - h), 2)"
    outie = f"UNION ALL SELECT k, 1, {_RC.format('seq2')}, seq1, reverse(qual2), qual1 FROM pairs" if p.allow_outies else ""
    under, x = f"least(n, {p.max_overlap})", f"CAST({p.max_mismatch_density} AS FLOAT)"
    q = p.phred_offset
    return f"""
WITH pairs AS ({_PAIRS}),
v AS (SELECT k, 0 AS o, seq1 AS a, {_RC.format("seq2")} AS b, qual1 AS qa, reverse(qual2) AS qb FROM pairs {outie}),
c AS (SELECT *, unnest(range(greatest(0, length(a) - length(b)), length(a) - {p.min_overlap} + 1)) AS i FROM v),
d AS (SELECT k, o, i, substr(a, i + j, 1) AS s, substr(b, j, 1) AS t, ascii(substr(qa, i + j, 1)) - {q} AS g, ascii(substr(qb, j, 1)) - {q} AS h
      FROM (SELECT *, unnest(range(1, length(a) - i + 1)) AS j FROM c)),
w AS (SELECT k, o, i, count(*) AS n, sum(CASE WHEN s <> t THEN 1 ELSE 0 END) AS m, sum(CASE WHEN s <> t THEN least(g, h) ELSE 0 END) AS q
      FROM d WHERE s <> 'N' AND t <> 'N' GROUP BY k, o, i HAVING count(*) >= {p.min_overlap}),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CAST(m / {under} AS FLOAT), CAST(q / {under} AS FLOAT), o, i) AS rn FROM w WHERE CAST(m / {under} AS FLOAT) <= {x}),
best AS (SELECT v.*, f.i FROM f JOIN v ON v.k = f.k AND v.o = f.o WHERE rn = 1),
y AS (SELECT k, z, i, length(a) AS la, substr(a, z, 1) AS s, CASE WHEN z > i THEN substr(b, z - i, 1) END AS t,
             ascii(substr(qa, z, 1)) - {q} AS g, CASE WHEN z > i THEN ascii(substr(qb, z - i, 1)) - {q} END AS h
      FROM (SELECT *, unnest(range(1, i + length(b) + 1)) AS z FROM best)),
u AS (SELECT k, z, CASE WHEN z <= i THEN {edge.format("s")} WHEN z > la THEN {edge.format("t")} WHEN s = t OR g > h THEN s WHEN h > g THEN t WHEN t = 'N' THEN s ELSE t END AS ch,
             CASE WHEN z <= i THEN g WHEN z > la THEN h WHEN s = t THEN greatest(g, h) ELSE {unlike} END AS ql FROM y),
found AS (SELECT k, string_agg(ch, '' ORDER BY z) AS seq, string_agg(chr(CAST(ql + {q} AS INT)), '' ORDER BY z) AS qual FROM u GROUP BY k),
r AS (SELECT p.k, t, p.seq1, p.qual1, p.seq2, p.qual2, found.k IS NOT NULL AS ok, {_CUT} AS tag, found.seq, found.qual FROM (SELECT *, {inputs.TAG} AS t FROM pairs) p LEFT JOIN found ON p.k = found.k)
{select}
"""


_ANNOTATED = "SELECT k AS idx, ok AS is_combined, CASE WHEN ok THEN tag END AS combined_tag, seq AS combined_seq, qual AS combined_qual FROM r"


def annotated(spark: SparkSession, sf_dir: str, p: MergeParams) -> DataFrame:
    return merge.annotate(inputs.pairs(spark, sf_dir), p)


def _add_merge(name: str, p: MergeParams) -> None:
    def run(spark, sf_dir):
        return annotated(spark, sf_dir, p).select("idx", "is_combined", "combined_tag", "combined_seq", "combined_qual")

    run.__name__ = name
    query(merge_oracle(p, _ANNOTATED))(run)


_add_merge("merge_annotated", MergeParams())
_add_merge("merge_outie", MergeParams(allow_outies=True))
_add_merge("merge_capped", MergeParams(cap_mismatch_quals=True))
_add_merge("merge_lowercase", MergeParams(lowercase_overhang=True, allow_outies=True))
_add_merge("merge_strict_density", MergeParams(min_overlap=15, max_overlap=20, max_mismatch_density=0.1))
_add_merge("merge_loose", MergeParams(min_overlap=5, max_mismatch_density=0.4, allow_outies=True))


@query(merge_oracle(MergeParams(), "SELECT k AS idx, tag, seq, qual FROM r WHERE ok"))
def merge_combined(spark, sf_dir):
    return merge.outputs(annotated(spark, sf_dir, MergeParams())).combined


@query(merge_oracle(MergeParams(), "SELECT k AS idx, t AS tag, seq1 AS seq, qual1 AS qual FROM r WHERE NOT ok"))
def merge_not_combined_left(spark, sf_dir):
    return merge.outputs(annotated(spark, sf_dir, MergeParams())).not_combined_left


@query(merge_oracle(MergeParams(), "SELECT k AS idx, t AS tag, seq2 AS seq, qual2 AS qual FROM r WHERE NOT ok"))
def merge_not_combined_right(spark, sf_dir):
    return merge.outputs(annotated(spark, sf_dir, MergeParams())).not_combined_right


@query(merge_oracle(MergeParams(), "SELECT ok AS is_combined, count(*) AS pairs, CAST(coalesce(sum(length(seq)), 0) AS BIGINT) AS bases, CAST(coalesce(max(length(seq)), 0) AS BIGINT) AS longest FROM r GROUP BY ok"))
def merge_summary(spark, sf_dir):
    n = F.length("combined_seq").cast("long")
    return annotated(spark, sf_dir, MergeParams()).groupBy("is_combined").agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum(n), F.lit(0)).alias("bases"), F.coalesce(F.max(n), F.lit(0)).alias("longest"))


@query(merge_oracle(MergeParams(), "SELECT k AS idx, ok, CASE WHEN ok THEN tag END AS tag, seq, qual FROM r"))
def merge_sql_functions(spark, sf_dir):
    """The registered SQL functions."""
    session.register_functions(spark)
    reads = "(tag1, seq1, qual1, tag2, seq2, qual2)"
    return spark.sql(f"SELECT idx, flash_is_combined{reads} AS ok, flash_combined_tag{reads} AS tag, flash_combined_seq{reads} AS seq, flash_combined_qual{reads} AS qual FROM {{pairs}}", pairs=inputs.pairs(spark, sf_dir))


# ---- repeats ----

_WORDS = "w AS (SELECT unnest(['A','C','G','T']) AS m), words AS (SELECT m FROM w " + " ".join("UNION ALL SELECT concat(" + ", ".join(f"w{i}.m" for i in range(n)) + ") FROM " + ", ".join(f"w w{i}" for i in range(n)) for n in range(2, 7)) + ")"
_TURNS = "list_transform(range(0, length({0})), lambda i: concat(substr({0}, CAST(i + 1 AS BIGINT)), substr({0}, 1, CAST(i AS BIGINT))))"
#: Motifs of one to six letters that are no repetition, with class and strand.
DIMENSION = f"""{_WORDS},
own AS (SELECT m, {_TURNS.format("m")} AS t, {_TURNS.format("reverse(translate(m, 'ACGT', 'TGCA'))")} AS u FROM words WHERE instr(substr(concat(m, m), 2), m) = length(m)),
dim AS (SELECT m AS motif, least(list_min(t), list_min(u)) AS canonical, CAST(length(m) AS INT) AS motif_len, CASE WHEN list_contains(t, least(list_min(t), list_min(u))) THEN '+' ELSE '-' END AS strand FROM own)"""


@query(f"WITH {DIMENSION} SELECT * FROM dim")
def motif_dictionary(spark, sf_dir):
    return motifs.motif_table(spark, SsrParams())


_MOTIF = f"substr({inputs.dna('u')}, 1, cast(k % 6 + 1 as int))"


@query(f"WITH x AS (SELECT k, {_MOTIF} AS m FROM (SELECT c_custkey AS k FROM customer)) SELECT k, m, array_to_string({_TURNS.format('m')}, ',') AS turns, least(list_min({_TURNS.format('m')}), list_min({_TURNS.format(_RC.format('m'))})) AS canonical, instr(substr(concat(m, m), 2), m) = length(m) AS atomic, substr(repeat(m, 12), 1, 12) AS key FROM x")
def motif_functions(spark, sf_dir):
    made = inputs.table(spark, sf_dir, "customer").selectExpr("c_custkey AS k").selectExpr("k", f"{_MOTIF} AS m")
    return made.select("k", "m", F.array_join(dna.rotations("m"), ",").alias("turns"), dna.canonical_motif("m").alias("canonical"), dna.is_atomic("m").alias("atomic"), dna.expanded("m", 12).alias("key"))


def ssr_oracle(select: str, where: str = "TRUE", least: int = 12) -> str:
    """Gaps and islands: places that equal the one a period on, their islands, and the motif dimension; `select` from f."""
    return f"""
WITH {DIMENSION}, seqs AS ({_SEQS}),
hit AS (SELECT k, p, i FROM (SELECT k, s, unnest(range(1, length(s) + 1)) AS i FROM seqs), (VALUES (1), (2), (3), (4), (5), (6)) AS v(p)
        WHERE i + p <= length(s) AND substr(s, i, 1) = substr(s, i + p, 1) AND substr(s, i, 1) IN ('A', 'C', 'G', 'T')),
isl AS (SELECT k, p, i, i - row_number() OVER (PARTITION BY k, p ORDER BY i) AS g FROM hit),
run AS (SELECT k, p, min(i) - 1 AS st, max(i) + p AS en FROM isl GROUP BY k, p, g HAVING max(i) + p - (min(i) - 1) >= {least}),
f AS (SELECT run.k AS idx, concat('s', cast(run.k as string)) AS seq_name, CAST(st AS BIGINT) AS start, CAST(en AS BIGINT) AS "end", canonical, CAST(en - st AS BIGINT) AS length, strand, CAST((en - st) // p AS BIGINT) AS num_units, motif, motif_len, length(s) AS seq_len
      FROM run JOIN seqs ON run.k = seqs.k JOIN dim ON motif = substr(s, st + 1, p)),
kept AS (SELECT * FROM f WHERE {where})
{select}
"""


_MATCH = 'SELECT idx, seq_name, start, "end", canonical, length, strand, num_units, motif FROM kept'


@query(ssr_oracle(_MATCH))
def ssr_matches(spark, sf_dir):
    return ssr.find_ssrs(inputs.seqs(spark, sf_dir))


@query(ssr_oracle(_MATCH, "num_units >= CASE motif_len WHEN 1 THEN 14 WHEN 2 THEN 8 WHEN 3 THEN 5 ELSE 4 END"))
def ssr_min_units(spark, sf_dir):
    return ssr.find_ssrs(inputs.seqs(spark, sf_dir), SsrParams(min_units={1: 14, 2: 8, 3: 5, 4: 4, 5: 4, 6: 4}))


@query(ssr_oracle(_MATCH, "seq_len BETWEEN 80 AND 100 AND motif_len >= 2", 20))
def ssr_len_filter(spark, sf_dir):
    return ssr.find_ssrs(inputs.seqs(spark, sf_dir), SsrParams(min_motif=2, min_length=20, min_seq_len=80, max_seq_len=100))


_STATS = """, t AS (SELECT count(*) AS reads, sum(length(s)) AS bases FROM seqs)
SELECT canonical AS class, strand, motif_len, count(*) AS instances, count(DISTINCT idx) AS reads, CAST(sum(length) AS BIGINT) AS covered_bases,
       round(count(*) * 1e6 / (SELECT reads FROM t), 4) AS instances_per_million_reads, round(sum(length) * 1e6 / (SELECT bases FROM t), 4) AS bases_per_million_bases
FROM kept GROUP BY canonical, strand, motif_len"""


@query(ssr_oracle("SELECT * FROM kept").replace("\nSELECT * FROM kept\n", _STATS))
def ssr_class_stats(spark, sf_dir):
    seqs = inputs.seqs(spark, sf_dir)
    stats = ssr.class_stats(ssr.find_ssrs(seqs), ssr.read_totals(seqs))
    return stats.withColumns({c: F.round(c, 4) for c in ("instances_per_million_reads", "bases_per_million_bases")})


@query(ssr_oracle(_MATCH))
def ssr_overlap_filter(spark, sf_dir):
    """Maximal runs pass the overlap rule unchanged."""
    return ssr.overlap_filter(ssr.find_ssrs(inputs.seqs(spark, sf_dir)))


@query(f"SELECT count(*) AS total_sequences, CAST(sum(length(s)) AS BIGINT) AS total_bases, round(100.0 * sum(length(s) - length(replace(replace(s, 'G', ''), 'C', ''))) / sum(length(s)), 4) AS gc_pct FROM ({_SEQS})")
def fasta_totals(spark, sf_dir):
    return ssr.fasta_totals(inputs.seqs(spark, sf_dir)).withColumn("gc_pct", F.round("gc_pct", 4))


@query(f"SELECT count(*) AS total_reads, CAST(sum(length(s)) AS BIGINT) AS total_bases FROM ({_SEQS}) WHERE length(s) BETWEEN 80 AND 100")
def read_totals(spark, sf_dir):
    return ssr.read_totals(inputs.seqs(spark, sf_dir), SsrParams(min_seq_len=80, max_seq_len=100))


# ---- generator and files ----


@query("SELECT k AS idx, format('@SEQ{:010d}.1', k + 1) AS tag1, substr(repeat('ACGT', 40), k % 4 + 1, 150) AS seq1, repeat('I', 150) AS qual1, format('@SEQ{:010d}.2', k + 1) AS tag2, reverse(translate(substr(repeat('ACGT', 40), k % 4 + 1, 150), 'ACGT', 'TGCA')) AS seq2, repeat('I', 150) AS qual2 FROM (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS k)")
def fastq_generator(spark, sf_dir):
    return generate.read_pairs(spark, inputs.table(spark, sf_dir, "orders").count())


def _folder(spark: SparkSession) -> str:
    import tempfile

    at = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="strandline-")
    return f"{at.removeprefix('file://').rstrip('/')}/files-{uuid.uuid4().hex}"


@query(f"SELECT row_number() OVER (ORDER BY k) - 1 AS idx, {inputs.TAG} AS tag, seq1 AS seq, qual1 AS qual FROM ({_PAIRS})")
def fastq_roundtrip(spark, sf_dir):
    """Written as one FASTQ file and read back by blocks."""
    from ..sources import fastq, sinks

    reads = inputs.pairs(spark, sf_dir).selectExpr("idx", "tag1 AS tag", "seq1 AS seq", "qual1 AS qual")
    path = sinks.write_fastq(reads, f"{_folder(spark)}/reads.fastq")
    return fastq.read_fastq(spark, str(path), block=1 << 16)


@query(f"SELECT row_number() OVER (ORDER BY k) - 1 AS idx, concat('s', cast(k as string)) AS name, s AS seq FROM ({_SEQS})")
def fasta_roundtrip(spark, sf_dir):
    """Written as FASTA with lines of 30 letters and read back by blocks."""
    from ..sources import fasta, sinks

    line = F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.regexp_replace("seq", "(.{30})(?=.)", "$1\n"))
    path = sinks.write_lines(inputs.seqs(spark, sf_dir), line, f"{_folder(spark)}/seqs.fa", ["idx"])
    return fasta.read_fasta(spark, str(path), block=1 << 16)


@query(merge_oracle(MergeParams(), "SELECT row_number() OVER (ORDER BY k) - 1 AS idx, ok AS is_combined, CASE WHEN ok THEN tag END AS combined_tag, seq AS combined_seq, qual AS combined_qual FROM r"))
def merge_files(spark, sf_dir):
    """Two FASTQ files written, read as pairs by blocks, and merged."""
    from ..sources import fastq

    done = merge.annotate(fastq.read_pairs(spark, *_pair_files(spark, sf_dir)[1], block=1 << 16))
    return done.select("idx", "is_combined", "combined_tag", "combined_seq", "combined_qual")


_THREE = """SELECT 'extendedFrags' AS file, row_number() OVER (ORDER BY k) - 1 AS idx, tag, seq, qual FROM r WHERE ok
UNION ALL SELECT 'notCombined_1', row_number() OVER (ORDER BY k) - 1, t, seq1, qual1 FROM r WHERE NOT ok
UNION ALL SELECT 'notCombined_2', row_number() OVER (ORDER BY k) - 1, t, seq2, qual2 FROM r WHERE NOT ok"""


def _pair_files(spark, sf_dir) -> tuple[str, list[str]]:
    from ..sources import sinks

    made, folder = inputs.pairs(spark, sf_dir, ordered=True), _folder(spark)
    return folder, [str(sinks.write_fastq(made.selectExpr(f"tag{n} AS tag", f"seq{n} AS seq", f"qual{n} AS qual"), f"{folder}/r{n}.fastq", [])) for n in (1, 2)]


@query(merge_oracle(MergeParams(), _THREE))
def merge_three_files(spark, sf_dir):
    """The file job's three outputs, read back."""
    from ..sources import fastq

    folder, paths = _pair_files(spark, sf_dir)
    out = session.MergeJob(spark, *paths, output_dir=f"{folder}/out").run()
    parts = [fastq.read_fastq(spark, str(p)).withColumn("file", F.lit(p.name.split(".")[1])) for p in out]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("file", "idx", "tag", "seq", "qual")


@query(f"SELECT row_number() OVER (ORDER BY k) - 1 AS idx, {inputs.TAG} AS tag, seq1 AS seq, qual1 AS qual FROM ({_PAIRS})")
def fastq_lenient_gzip(spark, sf_dir):
    """Lower-case reads as gzip, read leniently."""
    import gzip
    import shutil

    from ..sources import fastq, sinks

    reads = inputs.pairs(spark, sf_dir).selectExpr("idx", "tag1 AS tag", "lower(seq1) AS seq", "qual1 AS qual")
    path = sinks.write_fastq(reads, f"{_folder(spark)}/reads.fastq")
    with path.open("rb") as plain, gzip.open(f"{path}.gz", "wb") as out:
        shutil.copyfileobj(plain, out)
    return fastq.read_fastq(spark, f"{path}.gz", mode="lenient")


@query(f"SELECT row_number() OVER (ORDER BY n, k) - 1 AS idx, seq FROM (SELECT 1 AS n, k, seq1 AS seq FROM ({_PAIRS}) UNION ALL SELECT 2, k, seq2 FROM ({_PAIRS}))")
def fastq_several_files(spark, sf_dir):
    """Two files read as one table, their ordinals running on."""
    from ..sources import fastq

    return fastq.read_fastq(spark, _pair_files(spark, sf_dir)[1], block=1 << 15).select("idx", "seq")


@query(f"SELECT k AS idx, CAST(pos AS INT) AS pos, tag, seq, qual FROM (SELECT k, 0 AS pos, {inputs.TAG} AS tag, seq1 AS seq, qual1 AS qual FROM ({_PAIRS}) UNION ALL SELECT k, 1, {inputs.TAG}, seq2, qual2 FROM ({_PAIRS}))")
def fastq_text_column(spark, sf_dir):
    """FASTQ text in a column, two records a row."""
    from ..sources import fastq, sinks

    texts = inputs.pairs(spark, sf_dir).select("idx", F.concat_ws("\n", sinks.fastq_line("tag1", "seq1", "qual1"), sinks.fastq_line("tag2", "seq2", "qual2")).alias("text"))
    return fastq.parse_column(texts)


@query(merge_oracle(MergeParams(), "SELECT k AS idx, ok, CASE WHEN ok THEN tag END AS tag, seq, qual FROM r"))
def merge_sql_struct(spark, sf_dir):
    """The struct-valued SQL function: one run of the kernel for all four."""
    session.register_functions(spark)
    return spark.sql("SELECT idx, m.is_combined AS ok, m.tag AS tag, m.seq AS seq, m.qual AS qual FROM (SELECT idx, flash_merge(tag1, seq1, qual1, tag2, seq2, qual2) AS m FROM {pairs})", pairs=inputs.pairs(spark, sf_dir))


@query(merge_oracle(MergeParams(), "SELECT count(*) AS pairs, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS merged, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS unmerged, CAST(0 AS BIGINT) AS nulls, CAST(sum(length(seq)) AS BIGINT) AS merged_bases FROM r"))
def merge_counters(spark, sf_dir):
    """The counters that ride on a merge, read after it."""
    done, counters = merge.observed(annotated(spark, sf_dir, MergeParams()), "merge-counters")
    done.write.format("noop").mode("overwrite").save()
    got = counters.get
    return spark.createDataFrame([(got["pairs"], got["merged"], got["unmerged"], got["null"], got["merged_bases"])], "pairs long, merged long, unmerged long, nulls long, merged_bases long")


@query(ssr_oracle(_MATCH, "canonical IN ('AC', 'AAT')"))
def ssr_custom_motifs(spark, sf_dir):
    return ssr.find_ssrs(inputs.seqs(spark, sf_dir), SsrParams(motifs=("ca", "ATA")))


@query(ssr_oracle(_MATCH))
def ssr_distinct(spark, sf_dir):
    """Matches found twice count once."""
    found = ssr.find_ssrs(inputs.seqs(spark, sf_dir))
    return ssr.ordered(ssr.distinct_matches(found.unionByName(found)))


@query(ssr_oracle(_MATCH.replace("seq_name, ", "")))
def ssr_sql_table_function(spark, sf_dir):
    session.register_functions(spark)
    return spark.sql("SELECT idx, t.start, t.`end`, t.canonical, t.length, t.strand, t.num_units, t.motif FROM {seqs}, LATERAL flash_ssr(seq) t", seqs=inputs.seqs(spark, sf_dir))


@query(ssr_oracle("SELECT * FROM kept").replace("\nSELECT * FROM kept\n", "SELECT canonical AS class, strand, motif_len, count(*) AS instances, count(DISTINCT idx) AS reads, CAST(sum(length) AS BIGINT) AS covered_bases FROM kept GROUP BY canonical, strand, motif_len"))
def ssr_class_stats_file(spark, sf_dir):
    """The class statistics written as TSV and read back."""
    from ..sources import sinks, tabular

    seqs = inputs.seqs(spark, sf_dir)
    totals = ssr.read_totals(seqs)
    path = sinks.write_class_stats(ssr.class_stats(ssr.find_ssrs(seqs), totals), totals, f"{_folder(spark)}/stats.tsv")
    back = tabular.read_csv(spark, str(path), schema="class string, strand string, motif_len int, instances long, reads long, covered_bases long, a double, b double", sep="\t", comment="#")
    return back.drop("a", "b")


def _overlapping(spark, sf_dir):
    """Each match, one a base in, and one that reaches a base further."""
    found = ssr.find_ssrs(inputs.seqs(spark, sf_dir))
    moved = lambda a, b: found.withColumns({"start": F.col("start") + a, "end": F.col("end") + b, "length": F.col("length") + b - a})
    return found.unionByName(moved(1, 0)).unionByName(moved(2, 1))


_MOVED = 'SELECT idx, seq_name, start + a AS start, "end" + b AS "end", canonical, length + b - a AS length, strand, num_units, motif FROM kept, (VALUES (0, 0), (1, 0), (2, 1)) AS v(a, b)'


@query(ssr_oracle(f'SELECT * FROM ({_MOVED}) QUALIFY "end" > coalesce(max("end") OVER (PARTITION BY idx, canonical ORDER BY start, length DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)'))
def ssr_overlaps_dropped(spark, sf_dir):
    return ssr.overlap_filter(_overlapping(spark, sf_dir))


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1")
def csv_and_json_files(spark, sf_dir):
    """A table written as CSV and as JSON, half each, and read back."""
    from ..sources import tabular

    t, folder = inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), _folder(spark)
    t.where("c_custkey % 2 = 0").write.csv(f"{folder}/a", header=True)
    t.where("c_custkey % 2 = 1").write.json(f"{folder}/b")
    both = tabular.read_csv(spark, f"{folder}/a").unionByName(tabular.read_json(spark, f"{folder}/b"))
    return both.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT * FROM (VALUES ('a', '1', 0), ('b', NULL, 0)) AS v(name, value, empty_rows)")
def views_of_values(spark, sf_dir):
    """A view of values beside an empty one, and dropping both."""
    session.values_view(spark, "some_values", ["name", "value"], [("a", 1), ("b", None)])
    session.values_view(spark, "no_values", ["name", "value"], [])
    out = spark.sql("SELECT name, value, CAST((SELECT count(*) FROM no_values) AS INT) AS empty_rows FROM some_values")
    session.drop_view(spark, "some_values"), session.drop_view(spark, "no_values")
    return out


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def view_of_parquet(spark, sf_dir):
    session.parquet_view(spark, "outer_orders", f"{sf_dir}/orders.parquet")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM outer_orders GROUP BY o_orderstatus")


@query()
def explained(spark, sf_dir):
    session.parquet_view(spark, "outer_orders", f"{sf_dir}/orders.parquet")
    return session.explain(spark, "SELECT min(o_totalprice), max(o_totalprice) FROM outer_orders")


@query("SELECT * FROM (VALUES (1000.0, 0.5, 0.1, true, 0.2, false), (2000.0, 1.0, NULL, false, 0.3, true)) AS v(size, input_mb, a_wall, a_best, b_wall, b_best)")
def benchmark_results(spark, sf_dir):
    """Benchmark documents as a table by size and program, with the fastest marked."""
    import json

    from ..sources import tabular

    runs = [(1000, 0.5, "a", 0.1), (1000, 0.5, "b", 0.2), (2000, 1.0, "b", 0.3)]
    doc = {"programs": ["a", "b"], "results": [{"records": n, "input_mb": mb, "program": p, "wall_s": s} for n, mb, p, s in runs]}
    path = f"{_folder(spark)}/results"
    spark.createDataFrame([(json.dumps(doc),)], "value string").write.text(path)
    return tabular.pivot_results(tabular.read_results(spark, path), ["a", "b"]).select("size", "input_mb", "a_wall", "a_best", "b_wall", "b_best")


QUERIES |= relational.QUERIES
ORACLES |= relational.ORACLES
