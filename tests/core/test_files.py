"""Sources, sinks, jobs and the SQL surface on small files."""

import gzip
import random

import pytest

from strandline import cli, generate
from strandline.functions import dna
from strandline.operators import merge, motifs, ssr
from strandline.params import MergeParams, SsrParams
from strandline.plans import session
from strandline.sources import fasta, fastq, registered
from tests.core.test_kernels import random_pair

GOLDEN = "seq1\t0\t12\tAC\t12\t+\t6\tAC\nseq2\t0\t12\tA\t12\t-\t12\tT\n# file: {}\n# total_sequences: 2\n# total_bases: 28\n# gc_pct: 25.00\n"


def write_pairs(tmp_path, pairs, end="\n"):
    paths = []
    for k in (0, 1):
        path = tmp_path / f"r{k + 1}.fq"
        path.write_bytes("".join(f"@r{i}/{k + 1}{end}{p[k][0]}{end}+x{end}{p[k][1]}{end}" for i, p in enumerate(pairs)).encode())
        paths.append(str(path))
    return paths


def test_golden_repeats(spark, tmp_path):
    path = tmp_path / "in.fa"
    path.write_text(">seq1\nACACACACACACGT\n>seq2\nTTTTTTTTTTTTAA\n")
    out = tmp_path / "out.tsv"
    assert cli.main(["ssr", "-i", str(path), "-o", str(out)], spark) == 0
    assert out.read_text() == GOLDEN.format(path)


def test_merge_job_equals_the_model_in_any_blocks(spark, tmp_path):
    rng = random.Random(5)
    pairs = [random_pair(rng) for _ in range(300)]
    one, two = write_pairs(tmp_path, pairs, "\r\n")
    from strandline.operators.merge_kernel import merge_one

    known = lambda s: "".join(c if c in "ACGT" else "N" for c in s.upper())
    merged, left, right = [], [], []
    for i, (a, b) in enumerate(pairs):
        found = merge_one(*a, *b)
        if found:
            merged.append(f"@r{i}\n{found[0]}\n+\n{found[1]}\n")
        else:
            left.append(f"@r{i}/1\n{known(a[0])}\n+\n{a[1]}\n")
            right.append(f"@r{i}/2\n{known(b[0])}\n+\n{b[1]}\n")
    files = session.MergeJob(spark, one, two, output_dir=str(tmp_path / "out")).run()
    assert [f.name for f in files] == ["out.extendedFrags.fastq", "out.notCombined_1.fastq", "out.notCombined_2.fastq"]
    assert [f.read_text() for f in files] == ["".join(x) for x in (merged, left, right)]
    small = fastq.read_pairs(spark, one, two, block=700).orderBy("idx").collect()
    assert [tuple(r) for r in small] == [tuple(r) for r in fastq.read_pairs(spark, one, two).orderBy("idx").collect()] and len(small) == 300
    text = session.merge_text(spark, open(one).read(), open(two).read())
    assert text["status"] == "ok" and text["combined"] == "".join(merged)


def test_strict_and_lenient_reading(spark, tmp_path):
    good = "@a\nacgtu\n+\n@@II!\n"
    path = tmp_path / "x.fq"
    for text in ("a\nAC\n+\nII\n", "@a\nAC\n-\nII\n", "@a\nAC\n+\nI\n", "@a\nAC\n", good + "\n"):
        path.write_text(text)
        with pytest.raises(Exception, match="record|tag|separator|length"):
            fastq.read_fastq(spark, str(path)).collect()
    path.write_text(good)
    assert [tuple(r) for r in fastq.read_fastq(spark, str(path)).collect()] == [(0, "@a", "ACGTN", "@@II!")]
    path.write_text("a\nacu\nx\ny\nb\n")
    assert [tuple(r) for r in fastq.read_fastq(spark, str(path), "lenient").orderBy("idx").collect()] == [(0, "a", "ACU", "y"), (1, "b", "", "")]
    gz = tmp_path / "x.bin"
    gz.write_bytes(gzip.compress(good.encode()))
    assert fastq.read_fastq(spark, str(gz)).count() == 1
    two = tmp_path / "y.fq"
    two.write_text(good * 2)
    with pytest.raises(fastq.FastqError, match="different number"):
        fastq.read_pairs(spark, str(gz), str(two))
    assert fastq.parse_text("\n" + good + "\n\n" + good) == [("@a", "ACGTN", "@@II!")] * 2
    frame = spark.createDataFrame([(1, good * 2)], "k int, text string")
    assert fastq.parse_column(frame).count() == 2


def test_fasta_blocks_and_totals(spark, tmp_path):
    text = "junk\n>a  \nACgt\n\nNNNN\n>\nTTTT\n>b x\nGG GG\n" + "".join(f">s{i}\n{'ACGT' * (i % 7)}\n" for i in range(50))
    path = tmp_path / "x.fa"
    path.write_text(text)
    whole = [tuple(r) for r in fasta.read_fasta(spark, str(path)).orderBy("idx").collect()]
    assert whole[:2] == [(0, "a", "ACGTNNNN"), (2, "b x", "GG GG")] and len(whole) == 52
    assert whole == [tuple(r) for r in fasta.read_fasta(spark, str(path), block=60).orderBy("idx").collect()]
    registered.register(spark)
    assert spark.read.format("fasta").option("path", str(path)).option("block", "60").load().count() == 52
    t = ssr.fasta_totals(spark.createDataFrame([(0, "a", "GGAN"), (1, "b", "")], "idx long, name string, seq string")).first()
    assert tuple(t) == (2, 4, 50.0)
    assert tuple(ssr.fasta_totals(spark.createDataFrame([], "idx long, name string, seq string")).first()) == (0, 0, 0.0)


def test_sql_functions_views_and_formats(spark, tmp_path):
    pairs = [(("ACGTTGCAAC", "I" * 10), ("GTTGCAACGT", "I" * 10)), (("A" * 12, "I" * 12), ("C" * 12, "I" * 12))]
    one, two = write_pairs(tmp_path, pairs)
    job = session.MergeJob(spark, one, two)
    job.create_views()
    q = "SELECT flash_is_combined(tag1,seq1,qual1,tag2,seq2,qual2) ok, flash_combined_tag(tag1,seq1,qual1,tag2,seq2,qual2) tag, flash_combined_seq(tag1,seq1,qual1,tag2,seq2,qual2) seq FROM flash_pairs ORDER BY tag1"
    assert [tuple(r) for r in spark.sql(q).collect()] == [(True, "@r0", "ACGTTGCAAC"), (False, None, None)]
    assert spark.sql("SELECT flash_is_combined(tag1,NULL,qual1,tag2,seq2,qual2) x FROM flash_pairs").first()["x"] is None
    assert [tuple(r) for r in spark.table("flash_combined").collect()] == [("@r0", "ACGTTGCAAC", "I" * 10)]
    assert spark.table("flash_not_combined_left").count() == spark.table("flash_not_combined_right").count() == 1
    registered.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW fq USING fastq_pairs OPTIONS (path '{one}', path2 '{two}')")
    assert spark.sql("SELECT count(*) c FROM fq").first()["c"] == 2
    assert "MapInArrow" in job.annotated()._jdf.queryExecution().toString()
    nulls = spark.createDataFrame([(None, "ACGTTGCAAC", "I" * 10, "b", "GTTGCAACGT", "I" * 10)], "tag1 string, seq1 string, qual1 string, tag2 string, seq2 string, qual2 string")
    assert [x.count() for x in merge.outputs(merge.annotate(nulls))] == [0, 0, 0]


def test_functions(spark):
    tags = {"@r/1": "@r", "@r/1#B": "@r#B", "@r/12#B": "@r", "@a/b c": "@a", "@SEQ1.1": "@SEQ1.1", "@a/b/1#X": "@a/b#X", "@x/": "@x", "@x/#": "@x", "@x/1#": "@x#", "/1": "", "@n#1/2": "@n#1"}
    got = spark.createDataFrame([(t,) for t in tags], "t string").select("t", dna.combined_tag("t").alias("c")).collect()
    assert dict(map(tuple, got)) == tags
    words = [m for m in motifs.classes(SsrParams(1, 3))] + ["ATAT", "GT", "TTT", "CGA"]
    rows = spark.createDataFrame([(w,) for w in words], "m string").select("m", dna.canonical_motif("m").alias("c"), dna.is_atomic("m").alias("a"), dna.rotations("m").alias("r"), dna.expanded("m", 7).alias("e")).collect()
    for r in rows:
        assert (r.c, r.a, r.r, r.e) == (motifs.classified(r.m)[0], motifs.atomic(r.m), motifs.turned(r.m), (r.m * 7)[:7])
    row = spark.sql("SELECT 'aCgtNx!' s, 'I5!' q").select(dna.canonical("s"), dna.phred("q"), dna.gc_count(dna.canonical("s"))).first()
    assert tuple(row) == ("ACGTNNN", [40, 20, 0], 2)


def test_generator_and_fastq_stats(spark, tmp_path):
    rows = generate.read_pairs(spark, 3, 8).orderBy("idx").collect()
    assert (rows[1].seq1, rows[1].seq2, rows[1].tag1, rows[1].qual2) == ("CGTACGTA", "TACGTACG", "@SEQ0000000002.1", "I" * 8)
    with pytest.raises(ValueError):
        generate.read_pairs(spark, 1, 0)
    cli.main(["generate", str(tmp_path / "1.fq"), str(tmp_path / "2.fq"), "--pairs", "20", "--read-length", "30"], spark)
    assert (tmp_path / "1.fq").read_text().splitlines()[:4] == ["@SEQ0000000001.1", ("ACGT" * 8)[:30], "+", "I" * 30]
    cli.main(["merge", str(tmp_path / "1.fq"), str(tmp_path / "2.fq"), "--output-dir", str(tmp_path)], spark)
    assert (tmp_path / "out.extendedFrags.fastq").read_text().count("\n") == 80 and not (tmp_path / "out.notCombined_1.fastq").read_text()
    cli.main(["ssr", "-i", str(tmp_path / "1.fq"), "--format", "fastq", "-o", str(tmp_path / "s.tsv")], spark)
    lines = (tmp_path / "s.tsv").read_text().splitlines()
    assert lines[1:] == ["ACGT\t+\t4\t20\t20\t600\t1000000.0000\t1000000.0000", "# total_reads\t20", "# total_bases\t600"]
    assert cli.default_output("/a/b.fa") == "/a/b_perf.tsv"
    made = ssr.find_ssrs(generate.repeat_sequences(spark, 2, 3000))
    assert made.where("length >= 24").count() >= 6


def test_short_keys_custom_motifs_and_limits(spark):
    seqs = spark.createDataFrame([(0, "a", "ACGACGACGNTTTTTTTT"), (1, "b", None), (2, "c", "ACACACAC")], "idx long, name string, seq string")
    p = SsrParams(1, 4, 6, motifs=("acac", "ACG"))
    assert [tuple(r)[1:] for r in ssr.find_ssrs(seqs, p).orderBy("idx", "start").collect()] == [("a", 0, 9, "ACG", 9, "+", 3, "ACG"), ("c", 0, 8, "ACAC", 8, "+", 2, "ACAC")]
    assert ssr.find_ssrs(seqs, SsrParams(1, 2, 8, min_seq_len=9)).count() == 1
    assert ssr.find_ssrs(seqs, SsrParams(1, 2, 8, max_seq_len=8, min_units={2: 5})).count() == 0
    assert tuple(ssr.read_totals(seqs, SsrParams(min_seq_len=9)).first()) == (1, 18)
    assert ssr.overlap_filter(ssr.find_ssrs(seqs, SsrParams(1, 2, 8))).count() == 2


def test_streaming_merge(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandline.streaming import reads

    pairs = generate.read_pairs(spark, 10, 20).withColumn("ts", F.timestamp_seconds(F.col("idx") * 60))
    pairs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in"))
    q = reads.merge_rates(reads.merge_stream(stream, MergeParams())).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(pairs) p, sum(merged) m, count(*) n FROM rates").first() == (10, 10, 2)


def test_blocks_of_any_size_give_the_same_records(spark, tmp_path):
    """The reader by arrays against the one by lines, in blocks that begin anywhere, with and without a last newline."""
    from strandline.sources import files

    rng = random.Random(7)
    for end in ("\n", "\r\n"):
        reads = [(f"@t{i} @x", "".join(rng.choice("acgtNX") for _ in range(n)), "@" * n) for i, n in enumerate(rng.choices(range(1, 30), k=40))]
        text = end.join(x for t, s, q in reads for x in (t, s, "+", q))
        for tail in ("", end):
            path = tmp_path / "a.fq"
            path.write_bytes((text + tail).encode())
            for size in (3, 17, 64, 1000, 1 << 20):
                found = files.index(None, str(path), size)
                by_line = [r for b in found.blocks for r in fastq.records(b)]
                by_array = [tuple(r.values()) for b in found.blocks for x in fastq.strict_batches(b, 33) for r in x.to_pylist()]
                assert by_line == by_array and len(by_line) == 40, (end, tail, size)
                pairs = [tuple(r.values()) for b, m in zip(found.blocks, fastq.mates(found, files.index(None, str(path), 50)), strict=True) for x in fastq.paired_batches(b, m, 33) for r in x.to_pylist()]
                assert pairs == [(*r, *r[1:]) for r in by_line]
    assert all(fastq._arrays(b, 33) is not None for b in files.index(None, str(path), 64).blocks)


def test_sharded_sink_typed_pairs_and_output_checks(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandline.operators import asof, compare
    from strandline.sources import sinks

    pairs = generate.read_pairs(spark, 50)
    reads = pairs.selectExpr("idx", "tag1 AS tag", "seq1 AS seq", "qual1 AS qual")
    nulls = reads.withColumn("seq", F.when(F.col("idx") != 3, F.col("seq")))
    sinks.write_shards(nulls, str(tmp_path / "shards"))
    parts = sorted(str(p) for p in (tmp_path / "shards").glob("part-*"))
    back = fastq.read_fastq(spark, parts)
    assert back.count() == 49 and [r.tag for r in back.orderBy("idx").collect()] == [r.tag for r in reads.where("idx <> 3").orderBy("idx").collect()]
    assert compare.multiset_difference(back, reads, ["tag", "seq", "qual"]).count() == 1
    assert compare.out_of_order(back, reads, "tag").count() == 0
    one = pairs.first()
    got = merge.merge_pair((one.tag1, one.seq1, one.qual1), (one.tag2, one.seq2, one.qual2))
    assert got.is_combined and got.seq == one.seq1 and merge.merge_pair(("@a", "ACGT", "IIII"), ("@a", "ACGT", "IIII")) == merge.Merged(False)
    with pytest.raises(ValueError):
        merge.merge_pair(("@a", "ACG", "IIII"), ("@a", "ACGT", "IIII"))
    a = spark.createDataFrame([("x", 1, "p"), ("x", 5, "q"), (None, 5, "r"), ("y", None, "s"), ("y", 3, "t")], "k string, at int, name string")
    b = spark.createDataFrame([("x", 1, 10), ("x", 4, 40), ("x", 4, 41), ("y", 9, 90), (None, 1, 7)], "k string, at int, v int")
    joined = lambda strict: {r["name"]: r.v for r in asof.asof_join(a, b, "at", ["k"], strict, "v").collect()}
    assert joined(False) == {"p": 10, "q": 41, "r": None, "s": None, "t": None} and joined(True)["p"] is None


def test_rows_out_of_order_are_the_same_in_many_ranges(spark):
    """Bounds of ranges are sampled: rows dealt to ranges twice would look back at other rows."""
    from pyspark.sql import functions as F

    from strandline.operators import compare

    n, moved = 40000, 7
    source = spark.range(n).select(F.col("id").alias("key"), F.col("id").alias("idx"))
    output = source.withColumn("idx", F.col("key") + F.when(F.col("key") % 100 == moved, 50.5).otherwise(0.0))
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in compare.out_of_order(output, source, "key").collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [(k, k, k + 50) for k in range(moved, n, 100)]


def test_small_blocks_share_tasks_and_large_ones_are_read_in_pieces(spark, tmp_path, monkeypatch):
    import tracemalloc

    from strandline.sources import files

    rng = random.Random(3)
    pairs = [random_pair(rng) for _ in range(300)]
    one, two = write_pairs(tmp_path, pairs)
    cores = spark.sparkContext.defaultParallelism
    for frame in (fastq.read_fastq(spark, one, block=100), fastq.read_pairs(spark, one, two, block=100)):
        assert frame.rdd.getNumPartitions() <= cores
        assert [r.idx for r in frame.collect()] == list(range(300))
    whole, mate = files.index(None, one).blocks[0], files.index(None, two)
    by_line = [(*a, *b[1:]) for a, b in zip(fastq.records(whole), fastq.records(mate.blocks[0]), strict=True)]
    for piece in (1, 40, 333, 5000):
        monkeypatch.setattr(fastq, "_PIECE", piece)
        for block in (777, 1 << 25):
            found = files.index(None, one, block)
            mates = fastq.mates(found, files.index(None, two, 900))
            assert [tuple(r.values()) for b, m in zip(found.blocks, mates, strict=True) for x in fastq.paired_batches(b, m, 33) for r in x.to_pylist()] == by_line
    monkeypatch.undo()
    big = tmp_path / "big.fq"
    big.write_text(f"@x\n{'ACGT' * 25}\n+\n{'I' * 100}\n" * 40000)
    block = files.index(None, str(big)).blocks[0]
    tracemalloc.start()
    n = sum(b.num_rows for b in fastq.paired_batches(block, block, 33))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40000 and peak < 48 << 20


def test_null_reads_are_dropped_where_they_are_made_once(spark, tmp_path, monkeypatch):
    from strandline.sources import sinks

    made = spark.range(100).repartitionByRange(5, "id").sortWithinPartitions("id").selectExpr("concat('@', id) AS tag", "if(id % 9 = 1, null, repeat('A', int(id % 5))) AS seq", "repeat('I', int(id % 5)) AS qual")
    path = sinks.write_fastq(made, tmp_path / "x.fq", [])
    assert path.read_text().split("\n")[:-1:4] == [f"@{i}" for i in range(100) if i % 9 != 1]
    seen = []
    monkeypatch.setattr(sinks, "write_lines", lambda df, *_: seen.append(df._jdf.queryExecution().optimizedPlan().toString()))
    sinks.write_fastq(made, tmp_path / "y.fq", [])
    assert "Filter" in seen[0].split("RepartitionByExpression")[0] and "Filter" not in seen[0].split("RepartitionByExpression")[1]
