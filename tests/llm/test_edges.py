"""Repeated ids, texts of megabytes, clashing columns, ties, and the pipeline's edges; with models where they are cheap."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import common as C
from strandline.llm import ctw, fingerprints, language_id, line_dedup, mixing, near_dedup, packing, quality, secrets, substring_dedup
from tests.llm.test_small import SCHEMA, WORD, WORDS, lines_model

CLASH = [f"'u' AS {c}" for c in ("__row", "__id", "__text", "__gone", "__key", "__size", "__spans", "__k", "__s")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) + rng.choice(["", "", "", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Three rows of one id (two the same text), two without id, one text of three megabytes, and short ones."""
    rng = random.Random(12)
    long, twice = prose(rng, 400_000), prose(rng, 300)
    out = [(5, twice), (5, twice), (5, prose(rng, 200)), (None, prose(rng, 100)), (None, "\n".join([prose(rng, 30)] * 2)), (7, long), (8, twice), (9, "x"), (10, "")]
    return [(i, t, "en", "a", len(t)) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars").cache()
    df.count()
    return df


def test_repeated_ids_and_long_texts(spark, docs, rows):
    ids = Counter(r[0] for r in rows)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    found = {
        "lines": line_dedup.dedup_lines(docs, digests=True),
        "lm": ctw.score(docs, depth=2),
        "secrets": secrets.scan(docs),
        "mix": mixing.mix_report(docs),
        "near": near_dedup.near_classes(docs),
        "language": language_id.identify(docs),
        "spans": substring_dedup.drop_spans(docs, report=True),
        "quality": quality.judge(docs, labels),
        "prints": fingerprints.compare_with_next(docs, range_rows=2),
    }
    found = {k: df.collect() for k, df in found.items()}
    for k, got in found.items():
        assert Counter(r.doc_id for r in got) == ids, k
    near = [(r.doc_id, r.class_id, r.class_size) for r in found["near"]]
    assert near.count((5, 5, 3)) == 2 and near.count((8, 5, 3)) == 1 and (5, 5, 1) in near
    assert sorted((r["size"], r.taken) for r in found["mix"] if r.doc_id == 7) == [(len(WORD.findall(rows[5][1])),) * 2]
    assert {r.n_chars for r in found["prints"] if r.doc_id == 5} == {len(rows[0][1]), len(rows[2][1])}
    packed = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == ids and max(r.length for r in packed) == 1024
    assert sum(r.n_removed > 0 for r in found["spans"]) >= 1 and all(r.n_removed == 0 for r in found["spans"] if r.doc_id == 5 and r.text == rows[0][1])


def test_columns_of_any_name_pass(spark, docs):
    few = docs.where("n_chars < 100000").selectExpr("*", *CLASH)
    for run in (line_dedup.dedup_lines, near_dedup.drop_near, mixing.mixed_documents, substring_dedup.drop_spans, language_id.keep_known, secrets.redact):
        got = run(few)
        assert got.columns == few.columns, run
        assert {tuple(r[len(SCHEMA.split(", ")) :]) for r in got.collect()} == {("u",) * len(CLASH)}, run


def test_short_rows_stay_small_in_memory():
    texts = [f"w{i} and some few words {i}" for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(range(1000)), pa.array(texts)], names=["__row", "doc_id", "text"])
    tracemalloc.start()
    assert sum(b.num_rows for b in near_dedup._elements(iter([batch]), 5)) == 1000 == sum(b.num_rows for b in near_dedup._signed(iter([batch]), 5, 20, 4))
    peak = tracemalloc.get_traced_memory()[1]
    language_id.Model({"en": language_id.ngrams(["the and of"])[0].tolist()}).predict([chr(0x4E00 + i % 9000) * 3 + chr(0x4E00 + i * 7 % 9000) for i in range(1000)])
    assert max(peak, tracemalloc.get_traced_memory()[1]) < 120e6
    tracemalloc.stop()


def test_random_inserts_and_deletes_equal_a_new_build(spark):
    rng = random.Random(4)
    line = lambda k: f"line number {k} that is long enough to count as one of many"
    text = lambda: "\n".join(line(rng.randint(0, 6)) for _ in range(3))
    held = {i: text() for i in range(8)}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "doc_id long, text string")
    index = line_dedup.LineIndex.of(frame(held), min_docs=3)
    for step in range(3):
        if step % 2:
            gone = rng.sample(sorted(held), 4)
            held = {i: t for i, t in held.items() if i not in gone}
            index = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        else:
            new = {20 * (step + 1) - i: text() for i in range(4)}
            held |= new
            index = index.insert(frame(new))
        own = {(r.k1, r.k2): (r.n_docs, r.last_doc) for r in index.refs.collect()}
        fresh = {(r.k1, r.k2): (r.n_docs, r.last_doc) for r in line_dedup.LineIndex.of(frame(held), min_docs=3).refs.collect()}
        assert own == fresh, step
    want = {(i, k) for i, t in held.items() for k in {*t.split("\n")} if sum(k in x.split("\n") for x in held.values()) >= 3 and max(j for j, x in held.items() if k in x.split("\n")) != i}
    assert index.drops().distinct().count() == len(want) > 0


def test_likeness_is_the_share_of_equal_leaves():
    rng = random.Random(3)
    leaves = lambda t: Counter(p for x in t.split("\n") for p in fingerprints.pieces_of(x)) if t else Counter()
    for _ in range(60):
        lines = [prose(rng, rng.randint(1, 40)).replace("\n", " ") for _ in range(rng.randint(1, 40))]
        other = list(lines)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(other))
            other[k : k + 1] = rng.choice([[], [other[k], other[k]], [prose(rng, 12).replace("\n", " ")], [other[k][::2]]])
            other = other or ["x"]
        one, two = "\n".join(lines), "\n".join(other)
        a, b = leaves(one), leaves(two)
        assert "".join(fingerprints.pieces_of(lines[0])) == lines[0]
        want = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
        assert fingerprints.likeness(*map(fingerprints.fingerprint, (one, two))) == pytest.approx(want)
    prints = {fingerprints.fingerprint(t) for t in ("a", "a\n", "\na", "a\n\n", "", "\n", "a ", " a")}
    assert len({x.split(";")[0] for x in prints}) == 8


def test_rows_of_one_id_are_split_over_ranges():
    rng = np.random.default_rng(1)
    ids, hashes = rng.integers(0, 4, 500), rng.integers(-50, 50, 500)
    keys = sorted(zip(ids.tolist(), hashes.tolist(), strict=True))
    bounds = [keys[i] for i in (40, 41, 90, 200, 201, 350, 480)]
    want = [sum(b < k for b in bounds) for k in zip(ids.tolist(), hashes.tolist(), strict=True)]
    assert fingerprints.range_index(bounds, ids, hashes).tolist() == want


def test_local_search_over_many_bins_ends():
    rng = random.Random(2)
    counts = Counter({n: c * 1000 for n, c in Counter(rng.choices(range(20, 1025), k=3000)).items()})
    done = packing.plan(counts)
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert least <= done.count() <= 1.02 * least


def test_language_ties_go_by_name():
    key = language_id.ngrams(["ab"])[0].tolist()
    model = language_id.Model({"b": key, "a": key})
    assert model.predict(["ab", "zz"])[:2] == (["a", "a"], [0.0, 0.0])


def test_pipeline_twice_empty_and_with_other_columns(spark, rows, tmp_path):
    import corpus_pipeline

    def at(name, df):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        return str(tmp_path / name)

    some = spark.createDataFrame([r for r in rows if r[4] < 100_000], SCHEMA)
    where = at("a", some.drop("n_chars").selectExpr("*", "1 AS __row", "2 AS key"))
    one, two = corpus_pipeline.run(spark, where), corpus_pipeline.run(spark, at("b", some))
    assert one.count() == two.count() > 0
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert corpus_pipeline.run(spark, at("c", some.limit(0))).count() == 0
    assert lines_model(["a"])[0][0] == 1 and C.shared_dir(spark)
