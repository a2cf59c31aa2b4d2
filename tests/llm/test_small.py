"""Each text operator against brute force, and on nulls, empties, repeats, empty tables and extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from strandline.llm import common as C
from strandline.llm import ctw, fingerprints, language_id, line_dedup, mixing, near_dedup, packing, quality, secrets, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = "alpha beta gamma delta stone river cloud winter garden silver paper candle".split()


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def frame(spark, texts, extra=False):
    rows = [(None if t == "NULLID" else i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "'x' AS node", "1 AS key", "'y' AS n_lines", "2 AS size", "0.5 AS score", "'z' AS stratum") if extra else df


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    sentence = lambda: (" ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.randint(3, 14))) + rng.choice([".", ".", "!", "?"])).capitalize()
    out = ["\n".join(" ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    shared = "  A line that is long enough to be counted as SHARED by many  "
    passage = " ".join(sentence() for _ in range(9))
    for i in range(12):
        out[i] += "\n" + shared.swapcase() if i % 2 else "\n" + shared
    for i in (20, 25, 30):
        out[i] = out[i][:40] + " " + passage + " " + out[i]
    big = " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(300))
    for i in range(40, 48):
        w = big.split()
        w[rng.randrange(300)] = f"edit{i}"
        out[i] = " ".join(w)
    out[50] = out[51]
    return [*out, None, "", "   \n \t", "NULLID", out[51], "word " * 30, "z" * 20000, "Ünïcödé straße — №1\nno break"]


# ---- 1 ----


def lines_model(texts):
    keys = lambda t: [low(x.strip(C.WHITE)) for x in (t or "").split("\n")]
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for k in keys(t):
            if len(k) >= 40:
                holders[k].add(-1 if t == "NULLID" else i)
    out = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if len(k) < 40 or len(holders[k]) < 5 or max(holders[k]) == i]
        out[None if t == "NULLID" else i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup(spark, texts):
    got = {r[0]: tuple(r)[1:] for r in line_dedup.dedup_lines(frame(spark, texts, True), digests=True).collect()}
    assert got == lines_model(texts) and sum(x[1] for x in got.values()) == 11
    whole = line_dedup.dedup_lines(frame(spark, texts))
    assert whole.columns == [c.split()[0] for c in SCHEMA.split(", ")] and whole.where("text IS NULL").count() == 1
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA), digests=True).count() == 0


def test_line_index_is_reversible(spark, texts):
    half = texts[:8]
    one = line_dedup.LineIndex.of(frame(spark, half))
    more = one.insert(spark.createDataFrame([(i, texts[i]) for i in range(8, 12)], "doc_id long, text string"))
    def dropped(x):
        return {r["doc_id"] for r in x.drops().collect()}

    assert dropped(one) == set(range(7)) and dropped(more) == set(range(11))
    back = more.delete(spark.createDataFrame([(i,) for i in range(8, 12)], "doc_id long"))
    assert dropped(back) == set(range(7))
    assert dropped(back.delete(spark.createDataFrame([(i,) for i in range(4)], "doc_id long"))) == set()


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    k = rng.integers(-(2**63), 2**63 - 1, (4000, 2))
    f = line_dedup.built(k[:, 0], k[:, 1])
    assert f.contains(k[:, 0], k[:, 1]).all()
    other = rng.integers(-(2**63), 2**63 - 1, (20000, 2))
    assert f.contains(other[:, 0], other[:, 1]).mean() < 0.002
    f.delete(k[:2000, 0], k[:2000, 1])
    assert f.contains(k[2000:, 0], k[2000:, 1]).all() and f.contains(k[:2000, 0], k[:2000, 1]).mean() < 0.01
    assert line_dedup.CuckooFilter.load(f.dump()).contains(k[2000:, 0], k[2000:, 1]).all()


# ---- 2 ----


def ctw_model(train, depth):
    """Sequential context-tree weighting, bit by bit, as in the textbook; returns a scorer of the model at its end."""
    n = defaultdict(lambda: [0, 0])
    stream = lambda t: "\n" * depth + t + "\n"
    contexts = set()
    for t in train:
        b = stream(t).encode()
        for i in range(depth, len(b)):
            for d in range(depth + 1):
                c = b[i - d : i]
                contexts.add(c)
                node = 1
                for k in range(7, -1, -1):
                    bit = b[i] >> k & 1
                    n[c, node][bit] += 1
                    node = node * 2 + bit
    lg = math.lgamma
    kt = lambda c, node: lg(n[c, node][0] + 0.5) + lg(n[c, node][1] + 0.5) - lg(sum(n[c, node]) + 1) - math.log(math.pi) if (c, node) in n else 0.0
    children = defaultdict(list)
    for c in contexts:
        if c:
            children[c[1:]].append(c)
    memo = {}

    def weighted(c, node):
        if (c, node) not in memo:
            own = kt(c, node)
            if len(c) == depth:
                memo[c, node] = own
            else:
                below = sum(weighted(x, node) for x in children[c] if (x, node) in n)
                memo[c, node] = math.log(0.5) + np.logaddexp(own, below)
        return memo[c, node]

    def bit_p(ctx, node, bit):
        p = None
        for d in range(depth, -1, -1):
            c = ctx[depth - d :]
            z = n[c, node] if (c, node) in n else [0, 0]
            here = (z[bit] + 0.5) / (sum(z) + 1)
            if p is None:
                p = here
            else:
                below = sum(weighted(x, node) for x in children[c] if (x, node) in n)
                w = 1 / (1 + math.exp(min(700, below - kt(c, node))))
                p = w * here + (1 - w) * p
        return p

    def score(t):
        b, total = stream(t).encode(), 0.0
        for i in range(depth, len(b)):
            node = 1
            for k in range(7, -1, -1):
                bit = b[i] >> k & 1
                total += math.log10(bit_p(b[i - depth : i], node, bit))
                node = node * 2 + bit
        return total

    return score


def test_language_model_equals_the_textbook(spark, texts):
    few = [t[:120] if t and t != "NULLID" else t for t in texts[:14] + texts[60:66]]
    ids = [None if t == "NULLID" else i for i, t in enumerate(few)]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i in ids]
    words = [WORD.findall(low(t or "")) for t in few]
    c = Counter()
    for w, h in zip(words, held, strict=True):
        if not h:
            c.update([*w, "\n"])
    N, V = sum(c.values()), len(c)
    model = ctw_model([" ".join(w) for w, h in zip(words, held, strict=True) if not h], 3)
    got = {r.doc_id: r for r in ctw.score(frame(spark, few, True), depth=3, packet_mb=0.0005).collect()}
    assert len(got) == len(few)
    for i, w, h in zip(ids, words, held, strict=True):
        r, tokens = got[i], [*w, "\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(tokens), sum(c[x] > 0 for x in tokens), N)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (N + V + 1)) for x in tokens))
        assert r.score == pytest.approx(model(" ".join(w)), rel=1e-9)
    assert ctw.score(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = ctw.score(spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "ab")], "doc_id long, text string")).first()
    assert alone.base_score == 0 and alone.train_tokens == 0 and alone.score == pytest.approx(3 * 8 * math.log10(0.5))


def test_language_model_beats_single_tokens_on_held_out_texts(spark):
    scored = ctw.score(C.read(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")).where("held_out")
    r = scored.selectExpr("sum(score) AS score", "sum(base_score) AS base", "max(score) AS most").first()
    assert 0.95 * r.base < r.score < 0 and r.most < 0


def test_language_model_rejects_keys_that_would_be_negative(spark, texts):
    with pytest.raises(ValueError):
        ctw.score(frame(spark, texts[:3]), depth=7)


def test_scoring_looks_keys_up_in_order(texts, monkeypatch):
    own = [" ".join(t.split()).lower().encode() for t in texts if t]
    blob = zstandard.ZstdCompressor().compress(b"\n".join(own))
    packet = pa.RecordBatch.from_pydict({"packet": [0], "ids": [list(range(len(own)))], "held": [[False] * len(own)], "blob": [blob]})
    found = pa.Table.from_batches(ctw._features(iter([packet]), 3, 1))
    values = found.drop_columns(["packet", "g"]).rename_columns(["keys", "values"])
    asked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **y: asked.append(v) or search(a, v, *x, **y))
    got = ctw._scored(pa.Table.from_batches([packet]), values, 3, 10, 5)
    monkeypatch.undo()
    assert max(map(len, asked)) > 1000 and all((np.diff(np.asarray(v)) >= 0).all() for v in asked)
    counts = Counter(own_run for t in own for own_run in runs_model(t, 3))  # the values are the counts here
    for t, row in zip(own, got.to_pylist(), strict=True):
        assert row["score"] == sum(counts[x] for x in runs_model(t, 3)) / -ctw._UNIT and row["n_bytes"] == len(t) + 1


def runs_model(text, depth):
    full = b"\n" * depth + text + b"\n"
    return [full[i : i + depth + 1] for i in range(len(text) + 1)]


# ---- 3 ----


def test_secret_scan(spark):
    key = "AKIA" + "Q7" * 8
    rand = "x9Kq2ZpL7vTr4WnB8sYd3HfG"
    text = f"token = \"abcdefABCDEF1234\" é {key} deadbeefdeadbeef00 secret: short PassWord=token=aaaaaaaaaaaa {rand} snake_case_name_is_long_enough 123456789012345678901234 {hashlib.sha1(b'x').hexdigest().upper()} 123e4567-e89b-12d3-a456-426614174000"
    base = secrets.base_spans(text)
    assert [(k, text[s:e]) for s, e, k in base] == [("assign", 'token = "abcdefABCDEF1234'), ("access", key), ("hex", "deadbeefdeadbeef00"), ("assign", "PassWord=token=aaaaaaaaaaaa"), ("hex", "123456789012345678901234")]
    assert [text[s:e] for s, e, _ in secrets.random_spans(text, base)] == [rand]
    model = []
    for kind, pattern, ok in (("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16)):
        model += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if ok(m)]
    assert base == secrets.in_order(model)
    rows = {r.doc_id: r for r in secrets.scan(frame(spark, [text, None, "", "token: secret: abcdefghijkl"], True)).collect()}
    assert (rows[0].n_assign, rows[0].n_access, rows[0].n_hex, rows[0].n_random) == (2, 1, 2, 1)
    assert rows[0].base_sha256 == hashlib.sha256(secrets.told(base).encode()).hexdigest() and f"random:{text.index(rand)}:" in rows[0].spans
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[3].n_assign == 0 and rows[1].spans == ""
    assert rand not in secrets.redact(frame(spark, [text])).first().text
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_random_letters_of_one_case_are_no_identifiers():
    rng = random.Random(3)
    alone = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(200)]
    for form in (str, str.upper, lambda x: "ghp_" + x, lambda x: "-".join(x[i : i + 6] for i in range(0, 24, 6))):
        assert sum(secrets.is_random(form(x)) for x in alone) >= 198
    for x in ("snake_case_name_is_long_enough", "internationalization", "CamelCaseNamesOfClasses", "MAX_NUMBER_OF_CONNECTIONS_2", "src/main/resources/application-settings"):
        assert not secrets.is_random(x), x


def test_random_parts_of_runs():
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    found = lambda text: [text[s:e] for s, e, _ in secrets.random_spans(text, secrets.base_spans(text))]
    forms = ("/application/configuration/production/access_key={}", "/store/deadbeefdeadbeef00/{}/objects", "id_123e4567-e89b-12d3-a456-426614174000-{}", "see {}.")
    for form in forms:
        for n in (12, 16, 24):
            keys = [some(n) for _ in range(100)]
            assert sum(any(k in x for x in found(form.format(k))) for k in keys) >= 97, (form, n)
    for text in ("/application/configuration/production/access_key=", "id_123e4567-e89b-12d3-a456-426614174000", "/store/deadbeefdeadbeef00/objects/list", "MULTIPROCESSING Zusammenarbeit STORE_SUBSCR"):
        assert not found(text), text


# ---- 4 ----


def mix_model(docs, block, seed):
    """Words taken of each (doc_id, text, source), one block and one slot at a time; the draws are the operator's own."""
    streams = defaultdict(list)
    for i, t, source in docs:
        streams[source] += [i] * len(WORD.findall(t or ""))
    order = sorted({x[2] for x in docs}, key=lambda x: (x is None, x or ""))
    target = mixing.targets({x: len(streams[x]) for x in order})
    blocks = [-(-len(streams[x]) // block) for x in order]
    quotas = np.array([min(3 * n, target[x] * n / len(streams[x])) if n else 0 for x, n in zip(order, blocks, strict=True)])
    total, width, taken, at = round(quotas.sum()), max(mixing.SHARD_SLOTS, len(order)), Counter(), Counter()
    for run in range(-(-total // (mixing.RUN * width))):
        for row in mixing.shard_counts(quotas, mixing.run_slots(run, total, width), seed, run):
            for s, n in enumerate(row):
                for _ in range(n):
                    turn, place = divmod(at[s], blocks[s])
                    at[s] += 1
                    if turn < 3:
                        b = mixing.permuted(np.array([place]), blocks[s], (seed * 1_000_003 + s) * 64 + turn)[0]
                        taken.update(streams[order[s]][b * block : (b + 1) * block])
    return taken


def test_mixing(spark, texts):
    assert mixing.targets({"a": 100, "b": 10, None: 90}) == {"a": 42.5, "b": 30.0, None: 127.5}
    docs = [t for t in texts[:60] for _ in range(3)] + [None, ""]
    rows = mixing.mix_report(frame(spark, docs, True), block=16).collect()
    by = defaultdict(list)
    for r in rows:
        assert r.taken <= 3 * r["size"] and r["size"] == len(WORD.findall(docs[r.doc_id] or ""))
        by[r.target].append(r)
    assert sum(by) == pytest.approx(sum(r["size"] for r in rows))
    for target, own in by.items():  # one run of shards: off by a shard's draw, four deviations of it at most
        assert abs(sum(r.taken for r in own) - target) <= 16 * (4 * mixing.SHARD_SLOTS**0.5 / 2 + 2) and sum(r["size"] for r in own) == own[0].source_size
    again = mixing.mix_report(frame(spark, docs).repartition(3, "n_chars"), block=16).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    model = mix_model([(i, t, ["a", "b", None][i % 3]) for i, t in enumerate(docs)], 16, mixing.SEED)
    assert {r.doc_id: r.taken for r in rows if r.taken} == dict(model)
    written = mixing.mixed_documents(frame(spark, docs), block=16).collect()
    words = Counter()
    for r in written:
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.text in docs[r.doc_id] and r.n_chars == len(r.text)
    assert {r.doc_id: r.taken for r in rows if r.taken} == dict(words)
    shards = mixing.mixed_shards(frame(spark, docs).selectExpr("*", "7 AS __row"), block=16).collect()
    slots = defaultdict(int)
    for r in shards:
        slots[r.shard, r.slot] += len(WORD.findall(r.text))
        assert r["__row"] == 7 and r.slot < mixing.SHARD_SLOTS
    assert max(slots.values()) <= 16 and sum(slots.values()) == sum(words.values())
    assert mixing.mix_report(spark.createDataFrame([], SCHEMA)).count() == 0 and mixing.mixed_shards(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_of_the_mix_are_not_broadcast(spark, texts):
    rows, slots, _ = mixing.mix_sources(frame(spark, [t for t in texts if t]), block=4)
    rows = C.materialize(rows, "mix-test")
    for uses in (slots, mixing.used(slots)):
        taken = mixing.taken_blocks(rows, uses, block=4)
        assert taken.count() and "Broadcast" not in taken._jdf.queryExecution().executedPlan().toString()


def test_rows_of_the_mix_are_not_broadcast(spark, texts):
    docs = frame(spark, texts)
    for mix in (mixing.mix_report(docs, block=4), mixing.mixed_documents(docs, block=4), mixing.mixed_shards(docs, block=4)):
        plan = mix._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [__row#" in plan and "BroadcastHashJoin [__row#" not in plan


def test_draws_decide_the_mix(spark, texts):
    """Another seed gives other counts by source; no document is taken more than three times, whatever is drawn."""
    docs = frame(spark, [t for t in texts[:60] for _ in range(5)])
    sums = set()
    for seed in (1, 2, 3):
        rows = mixing.mix_report(docs, block=8, seed=seed).collect()
        assert all(r.taken <= 3 * r["size"] for r in rows)
        by = Counter()
        for r in rows:
            by[r.target] += r.taken
        sums.add(tuple(sorted(by.items())))
    assert len(sums) == 3
    for n in (1, 2, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))
    counts = mixing.shard_counts(np.array([5.0, 0.0, 100.0]), np.full(70, 256))
    assert (counts.sum(axis=1) == 256).all() and counts.min() >= 0 and not counts[:, 1].any()
    assert abs(counts[:, 0].sum() - 70 * 256 * 5 / 105) < 4 * (256 * 5 / 105) ** 0.5
    one = np.array([mixing.shard_counts(np.array([1.0, 3.0]), np.array([64]), seed)[0, 0] for seed in range(400)])
    assert abs(one.mean() - 16) < 1 and 8 < one.var() < 16  # a binomial's: 12


# ---- 5 ----


def near_model(texts):
    sets = []
    for t in texts:
        w = WORD.findall(low(t or ""))
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both, any_ = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if any_ and both >= 0.8 * any_ and find(i) != find(j):
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_near_dedup(spark, texts):
    got = near_dedup.near_classes(frame(spark, texts, True)).collect()
    want = near_model(texts)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == {i: c for i, c in enumerate(want) if texts[i] != "NULLID"}
    assert max(r.class_size for r in got) == 8
    stay = near_dedup.drop_near(frame(spark, texts))
    assert stay.count() == len(set(want)) and len(stay.columns) == 5
    assert near_dedup.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_over_many_tasks(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    rng.shuffle(links)
    root = {x: x for a, b in links if a != b for x in (a, b)}
    while any(root[a] != root[b] for a, b in links if a != b):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        got = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.node, r.label) for r in got) == sorted(root.items())
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_near_dedup_of_a_large_group_with_outsiders(spark, monkeypatch):
    """Copies of one text, some beyond the similarity; blocks far smaller than the group must find the same links."""
    rng = random.Random(2)
    base = [rng.choice(WORDS) + str(rng.randint(0, 9999)) for _ in range(200)]
    out = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 6, 8])):
            w[rng.randrange(200)] = f"e{rng.randint(0, 10**9)}"
        out.append(" ".join(w))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    assert [r.class_id for r in near_dedup.near_classes(frame(spark, out)).orderBy("doc_id").collect()] == near_model(out)


def test_sketches_lose_few_links():
    """Exact binomial tails at the similarity itself, of the part and of the whole sketch, whose places agree with chance 0.8."""
    lost = lambda k: sum(math.comb(k, i) * 4**i for i in range(near_dedup._least(k, 0.8))) / 5**k
    assert lost(near_dedup.SKETCH) < 1e-6 and lost(near_dedup.PART) < 1e-8


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    values = C.mix(np.arange(400, dtype=C.U64))
    a, b = rng.uniform(0, 9, 400), rng.uniform(0, 9, 400)
    b[:250] = a[:250]
    at = np.array([0, 400, 800])
    sig = near_dedup.signatures(np.concatenate((values, values)), np.concatenate((a, b)), at, 2048)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / 2048) ** 0.5
    assert (near_dedup.signatures(values[:1], np.ones(1), np.array([0, 1, 1]), 80)[1] == 0).all()


# ---- 6 ----


def test_language_id(spark):
    rng = random.Random(6)
    sound = {"en": "the and tion ing of er th".split(), "de": "der die und sch ung ein ch".split(), "es": "los que ción ado en ñ ar".split()}
    rows = []
    for i in range(240):
        lang = list(sound)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(sound[lang]) for _ in range(rng.randint(1, 3))) for _ in range(40)), lang if i % 7 else None, "s", 0))
    rows += [(None, "THE and THE", None, "s", 0), (900, None, "en", "s", 0), (901, "12 34 !?", "en", "s", 0), (902, "", "de", "s", 0), (903, "жщю жщю", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language_id.identify(docs.selectExpr("*", "1 AS key")).collect()}
    for i, text, lang, *_ in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 4 == 2) and 0 <= r.score <= 1
        if text is None or not any(c.isalpha() for c in text):
            assert r.lang_pred == "und"
        elif lang:
            assert r.lang_pred == lang
    assert {r.doc_id for r in language_id.keep_known(docs).collect()} == {r[0] for r in rows} - {900, 901, 902, 903}
    key, owner = language_id.ngrams(["Ab c", "", "d"])
    told = lambda k: "".join("_" if x == 1 else chr(x - 2) for x in (k & (2**21 - 1), k >> 21 & (2**21 - 1), k >> 42) if x)
    found = [sorted(told(int(k)) for k in key[owner == i]) for i in range(3)]
    assert found == [sorted(["a", "b", "c", "_a", "ab", "b_", "_c", "c_", "_ab", "ab_", "_c_"]), [], sorted(["d", "_d", "d_", "_d_"])]
    assert language_id.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    assert language_id.identify(spark.createDataFrame([(1, "abc", None, "s", 3)], SCHEMA)).first().lang_pred == "und"


# ---- 7 ----


def spans_model(texts, least):
    pieces = []
    for t in texts:
        first, _, _, words = substring_dedup.sentences([(t or "").encode()])
        pieces.append([tuple(words[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)])
    held = defaultdict(list)
    for i, p in enumerate(pieces):
        for s in range(len(p)):
            run, e = (), s
            while e < len(p) and len(run) < least:
                run, e = run + p[e], e + 1
            if len(run) >= least:
                held[run].append((texts[i] == "NULLID", i, s, e))
    gone = defaultdict(set)
    for places in held.values():
        for _, i, s, e in sorted(places)[1:]:
            gone[i] |= set(range(s, e))
    return [len(p) for p in pieces], gone


def test_substring_dedup(spark, texts):
    got = {r.doc_id: r for r in substring_dedup.drop_spans(frame(spark, texts, True), report=True).collect()}
    sizes, gone = spans_model(texts, 20)
    for i, t in enumerate(texts):
        r = got[None if t == "NULLID" else i]
        assert (r.n_sentences, r.n_removed) == (sizes[i], len(gone[i])), i
        assert r.kept_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and (gone[i] or r.text == t)
    assert gone[25] and gone[30] and not gone[20] and not gone[0]
    assert substring_dedup.drop_spans(frame(spark, texts)).columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert substring_dedup.drop_spans(spark.createDataFrame([], SCHEMA), report=True).count() == 0


def test_passages_in_running_text_are_removed(spark):
    """By windows of 50 words, not by sentences(): the passage is set into hosts with and without stops, pauses and lines."""
    rng = random.Random(5)
    some = lambda n, stop=0: " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 999)}" + ("." if stop and k % stop == stop - 1 else "") for k in range(n))
    passages = [some(50, stop) for stop in (0, 0, 0, 9, 22, 31) * 4]
    hosts = [lambda p: some(7) + " " + p, lambda p: some(40, 5) + " " + p + " " + some(5) + ".", lambda p: some(90) + " " + p + " " + some(60), lambda p: some(12, 4) + "\n" + p + "\n" + some(30)]
    docs = [hosts[(k + side) % 4](p) for side in (0, 1) for k, p in enumerate(passages)]
    got = {r.doc_id: r for r in substring_dedup.drop_spans(frame(spark, docs), report=True).collect()}
    for k, p in enumerate(passages):
        first, second = got[k], got[len(passages) + k]
        kept = set(second.text.split())
        assert first.n_removed == 0 and sum(w in kept for w in p.split()) < 20, k
        assert set(docs[len(passages) + k].split()) - set(p.split()) <= kept | {p.split()[0], p.split()[-1]}, k


# ---- 8 ----


def test_quality_base_counts(spark, texts):
    docs = [*texts, "a b c a b c a b c", "x\n\n x\nx\n", "#$ | <b> * a & %"]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(frame(spark, docs, True).drop("stratum"), empty).collect()}
    for i, t in enumerate(docs):
        w = WORD.findall(t or "")
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[None if t == "NULLID" else i]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r.kept == (not r.base_failed)
    assert quality.judge(spark.createDataFrame([], SCHEMA), empty).count() == 0


def test_risk_controlled_cutoffs(spark):
    from pyspark.sql import functions as F

    cases = [(0, 500), (1, 500), (3, 900), (20, 9000), (80, 9000), (4, 400)]
    rows = spark.createDataFrame([(float(k), float(n)) for k, n in cases], "k double, n double").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in rows:
        k, n = int(r.k), int(r.n)
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99)) for i in range(k + 1))
        assert r.p == pytest.approx(1.0 if k >= n * 0.01 else exact, rel=1e-9)
    found = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'en', NULL) AS stratum", "100L AS n_words", "500L AS word_chars", "IF(id % 10 = 0, 60L, 1L) AS n_symbols", "0L AS n_dup_lines", "9L AS n_lines", "0L AS n_repeat_words", "0L AS n_capitals")
    labels = found.selectExpr("doc_id", "IF(n_symbols > 9, 0, 1) AS quality", "0 AS toxic")
    limits = {r["name"]: r.asDict() for r in quality.cutoffs(found, labels).collect()}
    assert limits["en"]["symbols_a_word"] == 0.3 and limits["en"]["capitals"] is None  # the laxest cutoff that rejects all bad labels
    assert all(limits[""][rule] is None for rule in quality.RULES)  # no bad labels: nothing to gain
    few = quality.cutoffs(found, labels.where("doc_id < 300")).collect()
    assert not few


def risk_model(rows, alpha, delta):
    """rows: (stratum, scores by rule, good). The configuration of each stratum, all of them tried, by Holm's procedure."""
    configs = list(itertools.product(*([None, *c[::-1]] for c in quality.RULES.values())))
    found = []
    for stratum in {r[0] for r in rows}:
        good, bad = ([s for t, s, g in rows if t == stratum and g == want] for want in (True, False))
        for at, c in enumerate(configs):
            out = lambda s, c=c: any(x is not None and v > x for v, x in zip(s, c, strict=True))
            n, k = len(good), sum(map(out, good))
            if n:
                p = 1.0 if k >= n * alpha else sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))
                found.append((p, stratum, k / n - (sum(map(out, bad)) / len(bad) if bad else k / n), sum(quality.RULES[r][::-1].index(x) + 1 for r, x in zip(quality.RULES, c, strict=True) if x is not None), at))
    chosen = {}
    for i, (p, stratum, loss, strict, at) in enumerate(sorted(found, key=lambda x: x[0])):
        if p > delta / (len(found) - i):
            break
        chosen[stratum] = min(chosen.get(stratum, (9, 0, 0)), (round(loss, 12), strict, at))
    return {s: (loss, strict, configs[at]) for s, (loss, strict, at) in chosen.items()}


def test_configurations_equal_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "RULES", dict(list(quality.RULES.items())[:3]))
    monkeypatch.setattr(quality, "CONFIGURATIONS", 64)
    rng = random.Random(8)
    rows, docs = [], []
    for i in range(1200):
        stratum, good = rng.choice(["en", "en", "de", None, "xx"] if i < 900 else ["en", "de"]), rng.random() < 0.8
        score = (rng.choice([0, 0, 0, 2, 15, 40, 120] if not good else [0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 4]) / 100, rng.choice([4, 8, 8, 20, 60]) / 100 if not good else rng.choice([2, 2, 5, 9, 9, 16]) / 100, rng.choice([0, 0, 4, 6]) / 10 if not good else 0.0)
        rows.append((stratum, score, good))
        docs.append((i, stratum, 100, 500, round(score[0] * 100), round(score[2] * 10), 10, 0, round(score[1] * 500), int(good)))
    found = spark.createDataFrame(docs, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_capitals long, quality int")
    want = risk_model([(s, (round(x[0] * 100) / 100, round(x[1] * 500) / 500, round(x[2] * 10) / 10), g) for s, x, g in rows], 0.05, 0.05)
    got = {(None if r.none else r.name): r for r in quality.cutoffs(found.drop("quality"), found.select("doc_id", "quality")).collect()}
    assert set(got) == set(want) and {"en", "de"} <= set(got)
    for stratum, (loss, strict, config) in want.items():
        own = tuple(got[stratum][rule] for rule in quality.RULES)
        assert sum(list(c[::-1]).index(x) + 1 for x, c in zip(own, quality.RULES.values(), strict=True) if x is not None) == strict, (stratum, loss, own, config)
    assert any(x is not None for x in want["en"][2])


def test_quality_is_native(spark, texts):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan(quality.features(frame(spark, texts))))
    labels = spark.range(9).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert not re.search("Python|Pandas|Arrow", plan(quality.judge(frame(spark, texts), labels)))
    assert not re.search("Python|Pandas|Arrow", plan(quality.cutoffs(quality.features(frame(spark, texts)), labels)))


# ---- 9 ----


def test_packing(spark, texts):
    from tokenizers import Tokenizer
    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [*texts, " lead  two   three\n\n x \t y", "a <|endoftext|> b", "word " * 3000]
    got = packing.pack(frame(spark, docs, True), with_ids=True).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in enumerate(docs):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        parts = sorted(by[None if t == "NULLID" else i], key=lambda r: r.piece)
        assert b"".join(p.ids for p in parts) == ids.tobytes(), i
        assert [(p.start, p.length) for p in parts] == packing.cut(len(ids), 1024) and all(zlib.crc32(p.ids) == p.ids_crc32 for p in parts)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_local_search_empties_bins():
    start = packing.Bins(10)
    for items in ((6, 2), (5, 3), (4,)):
        start.add(items, 1)
    assert packing.improve(start).count() == 2
    rng = random.Random(9)
    for _ in range(20):
        counts = Counter(rng.randint(1, 60) for _ in range(200))
        first = packing.best_fit(counts, 100)
        before, filled = first.count(), Counter(x for k, n in first.groups.items() for x in k for _ in range(n))
        assert filled == counts
        done = packing.improve(first)
        assert done.count() <= before and Counter(x for k, n in done.groups.items() for x in k for _ in range(n)) == counts and max(map(sum, done.groups)) <= 100
        rows = packing.slots(done)
        assert len({(x, first) for x, first, _, _ in rows.tolist()}) == len(rows)


def test_local_search_ends_only_where_no_swap_helps():
    rng = random.Random(9)
    for case in range(150):
        done = packing.plan(Counter(rng.randint(9, 60) for _ in range(120)), 100)
        if done.count() == -(-sum(sum(k) * n for k, n in done.groups.items()) // 100):
            continue
        under = [k for k in done.groups if sum(k) < 100]
        left = [(a, b) for a in under for b in under if (a != b or done.groups[a] > 1) and any(sum(b) - sum(a) + d > 0 for d, _, _ in packing._swaps(a, b, 100 - sum(b)))]
        assert not left, case


def test_local_search_has_no_bound_of_its_own(caplog):
    start = packing.Bins(10)
    for items in ((6, 2), (5, 3), (4,)):
        start.add(items, 1)
    assert packing.improve.__defaults__ == packing.plan.__defaults__[1:] == (None,)
    assert packing.improve(start, 0).count() == 3 and "bound on moves" in caplog.text


def test_two_tokenizers_agree_on_the_vocabulary():
    import public_tokenizers

    from strandline.llm import tokens

    whole = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ranks = tokens.byte_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for i in range(0, 50256, 7):
        text = whole.decode([i], skip_special_tokens=False)
        if "�" not in text:
            assert whole.encode(text, add_special_tokens=False).ids == ranks.encode_ordinary(text)


# ---- 10 ----


def test_fingerprints(spark, texts):
    docs = [t for t in texts if t != "NULLID"]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(frame(spark, docs, True), range_rows=7).collect()}
    for i, t in enumerate(docs):
        t, following = t or "", docs[i - 1] or ""
        n = len(t) // 3
        new = t[: len(t) - n] + following[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == fingerprints.fingerprint(t) and r.edited_fingerprint == fingerprints.fingerprint(new)
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1) == (t == new)
        if len(t) > 600 and i not in (6, 66) and len(set(t)) > 5:
            assert 0.3 < r.near_edited
    assert fingerprints.likeness(got[50].fingerprint, got[51].fingerprint) == 1
    lone = fingerprints.compare_with_next(spark.createDataFrame([(None, "one two three")], "doc_id long, text string")).first()
    assert lone.near_next == 1 and lone.n_chars == 13
    assert fingerprints.compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_locates_edits():
    lines = [f"This is paragraph number {i}, which says something of its own. And one more sentence." for i in range(60)]
    one = fingerprints.fingerprint("\n".join(lines))
    lines[33] = lines[33].replace("its own", "no one")
    two = fingerprints.fingerprint("\n".join(lines))
    at = fingerprints.edits(one, two)
    assert len(at) == 1 and fingerprints.likeness(one, two) > 0.9
    sections = fingerprints.tree(one)[1]
    assert sum(len(p) for _, p in sections[: at[0][0]]) + at[0][1] == 33
    assert fingerprints.edits(one, one) == []


# ---- the pipeline ----


def test_pipeline_runs_and_keeps_its_order(spark, texts, tmp_path):
    import corpus_pipeline

    frame(spark, [t for t in texts if t != "NULLID"]).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    out = corpus_pipeline.run(spark, str(tmp_path))
    tokens = packing.pack(docs).agg({"length": "sum"}).first()[0]
    assert out.agg({"length": "sum"}).first()[0] == tokens
    assert out.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 1024
