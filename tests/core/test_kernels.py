"""The merge and repeat kernels against plain models, without Spark."""

import random

import pyarrow as pa
import pytest

from strandline.operators import merge_kernel as K
from strandline.operators import motifs, ssr
from strandline.params import MergeParams, SsrParams, read_min_units, read_motifs

FULL = ("ACGTTGCAAC", "I" * 10)
FIXTURES = [
    (FULL, ("GTTGCAACGT", "I" * 10), {}, ("ACGTTGCAAC", "IIIIIIIIII")),
    (FULL, ("GATGCAACGT", "5" * 10), {}, ("ACGTTGCAAC", "IIIIIIII5I")),
    (FULL, ("GATGCAACGT", "5" * 10), {"cap_mismatch_quals": True}, ("ACGTTGCAAC", "IIIIIIII#I")),
    (FULL, ("GATGCAACGT", "I" * 10), {}, ("ACGTTGCATC", "IIIIIIII#I")),
    (("ACGTTGCAACG", "I" * 11), ("CGTTGCNACGT", "I" * 11), {}, ("ACGTTGCAACG", "IIII#IIIIII")),
    (FULL, ("GTTGCNACGT", "I" * 10), {}, None),
    (("ACGTTGCAA", "I" * 9), ("TTGCAACGT", "I" * 9), {}, None),
    (("GGATCACGTTGCAAC", "I" * 15), ("GCTAAGTTGCAACGT", "5" * 15), {"lowercase_overhang": True}, ("ggatcACGTTGCAACttagc", "I" * 15 + "5" * 5)),
    (("ACGTTGCAACTTAGC", "I" * 15), ("GTTGCAACGTGATCC", "I" * 15), {}, None),
    (("ACGTTGCAACTTAGC", "I" * 15), ("GTTGCAACGTGATCC", "I" * 15), {"allow_outies": True}, ("GGATCACGTTGCAACTTAGC", "I" * 20)),
]


def batch(pairs, params):
    cols = [pa.array(x, pa.string()) for x in zip(*[(*a, *b) for a, b in pairs], strict=True)]
    ok, seq, qual = K.merge_batch(*cols, params)
    return [(s, q) if m else m for m, s, q in zip(ok.to_pylist(), seq.to_pylist(), qual.to_pylist(), strict=True)]


@pytest.mark.parametrize("one,two,params,expected", FIXTURES)
def test_fixtures(one, two, params, expected):
    p = MergeParams(**params)
    assert K.merge_one(*one, *two, p) == expected
    assert batch([(one, two)], p) == [expected or False]


def random_pair(rng):
    n = rng.randint(5, 150)
    frag = "".join(rng.choice("ACGT") for _ in range(n))
    l1, l2 = rng.randint(1, n), rng.randint(1, n)
    turn = str.maketrans("ACGTN", "TGCAN")
    a, b = frag[:l1], frag[-l2:]
    if rng.random() < 0.2:
        a, b = b, a
    noise = lambda s: "".join(rng.choice("ACGTNacx") if rng.random() < 0.04 else c for c in s)
    q = lambda s: "".join(chr(33 + rng.choice([2, 2, 20, 30, 40])) for _ in s)
    a, b = noise(a), noise(b)[::-1].translate(turn)
    return (a, q(a)), (b, q(b))


@pytest.mark.parametrize("params", [{}, {"allow_outies": True}, {"cap_mismatch_quals": True, "lowercase_overhang": True}, {"min_overlap": 3, "max_overlap": 8, "max_mismatch_density": 0.6, "allow_outies": True}])
def test_random_pairs_equal_the_model(params):
    rng, p = random.Random(7), MergeParams(**params)
    pairs = [random_pair(rng) for _ in range(600)]
    assert batch(pairs, p) == [K.merge_one(*a, *b, p) or False for a, b in pairs]


def test_nulls_and_errors():
    cols = [pa.array([None, "ACGTTGCAAC"]), pa.array(["I" * 10] * 2), pa.array(["GTTGCAACGT"] * 2), pa.array(["I" * 10] * 2)]
    assert K.merge_batch(*cols, MergeParams())[0].to_pylist() == [None, True]
    with pytest.raises(ValueError, match="length"):
        K.merge_batch(pa.array(["AC"]), pa.array(["I"]), pa.array(["AC"]), pa.array(["II"]), MergeParams())
    with pytest.raises(ValueError, match="offset"):
        K.merge_batch(pa.array(["AC"]), pa.array(["  "]), pa.array(["AC"]), pa.array(["II"]), MergeParams())
    for bad in ({"min_overlap": 0}, {"max_overlap": 5}, {"max_mismatch_density": -1}, {"phred_offset": 128}):
        with pytest.raises(ValueError):
            MergeParams(**bad)


def test_motifs():
    assert motifs.opposite("AAGT") == "ACTT" and motifs.opposite("ACGT") == "ACGT"
    assert motifs.atomic("AC") and not motifs.atomic("ATAT") and not motifs.atomic("AAAA")
    small = motifs.classes(SsrParams(1, 2))
    assert "A" in small and "AC" in small and "TA" not in small
    keys = motifs.dictionary(SsrParams())
    assert "A" * 12 in keys and len(keys) == 5356 and len(motifs.classes(SsrParams())) == 501
    assert keys["T" * 12] == ("A", 1, "-") and keys["AT" * 6][2] == "+"


def test_runs_equal_the_dictionary_scan():
    rng = random.Random(3)
    for m, big, least in ((1, 6, 12), (1, 6, 10), (2, 4, 8)):
        p = SsrParams(m, big, least)
        seqs = ["".join((rng.choice("ACGT") * 1 if rng.random() < 0.4 else "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 6))) * rng.randint(1, 9)) if rng.random() < 0.97 else "N" for _ in range(12)) for _ in range(300)]
        got = sorted(ssr.runs([s.encode() for s in seqs], p))
        assert got == sorted((k, *r) for k, s in enumerate(seqs) for r in ssr.scanned(s, p))
    assert ssr.scanned("ACACACACACACGT", SsrParams()) == [(0, 12, "AC", 12, "+", 6, "AC")]


def test_parameter_files(tmp_path):
    (tmp_path / "m").write_text("# motifs\nac\n\nATG\n")
    assert read_motifs(tmp_path / "m") == ("ac", "ATG")
    (tmp_path / "u").write_text("# units\n1 12 more\n2 6\n")
    assert read_min_units(str(tmp_path / "u"), 1, 6) == {1: 12, 2: 6} and read_min_units("3", 2, 3) == {2: 3, 3: 3}
    for bad in (lambda: SsrParams(max_motif=6, min_length=4), lambda: SsrParams(motifs=("AX",)), lambda: SsrParams(3, 2)):
        with pytest.raises(ValueError):
            bad()
