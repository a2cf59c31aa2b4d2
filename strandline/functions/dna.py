"""Sequence functions as columns: built-in expressions only, so they stay in generated code and push down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical(seq: Column | str) -> Column:
    """Upper-case A, C, G, T; every other letter is N."""
    return F.regexp_replace(F.upper(_col(seq)), "[^ACGT]", "N")


def reverse_complement(seq: Column | str) -> Column:
    """Of a canonical sequence; N stays N."""
    return F.reverse(F.translate(_col(seq), "ACGT", "TGCA"))


def gc_count(seq: Column | str) -> Column:
    s = _col(seq)
    return F.length(s) - F.length(F.translate(s, "GC", ""))


def gc_percent(gc: Column, bases: Column) -> Column:
    return F.when(bases > 0, gc * F.lit(100.0) / bases).otherwise(F.lit(0.0))


def phred(qual: Column | str, offset: int = 33) -> Column:
    """Array of scores of a quality string."""
    q = _col(qual)
    places = F.sequence(F.lit(1), F.length(q))
    return F.when(F.length(q) > 0, F.transform(places, lambda i: F.ascii(F.substring(q, i, F.lit(1))) - offset)).otherwise(F.array().cast("array<int>"))


def combined_tag(tag: Column | str) -> Column:
    """The tag up to its last slash; from two characters after it on, if a # is there."""
    t = _col(tag)
    back = F.instr(F.reverse(t), "/")
    cut = F.length(t) - back
    mark = F.substring(t, cut + F.lit(3), F.lit(1))
    rest = F.when(mark == "#", F.substring(t, cut + F.lit(3), F.length(t))).otherwise("")
    return F.when(back == 0, t).otherwise(F.concat(F.substring(t, F.lit(1), cut), rest))


def rotations(motif: Column | str) -> Column:
    m = _col(motif)
    n = F.length(m)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(m, i, n), F.substring(m, F.lit(1), i - 1)))


def canonical_motif(motif: Column | str) -> Column:
    """The least rotation of the motif or of its reverse complement."""
    m = _col(motif)
    return F.array_min(F.concat(rotations(m), rotations(reverse_complement(m))))


def is_atomic(motif: Column | str) -> Column:
    """Not a shorter unit repeated: the motif first recurs in its double at its full length."""
    m = _col(motif)
    return F.instr(F.substring(F.concat(m, m), F.lit(2), F.length(m) * 2), m) == F.length(m)


def expanded(motif: Column | str, length: int) -> Column:
    m = _col(motif)
    return F.substring(F.repeat(m, F.lit(length)), F.lit(1), F.lit(length))
