"""The dimension of repeat motifs: every rotation of every class, with its class and strand."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from ..params import SsrParams

_PAIR = str.maketrans("ACGT", "TGCA")


def turned(motif: str) -> list[str]:
    return [motif[i:] + motif[:i] for i in range(len(motif))]


def opposite(motif: str) -> str:
    return motif[::-1].translate(_PAIR)


def atomic(motif: str) -> bool:
    return (motif + motif).find(motif, 1) == len(motif)


@lru_cache(maxsize=1 << 16)
def classified(motif: str) -> tuple[str, str]:
    """(class, strand): the least rotation on either strand; `+` if the motif is a rotation of its class itself."""
    own = turned(motif)
    label = min(own + turned(opposite(motif)))
    return label, "+" if label in own else "-"


def classes(p: SsrParams) -> list[str]:
    """The canonical motifs of the parameters, sorted; custom ones need not be atomic."""
    if p.motifs is not None:
        words = [m.strip().upper() for m in p.motifs if m.strip()]
    else:
        words = ["".join(w) for n in range(p.min_motif, p.max_motif + 1) for w in product("ACGT", repeat=n)]
        words = [w for w in words if atomic(w)]
    return sorted({classified(w)[0] for w in words})


@lru_cache(maxsize=8)
def _dictionary(motifs: tuple[str, ...], length: int) -> dict[str, tuple[str, int, str]]:
    out: dict[str, tuple[str, int, str]] = {}
    for label in motifs:
        for strand, rotations in (("+", turned(label)), ("-", turned(opposite(label)))):
            for r in rotations:
                out.setdefault((r * length)[:length], (label, len(label), strand))
    return out


def dictionary(p: SsrParams) -> dict[str, tuple[str, int, str]]:
    """Expanded key of min_length letters -> (class, motif size, strand). Where keys clash the first class in order has it, `+` before `-`."""
    return _dictionary(tuple(classes(p)), p.min_length)


def motif_table(spark: SparkSession, p: SsrParams | None = None) -> DataFrame:
    """(motif, canonical, motif_len, strand) of every key's first unit; some thousand rows at the default sizes."""
    rows = sorted({(k[:n], label, n, strand) for k, (label, n, strand) in dictionary(p or SsrParams()).items()})
    return spark.createDataFrame(rows, "motif string, canonical string, motif_len int, strand string")
