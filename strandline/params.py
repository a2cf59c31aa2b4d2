"""Parameters of the operators, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class MergeParams:
    """How read pairs are merged. max_overlap caps the denominator of the scores, not the overlaps that are searched."""

    min_overlap: int = 10
    max_overlap: int = 65
    max_mismatch_density: float = 0.25
    cap_mismatch_quals: bool = False
    allow_outies: bool = False
    lowercase_overhang: bool = False
    phred_offset: int = 33

    def __post_init__(self) -> None:
        _check(self.min_overlap >= 1, "min_overlap must be at least 1")
        _check(self.max_overlap >= 1, "max_overlap must be at least 1")
        _check(self.max_overlap >= self.min_overlap, "max_overlap must not be below min_overlap")
        _check(self.max_mismatch_density >= 0, "max_mismatch_density must not be negative")
        _check(0 <= self.phred_offset <= 127, "phred_offset must be 0 to 127")


@dataclass(frozen=True)
class SsrParams:
    """Which repeats are found. min_units: motif size -> least number of whole units (1 where not given)."""

    min_motif: int = 1
    max_motif: int = 6
    min_length: int = 12
    min_seq_len: int = 0
    max_seq_len: int | None = None
    min_units: dict[int, int] = field(default_factory=dict)
    motifs: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        _check(self.min_motif >= 1, "min_motif must be at least 1")
        _check(self.max_motif >= self.min_motif, "max_motif must not be below min_motif")
        _check(self.min_length >= 1, "min_length must be at least 1")
        _check(self.min_length >= self.max_motif, "min_length must not be below max_motif")
        _check(self.max_seq_len is None or self.max_seq_len >= self.min_seq_len, "max_seq_len must not be below min_seq_len")
        for raw in self.motifs or ():
            motif = raw.strip().upper()
            _check(not motif or set(motif) <= set("ACGT"), f"motif has other letters than A, C, G, T: {motif}")
            _check(not motif or self.min_motif <= len(motif) <= self.max_motif, f"motif size is outside {self.min_motif} to {self.max_motif}: {motif}")

    @property
    def by_runs(self) -> bool:
        """Whether maximal runs give the dictionary's result: default motifs, and runs too long for two classes to share a key."""
        return self.motifs is None and self.min_length >= 2 * self.max_motif - 2 and self.min_length > self.max_motif


def _lines(path: str | Path):
    for line in Path(path).read_text().splitlines():
        if (text := line.strip()) and not text.startswith("#"):
            yield text


def read_motifs(path: str | Path) -> tuple[str, ...]:
    """One motif a line; blank lines and # comments are skipped. A file without motifs is an error."""
    out = tuple(_lines(path))
    _check(bool(out), f"no motifs in {path}")
    return out


def read_min_units(spec: str | int, min_motif: int, max_motif: int) -> dict[int, int]:
    """A number for every motif size, or a file with lines `motif_len min_units`."""
    try:
        return dict.fromkeys(range(min_motif, max_motif + 1), int(spec))
    except ValueError:
        pass
    out = {}
    for line in _lines(spec):
        parts = line.split()
        _check(len(parts) >= 2 and all(p.isdigit() for p in parts[:2]), f"bad min-units line: {line}")
        out[int(parts[0])] = int(parts[1])
    return out
