"""Operator 3: secret scan by patterns and by token efficiency.

The patterns find assignments, access keys and long hexadecimal strings. The token-efficiency test adds what they miss: a run
of at least `MIN_RUN` characters of `[A-Za-z0-9+/_=-]` that a tiktoken vocabulary cuts into short tokens (few characters a
token) is a random string. Patterns' spans, UUIDs and hexadecimal strings of a digest's length are cut out first; what is left
of a run is tested as a whole, and if that is not random, so is what stands between its words and numbers, and each part
between signs of that. Numbers and identifiers (words joined by signs or by capitals, whose letters the vocabulary cuts into
long tokens) are excluded.

Cases: null text is empty: no spans, and the digest is that of the empty string. Repeated rows and null doc_ids are rows like
others. An empty table gives an empty result. Whole texts are scanned, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import tokens

#: Runs with the form of an identifier and four letters a part are tested from `MIN_LETTERS` characters on: the ratio does not tell
#: shorter ones from long words.
MIN_RUN, MIN_LETTERS, CHARS_A_TOKEN = 12, 16, 2.2
KINDS = ("assign", "access", "hex", "random")

# The patterns of the base spans. Greedy runs with a least length match what the open-ended ones do after the length test.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
DIGEST = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}")
SIGNS = re.compile(r"[+/_=-]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words, numbers after them, and their joints: snake_case, kebab-case, paths, CamelCase. Possessive, so that no text makes it slow.
IDENTIFIER = re.compile(r"(?:[+/_=-]*+(?>[A-Z]{2,}+[a-z]*+|[A-Z]?[a-z]{2,}+|[A-Za-z]{1,2}(?![A-Za-z])|[0-9]++(?![A-Za-z])))++[+/_=-]*+")

KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:%s|%s)(?![A-Za-z0-9])" % (UUID.pattern, DIGEST.pattern))
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' spans, by start and then by kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


@cache
def _ranks():
    import public_tokenizers

    return tokens.byte_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def is_words(run: str, chars_a_token: float = CHARS_A_TOKEN) -> bool:
    """Whether a run has the form of an identifier and its letter parts, in any case, are words to the vocabulary, taken together."""
    if not IDENTIFIER.fullmatch(run):
        return False
    cut = lambda x: len(_ranks().encode_ordinary(x))
    parts = PART.findall(run)
    return sum(map(len, parts)) > chars_a_token * sum(min(cut(x), cut(x.lower()), cut(" " + x.lower())) for x in parts)


def is_random(run: str, chars_a_token: float = CHARS_A_TOKEN) -> bool:
    if run.isdigit() or not any(c.isalpha() for c in run) or DIGEST.fullmatch(run) or UUID.fullmatch(run):
        return False
    parts = PART.findall(run)
    if len(run) < MIN_LETTERS and sum(map(len, parts)) >= 4 * len(parts) and IDENTIFIER.fullmatch(run) or is_words(run, chars_a_token):
        return False
    return len(run) <= chars_a_token * len(_ranks().encode_ordinary(run))


def random_parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of the random strings in a run: the whole, or else what stands between its words, or else single parts of that."""
    if len(run) < MIN_RUN:
        return []
    if known := KNOWN.search(run):
        s, e = known.span()
        return random_parts(run[:s]) + [(e + a, e + b) for a, b in random_parts(run[e:])]
    if is_random(run):
        return [(0, len(run))]
    edges = [0, *(x for m in SIGNS.finditer(run) for x in m.span()), len(run)]
    parts = [(s, e) for s, e in zip(edges[::2], edges[1::2], strict=True) if s < e]
    groups: list[list[tuple[int, int]]] = [[]]
    for s, e in parts:
        if run[s:e].isdigit() or is_words(run[s:e]):
            groups.append([])
        else:
            groups[-1].append((s, e))
    out = []
    for group in filter(None, groups):
        whole = group[0][0], group[-1][1]
        tried = [whole] if is_random(run[slice(*whole)]) else group
        out += [(s, e) for s, e in tried if e - s >= MIN_RUN and is_random(run[s:e])]
    return out


def random_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out, at = [], 0
    held = sorted((s, e) for s, e, _ in taken)
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < len(held) and held[at][1] <= start:
            at += 1
        for s, e in [*(x for x in held[at:] if x[0] < end), (end, end)]:
            out += [(start + a, start + b, "random") for a, b in random_parts(text[start : max(start, s)])]
            start = max(start, e)
    return out


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            more = random_spans(text, base)
            count = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
            rows.append((*count, len(more), hashlib.sha256(told(base).encode()).hexdigest(), told(in_order(base + more))))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of each row."""
    C.bounded_batches(docs.sparkSession)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_scanned, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def _redacted(text: str | None, mark: str) -> str | None:
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for s, e, kind in in_order(base + random_spans(text, base)):
        if e > at:
            out += [text[at : max(at, s)], mark.format(kind=kind)] if s >= at else []
            at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """docs with each span in text replaced by a mark; spans that overlap an earlier one go with it."""
    C.bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([_redacted(x, mark) for x in b.column(at).to_pylist()], pa.string()))

    return docs.mapInArrow(run, docs.schema)
