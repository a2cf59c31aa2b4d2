"""Operator 10: document fingerprints, a Merkle tree over the pieces, paragraphs and sections of a text.

Leaves are pieces of a paragraph (sentences; long ones are cut every `PIECE_WORDS` words, or `PIECE_CHARS` characters), which
together are the paragraph. A paragraph (a line) hashes its pieces' hashes, a section its paragraphs'; a section ends where a
paragraph's hash says so (about every eighth), so an edit moves no later section's bounds. The root hashes the sections' hashes.
All hashes are 16 bytes long and begin with the node's level, so equal roots mean equal texts, as every character is in a leaf.

A fingerprint is `root;section;section...`, a section `hash/paragraph/paragraph...`, a paragraph `hash:piece:piece...`; the root
is told in full, the hashes below it by their first 8 bytes. A paragraph of one piece is that piece. Comparing two fingerprints
walks down only where hashes differ, which locates edits; the likeness is the share of leaves found in both, 2 c / (a + b),
from 0 to 1.

The edited text of a document takes its tail from the next document by descending doc_id (null last; repeated ids by a hash of the text, then the text).
Documents are dealt to ranges of (id, hash of the text), so that many rows of one id, or without one, are spread as well. The
first document of each range goes to the range before it too, so each task streams its own documents with one of look-ahead, in
one shuffle of the texts.

Cases: null or empty text has a tree without leaves; two such are alike (1), one such and another are not (0). A lone document
is its own next one. Repeated rows follow each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PIECE_WORDS, PIECE_CHARS, SECTION = 8, 400, 8
RANGE_ROWS, MAX_RANGES = 4000, 20_000
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+")
_LOWEST = -(2**63)


def _hash(level: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=level).digest()


def pieces_of(paragraph: str) -> list[str]:
    """Sentences with the white space after them, the long ones cut; joined they are the paragraph."""
    if len(paragraph) <= 24:
        return [paragraph]
    out, at = [], 0
    for end in [*(m.end() for m in _SENTENCE.finditer(paragraph)), len(paragraph)]:
        sentence, at = paragraph[at:end], end
        if len(sentence) <= 6 * PIECE_WORDS:
            out.append(sentence)
            continue
        words = sentence.split(" ")
        for i in range(0, len(words), PIECE_WORDS):
            part = " ".join(words[i : i + PIECE_WORDS]) + " " * (i + PIECE_WORDS < len(words))
            out += [part[k : k + PIECE_CHARS] for k in range(0, len(part), PIECE_CHARS)]
    return [x for x in out if x]


def fingerprint(text: str) -> str:
    """The tree of a text: each node's hash is made of its children's whole hashes alone."""
    sections, section = [], []
    if text:
        for line in text.split("\n"):
            leaves = [_hash(b"piece", p.encode("utf-8", "surrogatepass")) for p in pieces_of(line)]
            own = _hash(b"paragraph", b"".join(leaves)) if len(leaves) > 1 else leaves[0]
            section.append((own, leaves))
            if int.from_bytes(own[-3:], "big") % SECTION == 0:
                sections.append(section)
                section = []
        if section:
            sections.append(section)
    heads = [_hash(b"section", b"".join(own for own, _ in s)) for s in sections]
    told = ["/".join((head[:8].hex(), *(":".join((own[:8].hex(), *(x[:8].hex() for x in leaves))) if len(leaves) > 1 else own[:8].hex() for own, leaves in s))) for head, s in zip(heads, sections, strict=True)]
    return ";".join((_hash(b"root", b"".join(heads)).hex(), *told))


def tree(print_: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    root, *sections = print_.split(";")
    out = []
    for s in sections:
        head, *paragraphs = s.split("/")
        out.append((head, [(p.split(":")[0], p.split(":")[1:] or [p]) for p in paragraphs]))
    return root, out


def likeness(one: str, other: str) -> float:
    """Share of leaves in both: whole sections with equal hashes first, then paragraphs, then pieces of what differs."""
    if one == other:
        return 1.0
    (_, a), (_, b) = tree(one), tree(other)
    leaves = [sum(len(p) for _, ps in t for _, p in ps) for t in (a, b)]
    if not all(leaves):
        return 0.0
    common = 0
    for weight, down in ((lambda s: sum(len(p) for _, p in s[1]), lambda s: s[1]), (lambda p: len(p[1]), lambda p: [(x, [x]) for x in p[1]]), (lambda x: 1, None)):
        have = Counter(x[0] for x in b)
        rest_a, matched = [], Counter()
        for x in a:
            if have[x[0]] > matched[x[0]]:
                matched[x[0]] += 1
                common += weight(x)
            else:
                rest_a.append(x)
        rest_b = []
        for x in b:
            if matched[x[0]]:
                matched[x[0]] -= 1
            else:
                rest_b.append(x)
        if down is None:
            break
        a, b = [y for x in rest_a for y in down(x)], [y for x in rest_b for y in down(x)]
    return min(1.0, 2 * common / sum(leaves))


def edits(one: str, other: str) -> list[tuple[int, int]]:
    """(section, paragraph) of the first text whose hashes the second lacks: the branches that differ."""
    (ra, a), (rb, b) = tree(one), tree(other)
    if ra == rb:
        return []
    heads = {h for h, _ in b}
    known = {p for _, ps in b for p, _ in ps}
    return [(i, j) for i, (h, ps) in enumerate(a) if h not in heads for j, (p, _) in enumerate(ps) if p not in known]


def edited(text: str, following: str) -> str:
    """The last third of the text's code points (rounded down) replaced by as many of the following text's first, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole ranges, each range's in descending order, its look-ahead row last."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    before = None  # (range, doc_id, text, fingerprint, whether it is a look-ahead row)
    for b in batches:
        out = []
        for part, doc, text, ahead in zip(*(b.column(x).to_pylist() for x in ("__range", "doc_id", "text", "__ahead")), strict=True):
            if ahead and before and before[4] and before[0] == part:
                continue  # one look-ahead row is enough where ids repeat
            text = text or ""
            own = fingerprint(text)
            if before and before[0] == part and not before[4]:
                new = edited(before[2], text)
                mark = fingerprint(new)
                out.append((before[1], len(before[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), before[3], mark, likeness(before[3], mark), likeness(before[3], own)))
            before = part, doc, text, own, ahead
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def range_index(bounds: list[tuple[int, int]], ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The index of the range (bounds[k - 1], bounds[k]] of each (id, hash); bounds are sorted."""
    limits = np.array(bounds, dtype=np.int64).reshape(-1, 2)
    low, high = (np.searchsorted(limits[:, 0], ids, side=x) for x in ("left", "right"))
    out = low.copy()
    for k in np.unique(low[low < high]):  # ids that are a bound: by the hashes of the bounds with that id
        own = (low == k) & (low < high)
        out[own] = k + np.searchsorted(limits[k : high[own][0], 1], hashes[own], side="left")
    return out.astype(np.int32)


def _range_of(bounds: list[tuple[int, int]]):
    @F.pandas_udf("int")
    def of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(range_index(bounds, ids.to_numpy(), hashes.to_numpy()))

    return of


def compare_with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    The driver holds a bound and the largest id of each range: range_rows documents a range, or MAX_RANGES ranges.
    """
    spark = docs.sparkSession
    C.bounded_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"__id": F.coalesce("doc_id", F.lit(_LOWEST)), "__h": F.xxhash64("text")})
    key = F.struct("__id", "__h")
    n = own.count()
    parts = max(1, min(n // range_rows, MAX_RANGES))
    ranked = own.select("__id", "__h").repartitionByRange(parts, "__id", "__h").groupBy(F.spark_partition_id().alias("p")).agg(F.max(key).alias("top"))
    bounds = sorted(tuple(r["top"]) for r in ranked.collect())[:-1]  # a row a range
    dealt = own.withColumn("__range", _range_of(bounds)("__id", "__h"))
    heads = {r["__range"]: tuple(r["top"]) for r in dealt.groupBy("__range").agg(F.max(key).alias("top")).collect()}  # a row a range
    if not heads:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    order = sorted(heads)
    to = [(*heads[k], order[i + 1] if i + 1 < len(order) else order[0]) for i, k in enumerate(order)]
    ahead = spark.createDataFrame(to, "__id long, __h long, __to int")
    # one copy of each head is enough; equal rows of a head are the same text
    next_ = dealt.drop("__range").join(F.broadcast(ahead), ["__id", "__h"]).groupBy("__id", "__h", "__to").agg(F.max(F.struct("doc_id", "text")).alias("x")).select("x.doc_id", "x.text", "__id", "__h", F.col("__to").alias("__range"), F.lit(True).alias("__ahead"))
    both = dealt.withColumn("__ahead", F.lit(False)).unionByName(next_)
    rows = both.repartition(len(order), "__range").sortWithinPartitions("__range", "__ahead", F.desc("__id"), F.desc("__h"), F.asc_nulls_first("text"))
    return rows.select("__range", "doc_id", "text", "__ahead").mapInArrow(_streamed, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
