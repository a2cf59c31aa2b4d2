"""Helpers shared by the text operators: shared-folder tables, batch limits, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule `[^\x20\x09-\x0D]+`.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/strandline-{spark.sparkContext.applicationId}"


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths of the tables that materialize makes inside, in this thread."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(token)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the running stage, as the table is on shared storage. The application's tables
    are in one folder, which sweep() deletes.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    for made in _scopes.get():
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete working tables that no frame needs any more; for callers that have written what they made from them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Delete all working tables of this application; no result that is not written elsewhere can be read afterwards."""
    release(spark, [shared_dir(spark)])


def bounded_batches(spark: SparkSession, rows: int = 1000, mb: int = 8) -> None:
    """Keep Arrow batches small enough for long texts in small Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def sheltered(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its columns that begin with two underscores renamed, as the operators' own do; and what gives them back their names."""
    taken = {c.lower() for c in docs.columns}
    names = {}
    for c in docs.columns:
        if c.startswith("__"):
            new = f"own{c}"
            while new.lower() in taken:
                new = f"own_{new}"
            taken.add(new.lower())
            names[c] = new
    return docs.withColumnsRenamed(names), lambda out: out.withColumnsRenamed({v: k for k, v in names.items()})


def hash_id(col: Column) -> Column:
    """crc32 of the id written as text, null as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", mb: float = 2.0, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of at most `rows` rows whose texts hold about mb megabytes, with the texts as UTF-8 (null: empty)."""
    for batch in batches:
        texts = [x.encode() if x else b"" for x in batch.column(column).to_pylist()]
        start = held = 0
        for i, x in enumerate(texts):
            held += len(x)
            if held >= mb * 1e6 or i + 1 - start >= rows:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and xor-shift rounds)."""
    with np.errstate(over="ignore"):
        x = x.astype(U64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class RollingHash:
    """64-bit polynomial hash of any byte range of a buffer, from one cumulative sum.

    Byte b at place i counts table[b] * P**i; the hash of [s, e) is the sum times P**-s, so it depends on the bytes alone.
    """

    def __init__(self, seed: int):
        self.table = mix(np.arange(256, dtype=U64) + U64((seed * 1_000_003 + 17) % 2**64))
        self.p = (int(mix(np.array([seed + 99], dtype=U64))[0]) & ~7) | 3  # odd, with powers far from 1
        self.inverse = pow(self.p, -1, 2**64)
        self.powers = self.inverses = np.ones(1, dtype=U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                up = np.full(n, self.p, dtype=U64)
                up[0] = 1
                self.powers = np.cumprod(up)
                up[1:] = self.inverse
                self.inverses = np.cumprod(up)

    def sums(self, buf: np.ndarray) -> np.ndarray:
        self._grow(len(buf) + 1)
        out = np.zeros(len(buf) + 1, dtype=U64)
        with np.errstate(over="ignore"):
            np.cumsum(self.table[buf] * self.powers[: len(buf)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(U64))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of the texts, each followed by a newline, and the place at which each begins (plus the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=at[1:])
    return buf, at


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` in a buffer that ends in white space."""
    solid = ~_WS[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid)).view(np.int8)))
    return edge[::2], edge[1::2]


def words_of(texts: list[bytes], hasher: RollingHash) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of the texts in order, and the index of each text's first word (plus the end)."""
    buf, at = joined(texts)
    starts, ends = word_bounds(buf)
    return hasher.ranges(hasher.sums(buf), starts, ends), np.searchsorted(starts, at)


def windows(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words within each text, and the index of each text's first run (plus the end).

    A text of 1 to k - 1 words has one run: all its words.
    """
    n = np.diff(first)
    runs = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.zeros(len(first), dtype=np.int64)
    np.cumsum(runs, out=at[1:])
    text = np.repeat(np.arange(len(n)), runs)
    start = first[:-1][text] + np.arange(at[-1]) - at[:-1][text]
    length = np.minimum(n[text], k)
    padded = np.concatenate((words, np.zeros(k, dtype=U64)))
    out = np.zeros(len(start), dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = np.where(j < length, mix(out + padded[start + j] + U64(j + 1)), out)
    return out, at


def occurrence_hashes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values per text (bounds in at) made distinct: the i-th occurrence of a value in a text has its own hash.

    The Jaccard similarity of two such sets is the weighted one of the counts.
    """
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    nth = np.arange(len(v)) - np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    out = np.empty_like(values)
    with np.errstate(over="ignore"):
        out[order] = np.where(nth == 0, v, mix(v + mix(nth.astype(U64))))
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
