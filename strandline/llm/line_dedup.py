"""Operator 1: line dedup that can be undone, by sharded cuckoo filters over exact reference counts.

State, all of it tables:

* lines(doc_id, k1, k2): a row for each document and line key it holds, in segments; deletions are an anti-join over them;
* refs(k1, k2, n_docs, last_doc): the exact reference count of every key, and the largest document that holds it;
* filters(shard, blob): for each shard of keys a cuckoo filter of those held by at least min_docs documents.

A document's lines are first held against the filter of their shard; only what passes meets the exact table, which decides.
Inserting documents counts only their own lines: these counts are joined to refs, and keys that reach min_docs enter the
filters of their shards. Deleting documents takes their lines' counts off and the fingerprints of keys that fall below min_docs
out again, so the lines of the documents that stay come back; only keys whose largest holder goes are looked up in the lines
that stay. Filters of shards without such keys are carried over as they are. The number of shards doubles when the keys have
outgrown it. compact() writes the segments and deletions as one table.

Cases: null or empty text is one empty line. Null doc_ids count as one document below all others. Rows that repeat a doc_id
are one document for the counts, and each row gets its own result. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_CHARS, MIN_DOCS = 40, 5
GROUP_ROWS = 200_000
_STRIP = C.WHITE.encode()
_LOWEST = -(2**63)


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, two buckets a key; holds multisets and forgets what is deleted.

    Grows (doubles and is built anew from `again`) when a key finds no place after 500 moves.
    """

    def __init__(self, capacity: int):
        self.m = 1 << max(2, math.ceil(math.log2(max(1, capacity) / 4 / 0.85)))
        self.slots = np.zeros((self.m, 4), dtype=np.uint16)

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = C.mix(k1.view(C.U64) ^ C.mix(k2.view(C.U64)))
        mark = ((h >> C.U64(48)).astype(np.uint16) | np.uint16(0)).astype(np.int64)
        mark[mark == 0] = 1
        a = (h & C.U64(self.m - 1)).astype(np.int64)
        return mark, a, a ^ (C.mix(mark.astype(C.U64)) & C.U64(self.m - 1)).astype(np.int64)

    def _fill(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets, all at once; True where there was one."""
        order = np.argsort(at, kind="stable")
        buckets = at[order]
        first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(at) else np.zeros(0, dtype=np.int64)
        nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        taken = self.slots[buckets] != 0
        places = np.argsort(taken, axis=1, kind="stable")  # the free ones first
        fits = nth < 4 - taken.sum(axis=1)
        self.slots[buckets[fits], places[np.flatnonzero(fits), nth[fits]]] = mark[order][fits]
        out = np.zeros(len(at), dtype=bool)
        out[order] = fits
        return out

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if some key found no place; the caller then builds a larger filter."""
        mark, a, b = self._places(k1, k2)
        for turn in range(2):
            left = ~self._fill(mark, (a, b)[turn])
            mark, a, b = mark[left], a[left], b[left]
        for n, (own, one, other) in enumerate(zip(mark.tolist(), a.tolist(), b.tolist(), strict=True)):
            at, mark_ = (one, other)[n & 1], own
            for step in range(500):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = mark_
                    break
                place = (mark_ + step) & 3
                mark_, self.slots[at, place] = int(self.slots[at, place]), mark_
                at ^= int(C.mix(np.array([mark_], dtype=C.U64))[0]) & (self.m - 1)
            else:
                return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for mark, a, b in zip(*(x.tolist() for x in self._places(k1, k2)), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.slots[at] == mark)
                if len(held):
                    self.slots[at, held[0]] = 0
                    break

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(k1, k2)
        mark = mark.astype(np.uint16)[:, None]
        return (self.slots[a] == mark).any(axis=1) | (self.slots[b] == mark).any(axis=1)

    def dump(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        out = cls(1)
        out.slots = np.frombuffer(blob, dtype=np.uint16).reshape(-1, 4).copy()
        out.m = len(out.slots)
        return out


def built(k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
    capacity = len(k1)
    while not (out := CuckooFilter(capacity)).insert(k1, k2):
        capacity *= 2
    return out


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def long_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line the digest of its key, None where the key is too short to count."""
    return [digest(k) if len(k := line_key(x)) >= min_chars and (k.isascii() or len(k.decode()) >= min_chars) else None for x in text.split(b"\n")]


def _postings(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in C.pieces(batches):
        ids, keys = [], []
        for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            own = {k for k in long_keys(text, min_chars) if k}
            keys += own
            ids += [doc] * len(own)
        halves = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", "k1", "k2"])


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    C.bounded_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lambda it: _postings(it, min_chars), "doc_id long, k1 long, k2 long")


def _filter_of(table: pa.Table) -> pa.Table:
    k1, k2 = (table.column(x).to_numpy() for x in ("k1", "k2"))
    return pa.table({"shard": table.column("shard").slice(0, 1), "blob": pa.array([built(k1, k2).dump()], pa.binary())})


def _probe(lines: pa.Table, filters: pa.Table) -> pa.Table:
    out = lines.select(["doc_id", "k1", "k2"])
    if not filters.num_rows:
        return out.slice(0, 0)
    seen = CuckooFilter.load(filters.column("blob")[0].as_py())
    return out.filter(pa.array(seen.contains(out.column("k1").to_numpy(), out.column("k2").to_numpy())))


def _shard(shards: int) -> Column:
    return F.pmod("k1", F.lit(shards)).cast("int").alias("shard")


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc_id")).distinct()


_KEY = ["k1", "k2"]


@dataclass
class LineIndex:
    """lines, refs and filters of the documents inserted so far; insert and delete give a new index, the old one stays valid."""

    lines: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        lines = C.materialize(postings(docs, min_chars), "lines")
        refs = C.materialize(lines.groupBy(*_KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc")), "refs")
        return cls(lines, refs, refs, 0, min_chars, min_docs)._sharded()

    def _sharded(self) -> LineIndex:
        """With filters built anew from the counts, in as many shards as the keys need."""
        shards = max(1, math.ceil(self.refs.count() / GROUP_ROWS))
        return LineIndex(self.lines, self.refs, C.materialize(self._built(self._shared().select(_shard(shards), *_KEY)), "line-filters"), shards, self.min_chars, self.min_docs)

    @staticmethod
    def _built(keys: DataFrame) -> DataFrame:
        return keys.groupBy("shard").applyInArrow(_filter_of, "shard int, blob binary")

    def _shared(self) -> DataFrame:
        return self.refs.where(F.col("n_docs") >= self.min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with more documents, also with more rows of documents it has; their new lines alone are counted."""
        new = C.materialize(postings(docs, self.min_chars).distinct(), "new-lines")
        held = self.lines.join(new.select("doc_id").distinct(), "doc_id", "left_semi")
        new = C.materialize(new.join(held, ["doc_id", *_KEY], "left_anti"), "lines")
        more = C.materialize(new.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("more"), F.max("doc_id").alias("last")), "new-refs")
        refs = self.refs.join(more, _KEY, "full_outer").select(*_KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc"))
        return self._moved(self.lines.unionByName(new), C.materialize(refs, "refs"), more.select(*_KEY))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without these documents (column doc_id)."""
        gone = C.materialize(_ids(doc_ids), "gone")
        less = self.lines.join(gone, "doc_id", "left_semi").distinct().groupBy(*_KEY).agg(F.count(F.lit(1)).alias("less"), F.max("doc_id").alias("gone_doc"))
        less = C.materialize(less, "gone-refs")
        stay = self.lines.join(gone, "doc_id", "left_anti")
        headless = less.join(self.refs, _KEY).where((F.col("gone_doc") == F.col("last_doc")) & (F.col("n_docs") > F.col("less"))).select(*_KEY)
        heads = stay.join(headless, _KEY).groupBy(*_KEY).agg(F.max("doc_id").alias("head"))
        now = (F.col("n_docs") - F.coalesce("less", F.lit(0))).alias("n_docs")
        refs = self.refs.join(less, _KEY, "left").join(heads, _KEY, "left").select(*_KEY, now, F.coalesce("head", "last_doc").alias("last_doc")).where("n_docs > 0")
        return self._moved(stay, C.materialize(refs, "refs"), less.select(*_KEY))

    def compact(self) -> LineIndex:
        """The same index with its lines written as one table."""
        return LineIndex(C.materialize(self.lines, "lines"), self.refs, self.filters, self.shards, self.min_chars, self.min_docs)

    def _moved(self, lines: DataFrame, refs: DataFrame, changed: DataFrame) -> LineIndex:
        """With new counts; of the changed keys those that crossed min_docs go into the filters of their shards, or out."""
        new = LineIndex(lines, refs, self.filters, self.shards, self.min_chars, self.min_docs)
        if refs.count() > 2 * GROUP_ROWS * self.shards:
            return new._sharded()
        mark = lambda index, name: index._shared().select(*_KEY, F.lit(True).alias(name))
        crossed = changed.join(mark(self, "before"), _KEY, "left").join(mark(new, "after"), _KEY, "left").where(F.col("before").isNull() != F.col("after").isNull())
        moved = C.materialize(crossed.select(_shard(self.shards), *_KEY, F.col("after").isNotNull().alias("enters")), "crossed")
        touched = moved.select("shard").distinct()
        filters = moved.groupBy("shard").cogroup(self.filters.join(touched, "shard", "left_semi").groupBy("shard")).applyInArrow(_refilter, "shard int, blob binary, full boolean")
        filters = C.materialize(filters, "line-filters")
        full = filters.where("full").select("shard")
        anew = self._built(new._shared().select(_shard(self.shards), *_KEY).join(full, "shard", "left_semi"))
        kept = self.filters.join(touched, "shard", "left_anti")
        new.filters = C.materialize(kept.unionByName(filters.where("NOT full").select("shard", "blob")).unionByName(anew), "line-filters")
        return new

    def drops(self) -> DataFrame:
        """(doc_id, k1, k2) of the lines that go: shared, and not of the largest doc_id that holds them."""
        lines = self.lines.withColumn("shard", _shard(self.shards))
        split = C.materialize(lines.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (1.5 * GROUP_ROWS)).cast("int").alias("parts")), "line-shards")
        # a shard with a hot key is dealt to several groups, each with a copy of the shard's filter
        lines = lines.join(split, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        filters = self.filters.join(split, "shard").select("shard", "blob", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        maybe = lines.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInArrow(_probe, "doc_id long, k1 long, k2 long")
        return maybe.join(self._shared(), _KEY).where(F.col("doc_id") < F.col("last_doc")).select("doc_id", *_KEY)


def _refilter(moved: pa.Table, old: pa.Table) -> pa.Table:
    f = CuckooFilter.load(old.column("blob")[0].as_py()) if old.num_rows else CuckooFilter(max(16, moved.num_rows))
    k1, k2, enters = (moved.column(x).to_numpy(zero_copy_only=False) for x in ("k1", "k2", "enters"))
    f.delete(k1[~enters], k2[~enters])
    full = not f.insert(k1[enters], k2[enters])
    return pa.table({"shard": moved.column("shard").slice(0, 1), "blob": pa.array([f.dump()], pa.binary()), "full": pa.array([full])})


def _rebuild(batches: Iterator[pa.RecordBatch], min_chars: int, text_at: int | None, digests: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch, texts in C.pieces([whole], "__text"):
            n_lines, n_dropped, sha, kept = [], [], [], []
            for text, gone in zip(texts, batch.column("__gone").to_pylist(), strict=True):
                lines = text.split(b"\n")
                stay = lines
                if gone:
                    out = {(x["k1"], x["k2"]) for x in gone}
                    stay = [x for x, k in zip(lines, long_keys(text, min_chars), strict=True) if not k or (int.from_bytes(k[:8], "little", signed=True), int.from_bytes(k[8:], "little", signed=True)) not in out]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                body = text if stay is lines else b"\n".join(stay)
                if digests:
                    sha.append(hashlib.sha256(body).hexdigest())
                if text_at is not None:
                    kept.append((body.decode(), stay is lines))
            cols = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n not in ("__text", "__gone")]
            if text_at is not None:
                old = cols[text_at].to_pylist()
                cols[text_at] = pa.array([o if same else t for o, (t, same) in zip(old, kept, strict=True)], pa.string())
            names = [n for n in batch.schema.names if n not in ("__text", "__gone")]
            if digests:
                cols += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())]
                names += ["n_lines", "n_dropped", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def apply_index(docs: DataFrame, index: LineIndex, digests: bool = False) -> DataFrame:
    """docs with the lines that go taken out of text; a document that loses none keeps its text as it is (null stays null).

    digests: return doc_id, n_lines, n_dropped and kept_sha256 instead.
    """
    C.bounded_batches(docs.sparkSession)
    docs, back = C.sheltered(docs)
    gone = index.drops().groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("k1", "k2")).alias("__gone"))
    own, min_chars = docs.select("doc_id", "text") if digests else docs, index.min_chars
    keyed = own.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))).withColumn("__text", F.col("text").cast("string")).join(gone, "__id", "left").drop("__id")
    if digests:
        return keyed.drop("text").mapInArrow(lambda it: _rebuild(it, min_chars, None, True), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    at = docs.columns.index("text")
    return back(keyed.mapInArrow(lambda it: _rebuild(it, min_chars, at, False), docs.schema))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digests: bool = False) -> DataFrame:
    """Index all of docs and drop from each document the lines whose key at least min_docs documents hold, but for the largest doc_id."""
    return apply_index(docs, LineIndex.of(docs, min_chars, min_docs), digests)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, line, lower_ascii AS k FROM (
    SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)))),
r AS (SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.i, l.line, (r.k IS NOT NULL AND l.doc_id < r.last_doc) AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
