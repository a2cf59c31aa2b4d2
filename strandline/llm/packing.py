"""Operator 9: best-fit packing of token sequences, improved by swaps between underfull bins.

Lengths are whole numbers of 1 to `size` tokens, so a corpus of any size packs as its histogram: bins that hold the same
lengths are one group with a count. The driver sees at most `size` counts and a plan of groups, never a row for each
document. Best fit (longest first) fills the bins; then a local search takes the emptiest underfull bins and moves one item,
swaps one for one, or swaps two for one, whenever the sum of squared fills grows, until bins empty or nothing grows. Each
piece then finds its bin by its length and its ordinal among the pieces of that length.

Cases: null or empty text is one piece, the end token alone. Repeated rows and doc_ids are packed as rows of their own; null
doc_ids stay null. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import logging
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import tokens

SIZE, END_ID = 1024, 2
#: Rows dealt to a bucket of ordinals.
BUCKET_ROWS = 50_000
_LOG = logging.getLogger(__name__)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: whole ones of `size`, the first one what is left over."""
    k = max(1, -(-n // size))
    first = n - size * (k - 1)
    return [(0, first)] + [(first + size * i, size) for i in range(k - 1)]


def _tokenized(batches: Iterator[pa.RecordBatch], size: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = tokens.chunk_encoder().encode
    end = np.array([END_ID], dtype="<u4").tobytes()
    for batch in batches:
        docs, piece, start, length, crc, blobs = [], [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text or "") + end
            for i, (s, n) in enumerate(cut(len(ids) // 4, size)):
                own = ids[4 * s : 4 * (s + n)]
                docs.append(doc)
                piece.append(i)
                start.append(s)
                length.append(n)
                crc.append(zlib.crc32(own))
                if with_ids:
                    blobs.append(own)
        cols = [pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols + [pa.array(blobs, pa.binary())] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)


class Bins:
    """Groups of bins with the same contents: {sorted lengths: number of bins}."""

    def __init__(self, size: int):
        self.size, self.groups = size, Counter()

    def add(self, items: tuple[int, ...], n: int) -> None:
        if items and n:
            self.groups[tuple(sorted(items, reverse=True))] += n

    def take(self, items: tuple[int, ...], n: int) -> None:
        self.groups[items] -= n
        if not self.groups[items]:
            del self.groups[items]

    def count(self) -> int:
        return sum(self.groups.values())


def best_fit(counts: dict[int, int], size: int) -> Bins:
    """Longest first, each into the bin with the least room that holds it; bins with the same contents at one go."""
    out = Bins(size)
    room: dict[int, Counter] = {}  # free tokens -> contents -> bins

    def put(items: tuple[int, ...], left: int, n: int) -> None:
        if left:
            room.setdefault(left, Counter())[items] += n
        else:
            out.add(items, n)

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            fits = min((x for x in room if x >= length), default=None)
            if fits is None:
                items, left, bins = (), size, n
            else:
                items, bins = next(iter(room[fits].items()))
                left = fits
            each = min(left // length, n)
            bins = min(bins, n // each)
            if fits is not None:
                room[fits][items] -= bins
                if not room[fits][items]:
                    del room[fits][items]
                if not room[fits]:
                    del room[fits]
            put(items + (length,) * each, left - each * length, bins)
            n -= bins * each
    for left in room.values():
        for items, n in left.items():
            out.add(items, n)
    return out


def _swaps(a: tuple[int, ...], b: tuple[int, ...], slack: int) -> Iterator[tuple[int, tuple, tuple]]:
    """(tokens that b gains, items that leave a, items that leave b) of the moves that fit: 1-0, 1-1, 2-1 and 1-2."""
    ones, others = sorted(set(a)), sorted(set(b))
    have, has = Counter(a), Counter(b)
    twos = [(x, y) for i, x in enumerate(ones) for y in ones[i:] if x != y or have[x] > 1]
    pairs = [(x, y) for i, x in enumerate(others) for y in others[i:] if x != y or has[x] > 1]
    for x in ones:
        if x <= slack:
            yield x, (x,), ()
        for y in others:
            if 0 < x - y <= slack:
                yield x - y, (x,), (y,)
        for p in pairs:
            if 0 < x - sum(p) <= slack:
                yield x - sum(p), (x,), p
    for t in twos:
        for y in others:
            if 0 < sum(t) - y <= slack:
                yield sum(t) - y, t, (y,)


def _without(items: tuple[int, ...], gone: tuple[int, ...]) -> tuple[int, ...]:
    left = list(items)
    for x in gone:
        left.remove(x)
    return tuple(left)


class Sums:
    """What can leave some contents: single items, and single items or pairs, as bits by their sum."""

    def __init__(self, items: tuple[int, ...]):
        have = Counter(items)
        self.fill, self.ones = sum(items), sorted(have)
        self.pairs = sorted({x + y for i, x in enumerate(self.ones) for y in self.ones[i:] if x != y or have[x] > 1})
        self.one = sum(1 << x for x in self.ones)
        self.any = self.one | sum(1 << x for x in self.pairs if x not in have)


def helps(a: Sums, b: Sums, size: int) -> bool:
    """Whether some move or swap from a to b raises the sum of squares: b gains tokens, no more than it has room for, and more than a is ahead."""
    low = max(1, a.fill - b.fill + 1)
    wanted = (1 << max(0, size - b.fill - low + 1)) - 1
    if not wanted:
        return False
    return bool(a.one >> low & wanted) or any(a.any >> y + low & wanted for y in b.ones) or any(a.one >> p + low & wanted for p in b.pairs)


def improve(bins: Bins, moves: int | None = None) -> Bins:
    """Swap-based local search over underfull bins; stops at the least possible number of bins, or when no swap helps.

    Contents are numbered as they arrive (the fullest first), and each keeps up to which number no swap with the others helps, so
    no two contents are tried twice. Each move raises the sum of the squares of the bins' contents, so it ends. A bound on moves,
    if given, is logged when met.
    """
    total = sum(sum(k) * n for k, n in bins.groups.items())
    least, count, size = -(-total // bins.size), bins.count(), bins.size
    arrivals: list[tuple[int, ...]] = []
    number: dict[tuple[int, ...], int] = {}
    tried: dict[tuple[int, ...], int] = {}
    sums: dict[tuple[int, ...], Sums] = {}
    order: list[tuple[int, tuple[int, ...]]] = []

    def arrive(items: tuple[int, ...]) -> None:
        if items not in sums:
            sums[items] = Sums(items)
        if sums[items].fill < size:
            number[items] = len(arrivals)
            arrivals.append(items)
            at = bisect.bisect_left(order, (sums[items].fill, items))
            if at == len(order) or order[at][1] != items:
                order.insert(at, (sums[items].fill, items))

    def put(items: tuple[int, ...], n: int) -> None:
        items = tuple(sorted(items, reverse=True))
        had = bins.groups.get(items, 0)
        bins.add(items, n)
        if items and (not had or had == 1):
            arrive(items)

    def drop(items: tuple[int, ...], n: int) -> None:
        bins.take(items, n)
        if items not in bins.groups:
            order.pop(bisect.bisect_left(order, (sums[items].fill, items)))

    def partner(a: tuple[int, ...]) -> tuple[int, ...] | None:
        for at in range(tried.get(a, 0), len(arrivals)):
            b = arrivals[at]
            if number[b] == at and bins.groups.get(b, 0) > (a == b) and helps(sums[a], sums[b], size):
                tried[a] = at
                return b
        tried[a] = len(arrivals)
        return None

    for items in sorted(bins.groups, key=lambda k: (-sum(k), k)):
        arrive(items)
    while count > least:
        a, b = next(((a, b) for _, a in order if tried.get(a, 0) < len(arrivals) and (b := partner(a)) is not None), (None, None))
        if b is None:
            break
        if moves == 0:
            _LOG.warning("packing stopped at its bound on moves with %d sequences; %d is the least possible", count, least)
            break
        ahead = sums[b].fill - sums[a].fill
        _, _, out, back = max((2 * d * (ahead + d), d, out, back) for d, out, back in _swaps(a, b, size - sums[b].fill) if ahead + d > 0)
        n = bins.groups[a] // 2 if a == b else min(bins.groups[a], bins.groups[b])
        drop(a, n)
        drop(b, n)
        rest = _without(a, out) + back
        count -= 0 if rest else n
        put(rest, n)
        put(_without(b, back) + out, n)
        moves = None if moves is None else moves - 1
    return bins


def plan(counts: dict[int, int], size: int = SIZE, moves: int | None = None) -> Bins:
    return improve(best_fit({k: n for k, n in counts.items() if n}, size), moves)


def slots(bins: Bins) -> np.ndarray:
    """Rows (length, first ordinal, first sequence, offset), sorted: pieces of a length go to bins by their ordinal."""
    used, rows, base = Counter(), [], 0
    for items, n in sorted(bins.groups.items(), reverse=True):
        at = 0
        for x in items:
            rows.append((x, used[x], base, at))
            used[x] += n
            at += x
        base += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _placed(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (table[:, 0] << 48) + table[:, 1]
    for b in batches:
        nth = b.column("__nth").to_numpy()
        at = np.searchsorted(keys, (b.column("length").to_numpy() << 48) + nth, side="right") - 1
        rest = [n for n in b.schema.names if n != "__nth"]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in rest] + [pa.array(table[at, 2] + nth - table[at, 1]), pa.array(table[at, 3])], names=[*rest, "sequence_id", "offset"])


def pack(docs: DataFrame, size: int = SIZE, with_ids: bool = False, moves: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece (and its ids as 32-bit bytes)."""
    C.bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    made = C.materialize(own.mapInArrow(lambda it: _tokenized(it, size, with_ids), schema), "pieces")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    table = slots(plan(counts, size, moves))
    buckets = max(1, math.ceil(sum(counts.values()) / BUCKET_ROWS))
    dealt = made.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    key = ["length", "__bucket"]
    before = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("__n")).drop("__n")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "start", "ids_crc32"))
    placed = dealt.withColumn("__nth", nth.cast("long")).join(before, key).withColumn("__nth", F.col("__before") + F.col("__nth") - 1).drop("__before", "__bucket")
    order = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return placed.select(*order, "__nth").mapInArrow(lambda it: _placed(it, table), schema + ", sequence_id long, offset long")
