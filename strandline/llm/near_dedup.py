"""Operator 5: near-duplicate classes by DartMinHash signatures, banded joining and exact links.

A document is a weighted set: its runs of five words (lower-cased ASCII letters, split at ASCII white space), weighted by how
often they occur; a text of one to four words has one run. Each element owns strips of weight [0,1), [1,2), [2,4), ...; a
hash throws darts into a strip as a Poisson process over rank. Darts inside the element's weight count, each falls on one of
the signature's coordinates, and the earliest stays. Two sets agree at a coordinate with their weighted Jaccard similarity.

Exact copies fold to one node first. Nodes that share a band meet in a bucket. Each bucket holds one pivot against its members by
the exact weighted Jaccard similarity: a comparison a member, whatever the group's size. Pivots are least by one order of all
nodes, so a group of copies meets the same pivot in most of its bands and each pair is tested once. The links are contracted:
only one link for two components goes on, and only buckets that still hold several components. These are compared in blocks of
bounded size, a bucket's rows outside its largest component against all its rows, by sketches of 1024 coordinates. In `ROUNDS`
rounds each row's best partner in another component is verified exactly and the links are contracted again; in the last round
all pairs of different components are verified, each in the first band it shares only, whose sketches agree in no fewer places
than five standard deviations below the similarity's mean (0.74 for 0.8; six for the first 256 coordinates, compared before). No
partner is capped and no group meets in one task. Classes are the components of the verified links.

Cases: null and empty texts, and texts of white space alone, are each a class of their own. Null doc_ids take part like others;
a class's id is the smallest doc_id in it, null if all are null. Repeated rows are copies. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
#: Coordinates of a sketch and of the part compared first, the standard deviations that their estimates may fall short by, and the rows of a block.
#: At exactly 0.8, the whole sketch loses a link with a chance of 5.1e-7, the part with one of 5.3e-9.
SKETCH, PART, SLACK, PART_SLACK, BLOCK = 1024, 256, 5.0, 6.0, 4096
#: Rounds of best partners before all partners, and the darts thrown at one go (some ten arrays of so many numbers are held).
ROUNDS, DARTS = 1, 300_000
_HASH = C.RollingHash(5)
_U = C.U64


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def strips(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(element, level) of the strips that an element's weight reaches: level 0 is [0,1), level v is [2**(v-1), 2**v)."""
    element, level = [np.arange(len(values))], [np.zeros(len(values), dtype=np.int64)]
    v = 1
    while len(high := np.flatnonzero(weights > 2.0 ** (v - 1))):
        element.append(high)
        level.append(np.full(len(high), v))
        v += 1
    return np.concatenate(element), np.concatenate(level)


def throws(k: int) -> float:
    """The darts that fill k coordinates but for a chance of about e**-2."""
    return k * np.log(k) + 2 * k


#: Chances of at most 0, 1, 2, ... darts in a cell that holds one on average.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 20.0)))))


def darts(values: np.ndarray, weights: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, rank, id) of the darts with rank up to limit (for each element) inside the elements' weights.

    A strip's ranks are cut into cells of one dart on average; a cell's hash says how many it holds and where they fall. So all
    cells are thrown at together, as many as there are darts to expect, whether they belong to one element or to many.
    """
    element, level = strips(values, weights)
    width = np.where(level == 0, 1.0, 2.0 ** (level - 1.0))
    low = np.where(level == 0, 0.0, width)
    cells = np.ceil(limit[element] * width).astype(np.int64)
    strip = np.repeat(np.arange(len(element)), cells)
    cell = np.arange(len(strip)) - np.repeat(np.cumsum(cells) - cells, cells)
    with np.errstate(over="ignore"):
        key = C.mix(values[element] + level.astype(_U) * _U(0x9E3779B97F4A7C15))
        h = C.mix(key[strip] + (2 * cell + 1).astype(_U) * _U(0xD1B54A32D192ED03))
    count = np.searchsorted(_POISSON, uniform(h), side="right")
    out = []
    for d in range(int(count.max(initial=0))):
        on = np.flatnonzero(count > d)
        of = strip[on]
        with np.errstate(over="ignore"):
            mark = C.mix(h[on] + _U((d + 1) * 0x8CB92BA72F3D8DD7 % 2**64))
        rank = (cell[on] + uniform(mark)) / width[of]
        inside = (low[of] + width[of] * uniform(C.mix(mark)) < weights[element[of]]) & (rank <= limit[element[of]])
        out.append((element[of[inside]], rank[inside], C.mix(mark[inside] ^ _U(0x5A5A5A5A))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0), np.zeros(0, _U))


def earliest(place: np.ndarray, rank: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that occur, and the index of the least rank (0 to 1) of each, by one sort of numbers of place, rank and index.

    Ranks closer than the bits that are left for them (28 for 64 thousand places and half a million darts) count as equal, and the first is taken.
    """
    bits_i, bits_p = max(1, len(place)).bit_length(), max(1, places).bit_length()
    bits_r = 64 - bits_i - bits_p
    at = np.minimum((rank * 2.0**bits_r).astype(_U), _U(2**bits_r - 1))
    packed = np.sort((place.astype(_U) << _U(bits_r + bits_i)) | (at << _U(bits_i)) | np.arange(len(place), dtype=_U))
    of = packed >> _U(bits_r + bits_i)
    first = packed[np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))] if len(packed) else packed
    return (first >> _U(bits_r + bits_i)).astype(np.int64), (first & _U(2**bits_i - 1)).astype(np.int64)


def signatures(values: np.ndarray, weights: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """k coordinates for each set (bounds in at): the id of the earliest dart on each. Sets without elements have zeros."""
    n = len(at) - 1
    size = np.diff(at)
    owner = np.repeat(np.arange(n), size)
    total = np.bincount(owner, weights=weights, minlength=n)
    out = np.zeros((n, k), dtype=_U)
    filled = np.zeros((n, k), dtype=bool)
    filled[size == 0] = True
    thrown = throws(k)
    todo = np.flatnonzero(size > 0)
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < n else slice(None)
        v, w, o = values[mine], weights[mine], owner[mine]
        element, rank, mark = darts(v, w, thrown / total[o])
        place = o[element] * k + (C.mix(mark ^ _U(0xA5A5A5A5)) % _U(k)).astype(np.int64)
        new = np.zeros(n * k, dtype=_U)
        hit = np.zeros(n * k, dtype=bool)
        place, first = earliest(place, rank * (total[o] / thrown)[element], n * k)
        new[place], hit[place] = mark[first], True
        take = hit.reshape(n, k) & ~filled
        out[take] = new.reshape(n, k)[take]
        filled |= take
        todo = np.flatnonzero(~filled.all(axis=1))
        thrown *= 2
    return out


def counted(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each set, their counts, and the sets' bounds."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])))) if len(v) else np.zeros(0, int)
    counts = np.diff(np.append(first, len(v))).astype(np.float64)
    return v[first], counts, np.searchsorted(o[first], np.arange(len(at)))


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _longs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def _signed(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for b, texts in C.pieces(batches, mb=0.4, rows=int(DARTS / throws(bands * rows))):
        runs, at = C.windows(*C.words_of([x.lower() for x in texts], _HASH), words)
        sig = signatures(*counted(runs, at), bands * rows).reshape(len(texts), bands, rows)
        band = np.zeros((len(texts), bands), dtype=_U)
        with np.errstate(over="ignore"):
            for r in range(rows):
                band = C.mix(band + sig[:, :, r] + _U(r + 1))
            band = C.mix(band + np.arange(bands, dtype=_U))
        size = np.diff(at)
        held = np.repeat(size > 0, bands)
        ends = np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0))))
        yield pa.RecordBatch.from_arrays([b.column("__row"), b.column("doc_id"), *_halves([_digest(x) for x in texts]), pa.array(size.astype(np.int64)), _longs(band.ravel()[held], ends)], names=["__row", "doc_id", "d1", "d2", "n", "bands"])


def _elements(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b, texts in C.pieces(batches, mb=0.2, rows=int(DARTS / throws(SKETCH))):
        runs, at = C.windows(*C.words_of([x.lower() for x in texts], _HASH), words)
        sketch = signatures(*counted(runs, at), SKETCH).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([*_halves([_digest(x) for x in texts]), _longs(C.occurrence_hashes(runs, at), at), pa.array([x.tobytes() for x in sketch], pa.binary())], names=["d1", "d2", "elements", "sketch"])


def _least(k: int, similarity: float) -> int:
    """The places of k in which two sketches of the similarity agree at least."""
    return int(k * similarity - (SLACK if k == SKETCH else PART_SLACK) * (k * similarity * (1 - similarity)) ** 0.5)


def _near_in_block(ask: pd.DataFrame, all_: pd.DataFrame, similarity: float, best: bool) -> list[tuple[np.ndarray, ...]]:
    """Pairs of rows of one bucket, in different components, whose sketches agree often enough, in the first band they share only; best: of each asking row the one that agrees most."""
    a, b = (np.stack([np.frombuffer(x, dtype=np.uint8) for x in t["sketch"]]) for t in (ask, all_))
    bands_a, bands_b = (np.stack(t["bands"].to_list()) for t in (ask, all_))
    node_a, node_b, label_a, label_b, n_a, n_b = (t[x].to_numpy() for x in ("node", "label", "n") for t in (ask, all_))
    main = ask["main"].iloc[0]
    band = int(ask["band"].iloc[0])
    out = []
    for k in range(len(a)):
        fits = (label_b != label_a[k]) & ((label_b == main) | (node_a[k] < node_b)) & (np.minimum(n_b, n_a[k]) >= similarity * np.maximum(n_b, n_a[k]))
        at = np.flatnonzero(fits)
        for width in (PART, SKETCH):
            at = at[(b[at, :width] == a[k, :width]).sum(axis=1) >= _least(width, similarity)]
        at = at[~(bands_b[at, :band] == bands_a[k, :band]).any(axis=1)] if band else at
        if best and len(at) > 1:
            at = at[[(b[at] == a[k]).sum(axis=1).argmax()]]
        if len(at):
            x, y, nx, ny = np.full(len(at), node_a[k]), node_b[at], np.full(len(at), n_a[k]), n_b[at]
            swap = x > y
            out.append((np.where(swap, y, x), np.where(swap, x, y), np.where(swap, ny, nx), np.where(swap, nx, ny)))
    return out


def _blocks(group: pa.Table, similarity: float, best: bool) -> pa.Table:
    rows = group.to_pandas()
    out = []
    for _, part in rows.groupby(["bucket", "i", "j"], sort=False):
        ask, all_ = part[part["asks"]], part[~part["asks"]]
        if len(ask) and len(all_):
            out += _near_in_block(ask, all_, similarity, best)
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 4
    return pa.table({k: pa.array(c.astype(np.int64)) for k, c in zip(("a", "b", "na", "nb"), cols, strict=True)})


def _rest_pairs(rest: DataFrame, nodes: DataFrame, elements: DataFrame, similarity: float, best: bool) -> DataFrame:
    """Candidate pairs among the rows (bucket, band, node, n, label) that buckets still hold in several components."""
    by = rest.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"))
    main = by.groupBy("bucket").agg(F.max(F.struct("m", "label")).alias("x"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    main = main.select("bucket", F.col("x.label").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("mj"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("x.m")) / BLOCK)).cast("int").alias("mi"))
    rows = rest.join(main, "bucket").join(nodes.select("node", "bands"), "node").join(elements.select("node", "sketch"), "node")
    chunk = F.xxhash64("node", "bucket")
    keep = ["bucket", "band", "node", "n", "label", "main", "bands", "sketch"]
    ask = rows.where("label <> main").select(*keep, F.pmod(chunk, F.col("mi")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("mj") - 1)).alias("j"), F.lit(True).alias("asks"))
    all_ = rows.select(*keep, F.explode(F.sequence(F.lit(0), F.col("mi") - 1)).alias("i"), F.pmod(chunk, F.col("mj")).cast("int").alias("j"), F.lit(False).alias("asks"))
    both = C.materialize(ask.unionByName(all_), "blocks")
    slots = max(1, both.count() // BLOCK)
    dealt = both.withColumn("slot", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(slots)))
    return dealt.groupBy("slot").applyInArrow(lambda t: _blocks(t, similarity, best), "a long, b long, na long, nb long").distinct()


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the links and the smallest node of each one's component: roots hook to smaller ones, and paths are cut short."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        differ = lx != ly
        if not differ.any():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(lx, ly)[differ], np.minimum(lx, ly)[differ])
        while (label[label] != label).any():
            label = label[label]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in united(*(np.concatenate(x) for x in zip(*held, strict=True)))], names=["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each end of a link (a, b), the smallest node of its component.

    Each task unites the links it reads and gives on one link for each node, to the smallest it reaches; rounds of lowest
    neighbours and label jumps over all tasks unite the rest.
    """
    links = C.materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    stars = links.mapInArrow(_united, "node long, label long").where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))
    links = C.materialize(stars.distinct(), "links")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = C.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("label").alias("near"))
        low = label.join(near, label.node == near.a).select("node", "label", F.least("label", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = C.materialize(low.join(jump, "low").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("label")).alias("moved")), "labels")
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            return label


def _pairs(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b, na, nb): members beside the pivots of their bucket, once each, unless they are in one component or their sizes rule out the similarity."""
    low = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node").alias("turn"), "node", "n", "label")).alias("p"))
    pivots = low.select("bucket", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.label").alias("pivot_label"))
    both = members.join(pivots, "bucket").where("label <> pivot_label")
    fits = both.where(F.least("n", "pivot_n") >= similarity * F.greatest("n", "pivot_n"))
    first = F.col("node") < F.col("pivot")
    return fits.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), F.when(first, F.col("n")).otherwise(F.col("pivot_n")).alias("na"), F.when(first, F.col("pivot_n")).otherwise(F.col("n")).alias("nb")).distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members with their labels, of the buckets that still hold several components."""
    now = members.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = now.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket")
    return C.materialize(now.join(several, "bucket", "left_semi"), "open")


def _contracted(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after more links: each link joins the components of its ends, two components once."""
    if labels is None:
        return components(links)
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    merged = components(ends.where("a <> b"))
    now = labels.unionByName(merged.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    return C.materialize(now.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _linked(pairs: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    a = elements.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    b = elements.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    common = F.size(F.array_intersect("ea", "eb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", common.alias("c")).where(F.col("c") >= similarity * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def near_rows(rows: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """rows: __row (unique), doc_id, text. Returns __row, doc_id and node, the smallest __row of its class."""
    C.bounded_batches(rows.sparkSession)
    own = rows.select("__row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = own.mapInArrow(lambda it: _signed(it, words, bands, per_band), "__row long, doc_id long, d1 long, d2 long, n long, bands array<long>")
    signed = C.materialize(signed, "signatures")
    key = ["d1", "d2"]
    nodes = signed.where("n > 0").groupBy(*key).agg(F.min(F.struct("__row", "doc_id")).alias("first"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    nodes = C.materialize(nodes.select(*key, F.col("first.__row").alias("node"), F.col("first.doc_id").alias("doc_id"), "n", "bands"), "nodes")

    members = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    members = C.materialize(members.join(shared, "bucket").withColumn("label", F.col("node")), "buckets")
    involved = members.select("node").distinct().join(nodes.select("node", "doc_id", *key), "node")
    texts = own.join(involved.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    found = texts.mapInArrow(lambda it: _elements(it, words), "d1 long, d2 long, elements array<long>, sketch binary")
    elements = C.materialize(found.join(involved.select("node", *key), key).select("node", "elements", "sketch").dropDuplicates(["node"]), "elements")

    labels = _contracted(None, C.materialize(_linked(_pairs(members, similarity), elements, similarity), "near-links"))
    for best in [True] * ROUNDS + [False]:
        members = _open(members, labels)
        more = C.materialize(_linked(_rest_pairs(members, nodes, elements, similarity, best), elements, similarity), "near-links")
        if not more.isEmpty():
            labels = _contracted(labels, more)
    of = nodes.select(*key, "node").join(labels, "node", "left").select(*key, F.coalesce("label", "node").alias("node"))
    return signed.select("__row", "doc_id", *key, "n").join(of, key, "left").select("__row", "doc_id", F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("__row")).alias("node"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and class_size (rows) of each row."""
    rows = docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id())
    of = C.materialize(near_rows(rows, similarity, words), "classes")
    classes = of.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return of.join(classes, "node").select("doc_id", "class_id", "class_size")


def drop_near(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """docs without the near copies: of each class the row with the smallest doc_id stays, whole (the first written of repeats)."""
    own, back = C.sheltered(docs)
    rows = C.materialize(own.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    of = near_rows(rows.select("__row", "doc_id", "text"), similarity, words)
    stay = of.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("stay")).select(F.col("stay.__row").alias("__row"))
    return back(rows.join(stay, "__row", "left_semi").drop("__row"))


def oracle(similarity: float = SIMILARITY, words: int = WORDS) -> str:
    """The definition in DuckDB SQL: all pairs of texts that share a run, their exact similarity, and the components of the links."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT r, w[i:i + {words - 1}] AS x, count(*) AS c FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS i FROM w WHERE len(w) > 0) GROUP BY ALL),
n AS (SELECT r, sum(c) AS n FROM sh GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, sum(least(a.c, b.c)) AS m FROM sh a JOIN sh b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE m >= {similarity} * (x.n + y.n - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(r, root) AS (SELECT r, r FROM w UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.r),
c AS (SELECT r, min(root) AS root FROM reach GROUP BY r)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, count(*) OVER (PARTITION BY root) AS class_size FROM w JOIN c USING (r)
"""
