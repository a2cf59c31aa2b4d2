"""Operator 2: language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is modelled as its tokens: the words (A-Z lower-cased) joined by single spaces, then an end mark. Each byte is eight
binary choices down a tree of 255 nodes; each context of 0 to `DEPTH` bytes has a zero and one count for each node. A node's
Krichevsky-Trofimov probability is mixed half and half with the product of the next longer contexts', from the longest up, which
mixes all depths by how well each codes the training texts. As that depends on the counts alone, the model is built from the
corpus's counts of (DEPTH + 1)-byte runs, gathered over all training documents, and grows with them.

Distribution: texts are written once as packets (some MB of whole documents each, compressed). A packet's distinct words and
byte runs, with their training counts, go out in groups as compressed arrays: runs by their last two context bytes, words by
hash. A group sums the counts of all packets and weights its contexts; the two top levels (at most 256 * 255 nodes) are
weighted on the driver. Then each packet gets back, in the same arrays, the values of its own keys. No table is broadcast but
those top levels. Words are counted by 64-bit hashes. Values travel as multiples of 2**-36.

The base score is that of single tokens with add-one counts. Both scores are log10 probabilities of the same token sequence.

Cases: null and empty texts are the end mark alone. A null doc_id counts as the empty text in the split. Repeated rows count
and are scored each. Without training documents all bits have probability 1/2 and the base score is 0. An empty table gives an
empty result. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DEPTH, FOLDS, HELD = 6, 7, 2
PACKET_MB, CHUNK_MB = 40.0, 0.8
#: Megabytes of text for each group of byte runs (all contexts that end in the same two bytes are in one), and the keys merged at one go.
GROUP_MB, MAX_GROUPS, MERGE = 6.0, 65_536, 600_000
#: Word keys are negative, byte runs' keys are not; the end mark has the least key.
_END_KEY = -(2**63)
_UNIT = 2.0**36
_HASH = C.RollingHash(2)
_HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up."""
    y = x + 8.0
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046728 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for i in range(8):
        out -= np.log(x + i)
    return out


_SMALL = 1 << 14


@cache
def _small(offset: float) -> np.ndarray:
    return log_gamma(np.arange(_SMALL) + offset)


def _log_gamma_at(n: np.ndarray, offset: float) -> np.ndarray:
    """log_gamma(n + offset) of whole numbers, the small ones from a table."""
    out = _small(offset)[np.minimum(n, _SMALL - 1)]
    large = n >= _SMALL
    out[large] = log_gamma(n[large] + offset)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones (whole numbers)."""
    return _log_gamma_at(a, 0.5) + _log_gamma_at(b, 0.5) - _log_gamma_at(a + b, 1.0) - np.log(np.pi)


def squeezed(x: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte place by byte place."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def widened(blob: bytes) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<i8").ravel()


# ---- packets ----


def _packed(batches: Iterator[pa.RecordBatch], packet_mb: float) -> Iterator[pa.RecordBatch]:
    import zstandard
    from pyspark import TaskContext

    task, squeeze = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
    ids, held, texts, size, n = [], [], [], 0, 0

    def row() -> pa.RecordBatch:
        blob = squeeze.compress(b"\n".join(texts))
        return pa.RecordBatch.from_arrays([pa.array([(task << 32) + n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([blob], pa.binary()), pa.array([size], pa.int64())], names=["packet", "ids", "held", "blob", "size"])

    for b in batches:
        for doc, out, text in zip(*(b.column(x).to_pylist() for x in ("doc_id", "held", "text")), strict=True):
            own = b" ".join(text.encode().lower().split()) if text else b""
            ids.append(doc), held.append(out), texts.append(own)
            size += len(own) + 1
            if size >= packet_mb * 1e6:
                yield row()
                ids, held, texts, size, n = [], [], [], 0, n + 1
    if ids:
        yield row()


def _texts(blob: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob, max_output_size=2**31 - 1).split(b"\n") if blob else [b""]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= CHUNK_MB * 1e6 or i == len(texts) - 1:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, text index) of each word; keys are 63-bit hashes, made negative."""
    hashes, first = C.words_of(texts, _HASH)
    return (hashes | C.U64(1 << 63)).view(np.int64), np.repeat(np.arange(len(texts)), np.diff(first))


def runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, text index) of each byte with the depth bytes before it, the end mark included; a text begins after end marks."""
    gap = b"\n" * depth
    buf = np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8).astype(np.int64)
    size = np.array([len(x) for x in texts])
    key = buf[depth:].copy()
    for j in range(1, depth + 1):
        key |= buf[depth - j : len(buf) - j] << (8 * j)
    # of each text its bytes and the first end mark after them
    keep = np.ones(len(key), dtype=bool)
    ends = np.cumsum(size + depth) - depth
    for j in range(1, depth):
        keep[ends + j] = False
    return key[keep], np.repeat(np.arange(len(texts)), size + 1)


def merged(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their summed counts; some parts at a time, so that what is held follows the distinct keys."""
    keys, counts, held = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0

    def fold() -> None:
        key, n = np.concatenate(keys), np.concatenate(counts)
        keys.clear(), counts.clear()
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        keys[:], counts[:] = [key[first]], [np.add.reduceat(n, first) if len(first) else n]

    for key, n in parts:
        keys.append(key), counts.append(n)
        held += len(key)
        if held >= max(MERGE, len(keys[0]) // 2):
            fold()
            held = 0
    fold()
    return keys[0], counts[0]


def _group_of(key: np.ndarray, groups: int) -> np.ndarray:
    """Byte runs by their last two context bytes, words by hash (in negative groups, one for eight of the runs')."""
    run = (C.mix((key >> 8) & 0xFFFF) % C.U64(groups)).astype(np.int64)
    return np.where(key >= 0, run, -1 - (C.mix(key.view(C.U64)) % C.U64(max(1, groups // 8))).astype(np.int64))


def _features(batches: Iterator[pa.RecordBatch], depth: int, groups: int) -> Iterator[pa.RecordBatch]:
    """(packet, g, keys, n): a packet's distinct keys of each group, in order, and their training counts."""
    for b in batches:
        for packet, held, blob in zip(*(b.column(x).to_pylist() for x in ("packet", "held", "blob")), strict=True):
            train = ~np.array(held)

            def counted(texts: list[bytes], train: np.ndarray = train) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                yield np.array([_END_KEY]), np.array([train.sum()])
                for start, part in _chunks(texts):
                    for key, owner in (words(part), runs(part, depth)):
                        code, distinct = pd.factorize(key)
                        yield distinct, np.bincount(code, weights=train[start + owner], minlength=len(distinct)).astype(np.int64)

            key, n = merged(counted(_texts(blob)))
            g = _group_of(key, groups)
            order = np.argsort(g, kind="stable")
            key, n, g = key[order], n[order], g[order]
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            for at in range(0, len(first), 256):
                own = [slice(s, e) for s, e in zip(first[at : at + 256], np.append(first, len(g))[at + 1 : at + 257], strict=True)]
                cols = [pa.array([packet] * len(own), pa.int64()), pa.array([int(g[x.start]) for x in own], pa.int64()), pa.array([squeezed(key[x]) for x in own], pa.binary()), pa.array([squeezed(n[x]) for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["packet", "g", "keys", "n"])


# ---- the tree ----


class Tree:
    """The contexts of depth to 2 bytes of a group's byte runs (sorted keys and counts), level by level: each level's distinct
    (context, byte), counts, and where the entries of the level below are in it. As bytes are last in a key, the nodes of a bit
    are runs of neighbours at every level."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int):
        self.levels = [(key, n, None)]
        for d in range(depth - 1, 1, -1):
            above, up = np.unique(self.levels[-1][0] & ((1 << (8 * (d + 1))) - 1), return_inverse=True)
            self.levels.append((above, np.bincount(up, weights=self.levels[-1][1], minlength=len(above)).astype(np.int64), up))

    def weighted(self, bit: int) -> Iterator[tuple]:
        """Of each level, deepest first: its nodes' first entries, the node of each entry, counts, log weights, the share of the
        node's own estimate, and the node above each node of the level below."""
        log_w = first = None
        for key, n, up in self.levels:
            nodes = key >> (8 - bit)
            new = np.concatenate(([True], nodes[1:] != nodes[:-1]))
            below, first = first, np.flatnonzero(new)
            of = np.cumsum(new) - 1
            n1 = np.add.reduceat(n * ((key >> (7 - bit)) & 1), first)
            n0 = np.add.reduceat(n, first) - n1
            own = log_kt(n0, n1)
            if log_w is None:
                log_w, share, parent = own, None, None
            else:
                parent = of[up[below]]
                children = np.bincount(parent, weights=log_w, minlength=len(first))
                log_w, share = np.logaddexp(_HALF + own, _HALF + children), sigmoid(own - children)
            yield first, of, n0, n1, log_w, share, parent


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def _summed(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return merged((widened(k.as_py()), widened(n.as_py())) for k, n in zip(group.column("keys"), group.column("n"), strict=True))


def _upper(group: pa.Table, depth: int) -> pa.Table:
    """What a group adds to the nodes of its last byte: counts and the log weighted probability. Of words: all and distinct trained ones, at -1."""
    key, n = _summed(group)
    if group.column("g")[0].as_py() < 0:
        out = np.array([[-1], [-1], [n.sum()], [(n > 0).sum()], [0]])
    else:
        tree, sums = Tree(key, n, depth), np.zeros((3, 1 << 16))
        for bit in range(8):
            for first, _, n0, n1, log_w, *_ in tree.weighted(bit):
                pass
            top = tree.levels[-1][0][first]
            at = ((top >> 8) & 0xFF) << 8 | 1 << bit | (top & 0xFF) >> (8 - bit)
            for row, x in zip(sums, (n0, n1, log_w), strict=True):
                row += np.bincount(at, weights=x, minlength=1 << 16)
        at = np.flatnonzero(sums.any(axis=0))
        out = np.stack([at >> 8, at & 0xFF, *sums[:, at]])
    return pa.table({"last": pa.array(out[0].astype(np.int32)), "node": pa.array(out[1].astype(np.int32)), **{k: pa.array(x.astype(float)) for k, x in zip(("n0", "n1", "lw"), out[2:], strict=True)}})


def top_levels(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(kt1 of one, weight1, kt0 of one, weight0) by (last byte, node) and by node, from the sums over longer contexts."""
    lw, (n0, n1) = np.zeros((256, 256)), np.zeros((2, 256, 256), dtype=np.int64)
    at = rows["last"].to_numpy(), rows["node"].to_numpy()
    n0[at], n1[at], lw[at] = rows["n0"], rows["n1"], rows["lw"]
    own = log_kt(n0, n1)
    own[(n0 + n1) == 0] = 0.0
    log_w = np.logaddexp(_HALF + own, _HALF + lw)
    a0, a1 = n0.sum(axis=0), n1.sum(axis=0)
    root = log_kt(a0, a1)
    return (n1 + 0.5) / (n0 + n1 + 1), sigmoid(own - lw), (a1 + 0.5) / (a0 + a1 + 1), sigmoid(root - log_w.sum(axis=0))


def run_values(key: np.ndarray, n: np.ndarray, depth: int, top: tuple[np.ndarray, ...]) -> np.ndarray:
    """log10 probability of each byte run's last byte after the others, unseen runs included."""
    kt1, w1, kt0, w0 = top
    tree, total = Tree(key, n, depth), np.zeros(len(key))
    for bit in range(8):
        for first, of, n0, n1, _, share, parent in tree.weighted(bit):
            kt = (n1 + 0.5) / (n0 + n1 + 1.0)
            if share is None:
                p, at, deepest, entry = kt, np.arange(len(first)), first, of
            else:
                at = parent[at]
                p = share[at] * kt[at] + (1 - share[at]) * p
        last, node = (key[deepest] >> 8) & 0xFF, 1 << bit | (key[deepest] & 0xFF) >> (8 - bit)
        p = w1[last, node] * kt1[last, node] + (1 - w1[last, node]) * p
        p = w0[node] * kt0[node] + (1 - w0[node]) * p
        one = (key >> (7 - bit)) & 1
        total += np.where(one == 1, np.log10(p)[entry], np.log10(1 - p)[entry])
    return total


def _values(group: pa.Table, depth: int, top: tuple[np.ndarray, ...]) -> pa.Table:
    """(packet, keys, values): what each packet's keys are worth, training counts of words, log10 probabilities of runs in negative units."""
    key, n = _summed(group)
    if group.column("g")[0].as_py() >= 0:
        n = np.rint(run_values(key, n, depth, top) * -_UNIT).astype(np.int64)
    values = [squeezed(n[np.searchsorted(key, widened(k.as_py()))]) for k in group.column("keys")]
    return pa.table({"packet": group.column("packet"), "keys": group.column("keys"), "values": pa.array(values, pa.binary())})


# ---- scoring ----


def places(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the keys are in a sorted table; looked up in their order, so that neighbours are near in memory."""
    order, at = np.argsort(keys), np.empty(len(keys), dtype=np.int64)
    at[order] = np.searchsorted(table, keys[order])
    return at


def _scored(packets: pa.Table, values: pa.Table, depth: int, tokens: int, distinct: int) -> pa.Table:
    out = []
    table = [widened(x) for x in values.column("keys").to_pylist()]
    value = [x if k[0] < 0 else x / -_UNIT for k, x in zip(table, (widened(x) for x in values.column("values").to_pylist()), strict=True)]
    table, value = np.concatenate(table), np.concatenate(value)
    order = np.argsort(table)
    table, value = table[order], value[order]
    floor = np.log10(tokens + distinct + 1)
    for ids, held, blob in zip(*(packets.column(x).to_pylist() for x in ("ids", "held", "blob")), strict=True):
        texts = _texts(blob)
        for start, part in _chunks(texts):
            m = len(part)

            def looked_up(found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
                code, uniq = pd.factorize(found[0])
                at = places(table, uniq)
                if len(uniq) and not np.array_equal(table[np.minimum(at, len(table) - 1)], uniq):
                    raise RuntimeError("a packet lacks values of its own keys")
                return value[at][code], found[1]

            count, owner = looked_up(words(part))
            end_count = float(value[0])  # the end mark's key is the least
            n_tokens = np.bincount(owner, minlength=m) + 1
            n_known = np.bincount(owner, weights=count > 0, minlength=m) + (end_count > 0)
            base = np.bincount(owner, weights=np.log10(count + 1), minlength=m) + np.log10(end_count + 1) - n_tokens * floor
            logs, owner = looked_up(runs(part, depth))
            total, n_bytes = np.bincount(owner, weights=logs, minlength=m), np.bincount(owner, minlength=m)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(ids[start : start + m], pa.int64()),
                        "held_out": pa.array(held[start : start + m]),
                        "n_tokens": pa.array(n_tokens.astype(np.int64)),
                        "n_known": pa.array(n_known.astype(np.int64)),
                        "train_tokens": pa.array(np.full(m, tokens, dtype=np.int64)),
                        "base_score": pa.array(base),
                        "score": pa.array(total),
                        "n_bytes": pa.array(n_bytes.astype(np.int64)),
                        "bits_per_byte": pa.array(-total / np.log10(2) / n_bytes),
                    }
                )
            )
    return pa.concat_tables(out)


def score(docs: DataFrame, depth: int = DEPTH, packet_mb: float = PACKET_MB) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of each row."""
    if not 2 <= depth <= 6:  # a key of 8 bytes could be negative, as word keys are
        raise ValueError("depth must be 2 to 6 bytes")
    C.bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (C.hash_id(F.col("doc_id")) % FOLDS == HELD).alias("held"), F.col("text").cast("string").alias("text"))
    packets = C.materialize(own.mapInArrow(lambda it: _packed(it, packet_mb), "packet long, ids array<long>, held array<boolean>, blob binary, size long"), "packets")
    size = packets.agg(F.sum("size")).first()[0] or 0
    groups = int(min(MAX_GROUPS, max(1, size // (GROUP_MB * 1e6))))
    found = C.materialize(packets.select("packet", "held", "blob").mapInArrow(lambda it: _features(it, depth, groups), "packet long, g long, keys binary, n binary"), "features")
    upper = found.drop("packet").groupBy("g").applyInArrow(lambda t: _upper(t, depth), "last int, node int, n0 double, n1 double, lw double")
    nodes = upper.groupBy("last", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("lw")).toPandas()  # 256 * 255 rows at most
    stats, nodes = nodes[nodes["last"] < 0], nodes[nodes["last"] >= 0]
    tokens, distinct = int(stats["n0"].sum()), int(stats["n1"].sum())
    top = top_levels(nodes)
    values = found.groupBy("g").applyInArrow(lambda t: _values(t, depth, top), "packet long, keys binary, values binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return packets.drop("size").groupBy("packet").cogroup(values.groupBy("packet")).applyInArrow(lambda a, b: _scored(a, b, depth, tokens, distinct), schema)
