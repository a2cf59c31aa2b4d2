"""Operator 7: substring dedup by sliding sentence spans.

A sentence ends at a word that ends in `.`, `!` or `?`, or at a line's end. Running text is cut further: of each `GAP`
consecutive words none of which ends a sentence, the one with the least hash (of equal ones the last) ends one. So no sentence
is longer than `GAP` words, and a cut depends on fewer than `GAP` words to each side, never on the sentence around a passage.

From every sentence of every document starts one span: the shortest run of consecutive sentences that holds at least
`min_words` words. Its hash (128 bits, over the words with A-Z lower-cased) depends on the run alone, so the spans of a passage
that two documents share meet in a global join. The first span, by (doc_id, place), stays; all sentences that any other span
covers are removed. The spans of a longer run cover all of it but less than one sentence at its end, so of a repeated passage
of at least `min_words + 3 * GAP` words fewer than `3 * GAP` words stay: a sentence at its start, two at its end.

Cases: null doc_ids come last in the order. Rows with the same doc_id and text are one document: each gets the same result.
Null, empty and blank texts have no sentences and stay as they are. An empty table gives an empty result. Texts of any length
are taken whole; hot passages are met by aggregates and joins that split, never by one group in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS, GAP = 20, 6
_HASH, _SECOND = C.RollingHash(7), C.RollingHash(77)
_STOPS = np.isin(np.arange(256), np.frombuffer(b".!?", dtype=np.uint8))
_MULTIPLIERS = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)


def least_of_windows(values: np.ndarray, k: int) -> np.ndarray:
    """The place of the least value (by its upper 32 bits, of equal ones the last) of each window of k values."""
    n = len(values)
    if n < k:
        return np.zeros(0, dtype=np.int64)
    low = C.U64(0xFFFFFFFF)
    least, held = (values & ~low) | (low - np.arange(n, dtype=C.U64)), 1
    while held < k:
        step = min(held, k - held)
        least, held = np.minimum(least[:-step], least[step:]), held + step
    return (low - (least & low)).astype(np.int64)


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each sentence and the end, byte start of each sentence in its text, text of each sentence, word hashes)."""
    buf, at = C.joined([x.lower() for x in texts])
    return _cut(buf, at, *C.word_bounds(buf))


def _cut(buf: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes = _HASH.ranges(_HASH.sums(buf), starts, ends)
    # a sentence ends at a stop, or where a newline comes before the next word
    lines = np.concatenate(([0], np.cumsum(buf == 10)))
    following = np.append(starts[1:], len(buf))
    last = _STOPS[buf[ends - 1]] | (lines[following] > lines[ends]) if len(ends) else np.zeros(0, dtype=bool)
    last[least_of_windows(np.where(last, C.U64(0), hashes), GAP)] = True
    first = np.concatenate(([0], np.flatnonzero(last) + 1)) if len(ends) else np.zeros(1, dtype=np.int64)
    if len(ends) and not last[-1]:
        first = np.append(first, len(ends))
    begin = starts[first[:-1]] if len(ends) else np.zeros(0, dtype=np.int64)
    text = np.searchsorted(at, begin, side="right") - 1
    return first, begin - at[text], text, hashes


def _run_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray, multiplier: int) -> np.ndarray:
    n = len(words)
    with np.errstate(over="ignore"):
        up = np.full(n + 1, multiplier, dtype=C.U64)
        up[0] = 1
        down = np.full(n + 1, pow(multiplier, -1, 2**64), dtype=C.U64)
        down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        sums = np.concatenate((np.zeros(1, dtype=C.U64), np.cumsum(C.mix(words + C.U64(multiplier)) * up[:n])))
        return C.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(C.U64))


def spans(texts: list[bytes], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first sentence within the text, sentences, two hashes) of the span that starts at each sentence, where the text has the words for it."""
    buf, at = C.joined([x.lower() for x in texts])
    starts, ends = C.word_bounds(buf)
    first, _, text, words = _cut(buf, at, starts, ends)
    if not len(text):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    begin, end = first[:-1], first[1:]
    last = np.searchsorted(end, begin + min_words)
    fits = last < len(end)
    fits[fits] = text[last[fits]] == text[fits]
    i, last = np.flatnonzero(fits), last[fits]
    nth = i - np.searchsorted(text, text[i])
    both = words, _SECOND.ranges(_SECOND.sums(buf), starts, ends)  # two hashes of each word, so that the two of a run are independent
    return text[i], nth, last - i + 1, *(_run_hashes(w, begin[i], end[last], m).view(np.int64) for w, m in zip(both, _MULTIPLIERS, strict=True))


def _key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _spans(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for b, texts in C.pieces(batches, mb=1.0):
        text, nth, n, h1, h2 = spans(texts, min_words)
        take = pa.array(text)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("__key").take(take), pa.array(nth.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h1), pa.array(h2)], names=["doc_id", "__key", "i", "n", "h1", "h2"])


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, __key, i, n): the non-first occurrences of spans that occur more than once anywhere; __id is the doc_id.

    The hashes that repeat are written first, so that both joins are between plain shuffles, which Spark splits where a span is hot.
    """
    C.bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("__key", _key())
    found = own.mapInArrow(lambda it: _spans(it, min_words), "doc_id long, __key long, i int, n int, h1 long, h2 long")  # made twice, which spares its table on disk
    more = C.materialize(found.groupBy("h1").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h1"), "repeated-hashes")
    shared = C.materialize(found.join(more, "h1"), "shared-spans")
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "__key", "i")
    first = C.materialize(shared.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "first-spans")
    return shared.join(first, ["h1", "h2"]).where(F.col("first") < order).select(F.col("doc_id").alias("__id"), "__key", "i", "n")


def _rebuilt(batches: Iterator[pa.RecordBatch], report: bool, at: int) -> Iterator[pa.RecordBatch]:
    for b, texts in C.pieces(batches, mb=1.0):
        first, begin, owner, _ = sentences(texts)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        n_words = np.diff(first) if len(owner) else np.zeros(0, dtype=np.int64)
        total, removed, words, ranges, out = [], [], [], [], []
        old = b.column(at).to_pylist()
        for k, (text, gone) in enumerate(zip(texts, b.column("__gone").to_pylist(), strict=True)):
            lo, hi = bounds[k], bounds[k + 1]
            total.append(int(hi - lo))
            if not gone:
                removed.append(0), words.append(0), ranges.append(""), out.append(old[k])
                continue
            drop = np.zeros(hi - lo, dtype=bool)
            for x in gone:
                drop[x["i"] : x["i"] + x["n"]] = True
            edge = np.append(begin[lo:hi], len(text))
            edge[0] = 0 if drop.all() else edge[0]
            kept = [text[: edge[0]]] + [text[edge[j] : edge[j + 1]] for j in np.flatnonzero(~drop)]
            runs = np.flatnonzero(np.diff(np.concatenate(([False], drop, [False])).view(np.int8)))
            removed.append(int(drop.sum()))
            words.append(int(n_words[lo:hi][drop].sum()))
            ranges.append(",".join(f"{s}-{e}" for s, e in runs.reshape(-1, 2)))
            out.append(b"".join(kept).decode())
        if report:
            sha = [hashlib.sha256((x or "").encode()).hexdigest() for x in out]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(words, pa.int64()), pa.array(ranges, pa.string()), pa.array(sha, pa.string()), pa.array(out, pa.string())], names=["doc_id", "n_sentences", "n_removed", "n_removed_words", "removed", "kept_sha256", "text"])
        else:
            names = [x for x in b.schema.names if x not in ("__key", "__gone")]
            cols = [pa.array(out, pa.string()) if i == at else b.column(n) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def drop_spans(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """docs with the sentences of non-first repeated spans taken out of text.

    report: doc_id, n_sentences, n_removed, n_removed_words, removed (sentence ranges `start-end`), kept_sha256 and the text that stays.
    """
    docs, back = C.sheltered(docs)
    spans_ = repeated_spans(docs, min_words).groupBy(F.col("__id").alias("__i"), F.col("__key").alias("__k")).agg(F.collect_set(F.struct("i", "n")).alias("__gone"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) if report else docs
    keyed = own.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__key", F.xxhash64("__id", F.col("text").cast("string")))
    at = own.columns.index("text")
    joined = keyed.join(spans_, (keyed["__key"] == spans_["__k"]) & keyed["__id"].eqNullSafe(spans_["__i"]), "left").drop("__k", "__i", "__id")
    schema = "doc_id long, n_sentences long, n_removed long, n_removed_words long, removed string, kept_sha256 string, text string" if report else docs.schema
    return back(joined.mapInArrow(lambda it: _rebuilt(it, report, at), schema))
