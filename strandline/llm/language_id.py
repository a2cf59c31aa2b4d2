"""Operator 6: language identification by rank-order profiles of character n-grams.

N-grams of one to three letters, with a mark for the ends of words, are counted over all training documents of a language;
the `top` most frequent make its profile, in order. A document's own most frequent n-grams are ranked likewise, and the
out-of-place distance sums how far each one's rank is from its rank in a profile (`top` where it is missing there). The
language with the least distance wins; the score is the margin to the second, (d2 - d1) / d2, from 0 to 1.

Training takes text and non-null lang of documents whose crc32(doc_id as text) mod 4 is not 2. Predictions use the text alone.
The driver holds `top` rows for each language. Letters are Unicode letters, lower-cased one by one.

Cases: null text, and text without a letter, is `und` with score 0; so is every text when there is nothing to learn from.
Ties between n-grams go by their letters' code points, ties between languages by name. A null doc_id counts as the empty text
in the split. Repeated rows are scored one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

TOP, FOLDS, HELD = 300, 4, 2
#: Share of a document's n-grams that its language's profile must know; below it the pipeline takes the text for no known language.
KNOWN = 0.1
_END = 1  # the mark for a word's end; a letter is its code point + 2


@cache
def letters() -> np.ndarray:
    """For each code point 0 if it is no letter, else its lower case + 2."""
    out = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = (ord(low) if len(low) == 1 else c) + 2
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, text index) of every n-gram of one to three marks; a key holds 21 bits for each."""
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for x in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) + 1 for c in codes])
    flat = np.zeros(len(owner) + 1, dtype=np.int64)
    at = 1
    table = letters()
    for c in codes:
        flat[at : at + len(c)] = table[c]
        at += len(c) + 1
    owner = np.concatenate((owner[:1], owner))
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
    marks, owner = flat[keep], owner[keep]
    marks = np.where(marks == 0, _END, marks)
    inner = marks != _END
    one = inner
    two = marks[:-1] + (marks[1:] << 21)
    three = two[:-1] + (marks[2:] << 42)
    right = owner[1:]
    own2 = np.where(inner[:-1], owner[:-1], right)
    is2 = inner[:-1] | inner[1:]
    is3 = inner[1:-1]
    return np.concatenate((marks[one], two[is2], three[is3])), np.concatenate((owner[one], own2[is2], owner[1:-1][is3]))


def held_out(doc_id: Column, folds: int = FOLDS, held: int = HELD) -> Column:
    return C.hash_id(doc_id) % folds == held


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[pd.DataFrame] = []

    def folded() -> pd.DataFrame:
        return pd.concat(found).groupby(["lang", "key"], as_index=False)["n"].sum()

    for b, texts in C.pieces(batches, mb=0.4):
        key, text = ngrams([x.decode() for x in texts])
        lang, names = pd.factorize(np.array(b.column("lang").to_pylist(), dtype=object))
        code, keys = pd.factorize(key)
        hit, n = np.unique(lang[text] * len(keys) + code, return_counts=True)
        found.append(pd.DataFrame({"lang": names[hit // max(1, len(keys))], "key": keys[hit % max(1, len(keys))], "n": n}))
        if sum(map(len, found)) > 400_000:
            found = [folded()]
    if found:
        out = folded()
        yield pa.RecordBatch.from_pandas(out, schema=pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())]), preserve_index=False)


def profiles(docs: DataFrame, top: int = TOP) -> dict[str, list[int]]:
    """The `top` n-grams of each language, most frequent first, over all of docs with text and lang."""
    C.bounded_batches(docs.sparkSession)
    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = own.mapInArrow(_counts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    out: dict[str, dict[int, int]] = {}
    for r in counts.withColumn("nth", nth).where(F.col("nth") <= top).collect():  # `top` rows a language
        out.setdefault(r["lang"], {})[r["nth"]] = r["key"]
    return {lang: [k for _, k in sorted(out[lang].items())] for lang in sorted(out)}


class Model:
    def __init__(self, by_lang: dict[str, list[int]], top: int = TOP):
        self.langs, self.top = sorted(by_lang), top
        self.keys = np.unique(np.array([k for x in by_lang.values() for k in x], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), top, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, np.array(by_lang[lang], dtype=np.int64))] = np.arange(len(by_lang[lang]))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and the share of the text's top n-grams that the language's profile holds."""
        n = len(texts)
        key, text = ngrams(texts)
        if not self.langs or not len(key):
            return ["und"] * n, [0.0] * n, [0.0] * n
        code, keys = pd.factorize(key, sort=True)
        hit, count = np.unique(text * len(keys) + code, return_counts=True)  # only pairs that occur, so no array of texts by n-grams
        doc, gram = hit // len(keys), hit % len(keys)
        order = np.lexsort((gram, -count, doc))
        doc, gram = doc[order], gram[order]
        rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(n))[doc]
        doc, gram, rank = (x[rank < self.top] for x in (doc, gram, rank))
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        slot = np.where(known, at, len(self.keys))[gram]
        held = np.bincount(doc, minlength=n)
        dist = np.empty((len(self.langs), n))
        share = np.empty((len(self.langs), n))
        for i in range(len(self.langs)):
            place = self.ranks[i, slot]
            dist[i] = np.bincount(doc, weights=np.where(place < self.top, np.abs(place - rank), self.top), minlength=n)
            share[i] = np.bincount(doc, weights=place < self.top, minlength=n) / np.maximum(held, 1)
        best = dist.argmin(axis=0)
        d1 = dist[best, np.arange(n)]
        others = np.partition(dist, 1, axis=0)[1] if len(self.langs) > 1 else held * float(self.top)
        score = np.where(others > 0, (others - d1) / np.maximum(others, 1e-9), 0.0).clip(0, 1)
        return ([self.langs[b] if h else "und" for b, h in zip(best, held, strict=True)], np.where(held > 0, score, 0.0).tolist(), share[best, np.arange(n)].tolist())


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b, texts in C.pieces(batches, mb=0.2):
        lang, score, _ = model.predict([x.decode() for x in texts])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def _accepted(batches: Iterator[pa.RecordBatch], model: Model, known: float) -> Iterator[pa.RecordBatch]:
    for b, texts in C.pieces(batches, mb=0.2):
        lang, _, share = model.predict([x.decode() for x in texts])
        yield b.filter(pa.array([x != "und" and s >= known for x, s in zip(lang, share, strict=True)]))


def trained(docs: DataFrame, top: int = TOP) -> Model:
    return Model(profiles(docs.where(~held_out(F.col("doc_id"))), top), top)


def identify(docs: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, by profiles learned from the rows that are not held out."""
    model = trained(docs, top)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return own.mapInArrow(lambda it: _predicted(it, model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, top: int = TOP, known: float = KNOWN) -> DataFrame:
    """docs without the rows whose text has no letter or whose n-grams are strange to every profile."""
    model = trained(docs, top)
    return docs.mapInArrow(lambda it: _accepted(it, model, known), docs.schema)


def oracle(top: int = TOP) -> str:
    """The same in DuckDB SQL: n-grams of padded words, ranks, and distances summed over joins.

    crc32 is not in SQL: the split is unrolled bit by bit over the decimal digits of doc_id.
    """
    step = lambda c: f"CASE WHEN ({c}) & 1 = 1 THEN xor(({c}) >> 1, 3988292384) ELSE ({c}) >> 1 END"
    chars = "list_transform(string_split(CAST(coalesce(CAST(doc_id AS VARCHAR), '') AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    byte = "list_reduce(list_prepend(xor(crc, b) & 255, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: " + step("c") + ")"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {chars}), lambda crc, b: xor(crc >> 8, {byte})), 4294967295)"
    code = lambda i: f"CASE substr(g, {i}, 1) WHEN '' THEN 0 WHEN '_' THEN 1 ELSE ord(substr(g, {i}, 1)) + 2 END::BIGINT"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, text, {crc} % {FOLDS} = {HELD} AS held_out FROM documents),
w AS (SELECT r, word, count(*) AS m FROM (SELECT r, concat('_', unnest(regexp_extract_all(lower(text), '\p{{L}}+')), '_') AS word FROM d) GROUP BY ALL),
g AS (SELECT r, substr(word, i, k) AS g, m FROM (SELECT r, word, m, k, unnest(range(1, length(word) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k)) WHERE substr(word, i, k) <> '_'),
f AS MATERIALIZED (SELECT r, key, sum(m) AS n FROM (SELECT r, m, {code(1)} + {code(2)} * 2097152 + {code(3)} * 4398046511104 AS key FROM g) GROUP BY ALL),
own AS (SELECT r, key, rk FROM (SELECT r, key, row_number() OVER (PARTITION BY r ORDER BY n DESC, key) - 1 AS rk FROM f) WHERE rk < {top}),
prof AS MATERIALIZED (SELECT lang, key, pk FROM (SELECT lang, key, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, key) - 1 AS pk FROM f JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, key) WHERE pk < {top}),
langs AS (SELECT DISTINCT lang FROM prof),
dist AS (SELECT own.r, langs.lang, CAST(sum(CASE WHEN pk IS NULL THEN {top} ELSE abs(pk - rk) END) AS DOUBLE) AS dist FROM own CROSS JOIN langs LEFT JOIN prof ON prof.lang = langs.lang AND prof.key = own.key GROUP BY ALL),
best AS (SELECT r, lang, dist, lead(dist) OVER (PARTITION BY r ORDER BY dist, lang) AS d2, row_number() OVER (PARTITION BY r ORDER BY dist, lang) AS nth FROM dist)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, CASE WHEN best.lang IS NULL OR d2 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (d2 - dist) / d2)) END AS score
FROM d LEFT JOIN best ON best.r = d.r AND nth = 1
"""
