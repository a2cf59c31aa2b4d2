"""Operator 4: mixing sources to target weights, by fixed-length blocks and permuted block indexes.

The documents of a source, in a fixed order, are one stream of words cut into blocks of `block` words. The mix is written as
shards of `shard_slots` slots, a block each. Every shard draws how many slots each source gets from a multinomial whose
weights are what the targets still lack, up to and with this shard, after the draws before it. So the draws decide the counts,
and what a source takes is near its target, not equal to it: off by about one shard's draw for each `RUN` shards. A source's
slots are numbered through all shards, and slot t maps to block perm(t mod n) of its n blocks, with another pseudorandom
permutation each time round. Slots beyond `most` times n map to nothing (their shard comes out short by them), so no block is
used more often than `most` times. Uses and blocks join by (source, index).

Shards are drawn in runs of `RUN`, each run by one seeded generator in a task. The driver holds a row for each source; sources
are taken to be few beside documents, and shards have a slot for each source at least. Positions in a stream come from sums by
bucket of documents, so a source with a third of all rows, or a third of rows without doc_id, is spread over many tasks.

Cases: null text has size 0, and such documents take nothing. A null source is a source of its own, last in order. Rows that
repeat count each for themselves. Null doc_ids keep their rows. An empty table gives an empty result. Columns of any other
name are carried through. Reruns agree, since all draws are seeded and the order is that of the rows' contents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BLOCK, MOST, SHARD_SLOTS, RUN, SEED = 64, 3, 256, 64, 20
BUCKET_ROWS = 10_000


def targets(sizes: dict[str | None, int], most: float = MOST, weights: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Shares of the sum of sizes by weights (dealt in turn, by code point, null last); what is over most times a source's size goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, list(order), float(sum(sizes.values()))
    while open_:
        share = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / share > most * sizes[s]]
        if not over:
            return {s: out[s] if s in out else left * weight[s] / share for s in order}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return {s: out[s] for s in order}


def shard_counts(quotas: np.ndarray, slots: np.ndarray, seed: int = SEED, run: int = 0) -> np.ndarray:
    """Slots of each source in each shard of a run, whose shards have these slots: multinomials by what each source still lacks of its share."""
    rng = np.random.default_rng([seed, run])
    share = quotas / quotas.sum()
    out = np.zeros((len(slots), len(quotas)), dtype=np.int64)
    for k, due in enumerate(np.cumsum(slots)):
        lack = np.maximum(share * due - out[:k].sum(axis=0), 0)
        out[k] = rng.multinomial(slots[k], lack / lack.sum())
    return out


def run_slots(run: int, total: int, shard_slots: int) -> np.ndarray:
    """Slots of each shard of a run; the last of all shards has what is left."""
    first = run * RUN * shard_slots
    return np.diff(np.append(np.arange(first, min(first + RUN * shard_slots, total), shard_slots), min(first + RUN * shard_slots, total)))


def permuted(t: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the places t: four Feistel rounds, walked until inside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = C.U64((1 << half) - 1)
    out, todo = t.astype(C.U64), np.arange(len(t))
    while len(todo):
        a, b = out[todo] >> C.U64(half), out[todo] & low
        for r in range(4):
            with np.errstate(over="ignore"):
                a, b = b, a ^ (C.mix(b + C.U64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)) & low)
        out[todo] = (a << C.U64(half)) | b
        todo = todo[out[todo] >= C.U64(n)]
    return out.astype(np.int64)


def _drawn(batches: Iterator[pa.RecordBatch], quotas: np.ndarray, total: int, shard_slots: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in batch.column("id").to_pylist():
            counts = shard_counts(quotas, run_slots(run, total, shard_slots), seed, run).sum(axis=0)
            s = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), run)), pa.array(s.astype(np.int32)), pa.array(counts[s])], names=["run", "s", "n"])


def _mapped(batches: Iterator[pa.RecordBatch], quotas: np.ndarray, total: int, shard_slots: int, blocks: list[int], most: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, firsts in zip(batch.column("run").to_pylist(), batch.column("firsts").to_pylist(), strict=True):
            counts = shard_counts(quotas, run_slots(run, total, shard_slots), seed, run)
            inside = np.cumsum(counts, axis=1) - counts  # a shard's slots go to the sources in order
            for x in firsts:
                source, n, each = x["s"], blocks[x["s"]], counts[:, x["s"]]
                t = x["first"] + np.arange(each.sum())
                shard = np.repeat(np.arange(len(each)), each)
                slot = inside[shard, source] + np.arange(len(t)) - (np.cumsum(each) - each)[shard]
                held = t < most * n
                t, shard, slot = t[held], shard[held] + run * RUN, slot[held]
                block = np.empty_like(t)
                for turn in np.unique(t // n):
                    own = t // n == turn
                    block[own] = permuted(t[own] % n, n, (seed * 1_000_003 + source) * 64 + int(turn))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(slot.astype(np.int32)), pa.array(np.full(len(t), source, dtype=np.int32)), pa.array(block)], names=["shard", "slot", "__s", "__b"])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("__text")
        size = [len(x.encode().split()) if x else 0 for x in b.column(at).to_pylist()]
        names = [n for n in b.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(size, pa.int64())], names=[*names, "__size"])


def mix_sources(docs: DataFrame, block: int = BLOCK, most: int = MOST, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, list]:
    """(rows, slots, sources): rows has __row, __size and the place __from in its source's stream; slots has (shard, slot, __s, __b).

    sources: (source, size, target) by index __s. A column __row of docs is taken over; the texts are not.
    """
    spark = docs.sparkSession
    C.bounded_batches(spark)
    text = F.col("text").cast("string")
    row = F.col("__row") if "__row" in docs.columns else F.monotonically_increasing_id()
    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("__h"), row.alias("__row"), text.alias("__text"))
    schema = own.drop("__text").schema.add("__size", "long")
    rows = C.materialize(own.mapInArrow(_sized, schema), "mix-rows")
    found = rows.groupBy("source").agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row a source
    sizes = {r["source"]: r["size"] for r in found}
    target = targets(sizes, most)
    sources = [(s, sizes[s], target[s]) for s in target]
    blocks = [max(1, -(-size // block)) for _, size, _ in sources]
    quotas = np.array([min(most * n, t * n / size) if size else 0.0 for (_, size, t), n in zip(sources, blocks, strict=True)], dtype=float)

    total, shard_slots = round(quotas.sum()), max(shard_slots, len(sources))
    runs = -(-total // (RUN * shard_slots))
    drawn = spark.range(0, runs, 1, max(1, min(runs, 200))).mapInArrow(lambda it: _drawn(it, quotas, total, shard_slots, seed), "run long, s int, n long")
    first = F.sum("n").over(Window.partitionBy("s").orderBy("run")) - F.col("n")
    firsts = drawn.withColumn("first", first).groupBy("run").agg(F.collect_list(F.struct("s", "first")).alias("firsts"))
    slots = firsts.mapInArrow(lambda it: _mapped(it, quotas, total, shard_slots, blocks, most, seed), "shard long, slot int, __s int, __b long")

    index = spark.createDataFrame([(s, i) for i, (s, _, _) in enumerate(sources)], "__source string, __s int")
    buckets = max(1, math.ceil(sum(r["n"] for r in found) / BUCKET_ROWS))
    rows = rows.join(index, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("__k", F.pmod(F.xxhash64("doc_id", "__h"), F.lit(buckets)))
    key = ["__s", "__k"]
    before = rows.groupBy(*key).agg(F.sum("__size").alias("__n")).withColumn("__before", F.sum("__n").over(Window.partitionBy("__s").orderBy("__k")) - F.col("__n")).drop("__n")
    inside = F.sum("__size").over(Window.partitionBy(*key).orderBy("doc_id", "__h", "__row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    placed = rows.withColumn("__in", inside).join(before, key).withColumn("__from", F.col("__before") + F.col("__in"))
    return placed.drop("__k", "__in", "__before", "__h"), slots, sources


def used(slots: DataFrame) -> DataFrame:
    """(__s, __b, __uses): how often the slots use each block."""
    return slots.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__uses"))


def taken_blocks(rows: DataFrame, uses: DataFrame, block: int = BLOCK) -> DataFrame:
    """uses, for each row whose text has words [__lo, __hi) in the used block, with its __row; joined by index.

    Blocks grow with the words, but Spark takes uses to be as small as the range of runs that they are made from, and would
    broadcast them; so the join is told to be between shuffles, as are those of its result, which is taken to be small too.
    """
    last = F.floor((F.col("__from") + F.col("__size") - 1) / block).cast("long")
    spans = rows.where("__size > 0").select("__row", "__s", "__from", "__size", F.explode(F.sequence(F.floor(F.col("__from") / block).cast("long"), last)).alias("__b"))
    joined = spans.join(uses.hint("merge"), ["__s", "__b"])
    lo = F.greatest(F.lit(0), F.col("__b") * block - F.col("__from"))
    hi = F.least(F.col("__size"), (F.col("__b") + 1) * block - F.col("__from"))
    return joined.select("__row", lo.alias("__lo"), hi.alias("__hi"), *[c for c in uses.columns if c != "__s"])


def mix_report(docs: DataFrame, block: int = BLOCK, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of each row."""
    rows, slots, sources = mix_sources(docs.select("doc_id", "source", "text"), block, most, seed)
    rows = C.materialize(rows, "mix-placed")
    took = taken_blocks(rows, used(slots), block).groupBy("__row").agg(F.sum((F.col("__hi") - F.col("__lo")) * F.col("__uses")).alias("taken"))
    stats = docs.sparkSession.createDataFrame([(i, n, t) for i, (_, n, t) in enumerate(sources)], "__s int, source_size long, target double")
    return rows.join(stats, "__s").join(took.hint("merge"), "__row", "left").select("doc_id", F.col("__size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _runs(spans: list[dict]) -> list[tuple[int, int]]:
    """Word ranges to write: for each time round, the longest runs of neighbouring blocks that are used so often."""
    spans = sorted(spans, key=lambda x: x["__lo"])
    out = []
    for turn in range(1, max(x["__uses"] for x in spans) + 1):
        run = None
        for x in [s for s in spans if s["__uses"] >= turn]:
            if run and run[1] == x["__lo"]:
                run[1] = x["__hi"]
            else:
                run = [x["__lo"], x["__hi"]]
                out.append(run)
    return [(a, b) for a, b in out]


def _written(batches: Iterator[pa.RecordBatch], names: list[str], by_slot: bool) -> Iterator[pa.RecordBatch]:
    import re

    word = re.compile(C.WORD)
    out_names = ["shard", "slot", *names] if by_slot else names
    for b in batches:
        out = []
        for row in b.to_pylist():
            spans, size = row["__spans"], row["__size"]
            places = None
            own = {k: row[k] for k in names}
            for x in spans if by_slot else [{"__lo": lo, "__hi": hi} for lo, hi in _runs(spans)]:
                new, lo, hi = dict(own), x["__lo"], x["__hi"]
                if by_slot:
                    new |= {"shard": x["shard"], "slot": x["slot"]}
                if (lo, hi) != (0, size):
                    places = places or [m.span() for m in word.finditer(row["text"])]
                    new["text"] = row["text"][places[lo][0] : places[hi - 1][1]]
                    if "n_chars" in new:
                        new["n_chars"] = len(new["text"])
                out.append(new)
        fields = [pa.field("shard", pa.int64()), pa.field("slot", pa.int32())] * by_slot + [b.schema.field(k) for k in names]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields)).select(out_names)


def _mixed(docs: DataFrame, block: int, most: int, seed: int, by_slot: bool) -> DataFrame:
    own, back = C.sheltered(docs)
    texts = C.materialize(own.withColumn("__row", F.monotonically_increasing_id()), "mix-texts")
    rows, slots, _ = mix_sources(texts.select("doc_id", "source", "text", "__row"), block, most, seed)
    rows = C.materialize(rows, "mix-placed")
    taken = taken_blocks(rows, slots if by_slot else used(slots), block)
    span = ["__lo", "__hi", "shard", "slot"] if by_slot else ["__lo", "__hi", "__uses"]
    spans = taken.groupBy("__row").agg(F.collect_list(F.struct(*span)).alias("__spans"))
    names, sized = own.columns, spans.hint("merge").join(rows.select("__row", "__size"), "__row")
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("slot", T.IntegerType())] * by_slot + own.schema.fields)
    return back(texts.join(sized.hint("merge"), "__row").mapInArrow(lambda it: _written(it, names, by_slot), schema))


def mixed_documents(docs: DataFrame, block: int = BLOCK, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix as rows of docs' columns: whole texts where all of a document's blocks are taken, else the runs of words taken; a row for each repeat."""
    return _mixed(docs, block, most, seed, False)


def mixed_shards(docs: DataFrame, block: int = BLOCK, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix as it is written: shard, slot and docs' columns, a row for each document that a slot's block has words of (text: these words)."""
    return _mixed(docs, block, most, seed, True)
