"""The corpus pipeline: five stages, each over all that the one before kept, written as Parquet in between.

The mix repeats documents and may take runs of their words only, so the packing stage has a row for each piece of each such
text, under the document's id. Documents whose text has no word (empty, or emptied by line dedup) have nothing to mix and end
there.

run() writes its result and then deletes all its other tables, so results of several runs stand beside each other. A stage that
is called by itself deletes the working tables of the last call of the stage before it in the same session: its docs are what
that call returned, written and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import common, stages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_STEPS: list[tuple[str, Stage]] = [
    ("language_id", stages.language),
    ("line_dedup", stages.lines),
    ("near_dedup", stages.near),
    ("mixing", stages.mix),
    ("packing", stages.pack),
]

_working: WeakKeyDictionary[SparkSession, dict[int, list[str]]] = WeakKeyDictionary()


def _alone(k: int, stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tables = _working.setdefault(spark, {})
        common.release(spark, tables.pop(k - 1, []))
        with common.tables_made() as made:
            out = stage(spark, docs, sf_dir)
        tables[k] = made
        return out

    run_stage.__doc__ = stage.__doc__
    return run_stage


STAGES: list[tuple[str, Stage]] = [(name, _alone(k, stage)) for k, (name, stage) in enumerate(_STEPS)]

#: SQL has no form for the profiles, signatures, draws and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.read(spark, sf_dir, "documents"), []
    for name, stage in _STEPS:
        with common.tables_made() as working:
            out = stage(spark, docs, sf_dir)
        with common.tables_made() as written:
            docs = common.materialize(out, f"pipeline-{name}")
        common.release(spark, working + before)
        before = written
    return docs
