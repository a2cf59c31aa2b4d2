"""Reads and sequences derived from the driver's tables by hashes, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The letters and qualities that the sixteen hexadecimal digits stand for.
_LETTERS, _QUALITIES = "ACGTACGTACGTACGT", "I5?+H0:A&,B8=3F<"


def _hashed(letters: str, tag: str, key: str = "k") -> str:
    return f"translate(md5(concat('{tag}', cast({key} as string))), '0123456789abcdef', '{letters}')"


def dna(tag: str, key: str = "k") -> str:
    return _hashed(_LETTERS, tag, key)


def qual(tag: str, key: str = "k") -> str:
    return _hashed(_QUALITIES, tag, key)


#: (k, seq1, qual1, seq2, qual2): overlaps of many sizes, mismatches, N, unrelated mates and outies.
PAIRS = f"""
WITH b AS (SELECT c_custkey AS k, cast(50 + c_custkey % 40 as int) AS n, cast(least(40 + c_custkey % 21, 50 + c_custkey % 40) as int) AS l FROM {{customer}}),
fr AS (SELECT k, n, l, substr(concat({dna("f")}, {dna("g")}, {dna("h")}), 1, n) AS s, concat({qual("p")}, {qual("q")}) AS qa,
       concat({qual("r")}, {qual("s")}) AS qb, concat({dna("z")}, {dna("y")}) AS z FROM b),
e AS (SELECT k, l, substr(s, 1, l) AS hd, substr(s, n - l + 1, l) AS tl, substr(qa, 1, l) AS q1, substr(qb, 1, l) AS q2, substr(z, 1, l) AS z FROM fr),
m AS (SELECT k, q1, q2, CASE WHEN k % 11 = 10 THEN tl ELSE hd END AS r1, CASE WHEN k % 10 = 9 THEN z WHEN k % 11 = 10 THEN hd ELSE tl END AS r2 FROM e),
m2 AS (SELECT k, q1, q2, CASE WHEN k % 7 = 0 THEN concat(substr(r1, 1, length(r1) - 6), 'N', substr(r1, length(r1) - 4)) ELSE r1 END AS seq1,
       CASE WHEN k % 3 = 0 THEN concat(substr(r2, 1, 9), translate(substr(r2, 10, 3), 'ACGT', 'CGTA'), substr(r2, 13)) ELSE r2 END AS r2 FROM m)
SELECT k, seq1, substr(q1, 1, length(seq1)) AS qual1, reverse(translate(r2, 'ACGTN', 'TGCAN')) AS seq2, substr(q2, 1, length(r2)) AS qual2 FROM m2
"""

#: Tags of all shapes for the pairs' k.
TAG = "concat('@r', cast(k as string), CASE cast(k % 6 as int) WHEN 0 THEN '/1' WHEN 1 THEN '/1#B' WHEN 2 THEN '/12#B' WHEN 3 THEN '/1/2 c' WHEN 4 THEN '' ELSE '/' END)"

#: (k, s): hashed bases around a repeat of one to six letters, some broken by N.
SEQS = f"""
SELECT k, concat({dna("a")}, repeat(substr({dna("u")}, 1, cast(k % 6 + 1 as int)), cast(4 + k % 9 as int)), CASE WHEN k % 5 = 0 THEN 'N' ELSE '' END, {dna("b")}) AS s
FROM (SELECT c_custkey AS k FROM {{customer}})
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """idx, tag1, seq1, qual1, tag2, seq2, qual2; on demand in order of idx, the keys sorted before the reads are made from them, by all cores."""
    keys = table(spark, sf_dir, "customer")
    if ordered:
        keys = keys.select("c_custkey").repartitionByRange(4 * spark.sparkContext.defaultParallelism, "c_custkey").sortWithinPartitions("c_custkey")
    made = spark.sql(PAIRS, customer=keys)
    return made.selectExpr("k AS idx", f"{TAG} AS tag1", "seq1", "qual1", f"{TAG} AS tag2", "seq2", "qual2")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, name, seq."""
    made = spark.sql(SEQS, customer=table(spark, sf_dir, "customer"))
    return made.selectExpr("k AS idx", "concat('s', cast(k as string)) AS name", "s AS seq")


def duck(sql: str) -> str:
    """The same SQL over DuckDB's table."""
    return sql.replace("{customer}", "customer")
