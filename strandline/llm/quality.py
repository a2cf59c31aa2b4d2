"""Operator 8: quality rules with risk-controlled thresholds, in DataFrame functions alone.

Each rule gives a document a score, the higher the worse, and has three cutoffs; a configuration sets each rule to one of them
or off. The labelled documents of good quality are the holdout. In each stratum (lang) and for each configuration, the null
hypothesis is that its rules together reject more than alpha of the stratum's good documents; the p-value is the exact binomial
tail P(X <= k) of the k rejected among n. Holm's step-down procedure over all strata and configurations keeps the chance of any
false pass at delta. So with probability 1 - delta every passing configuration of every stratum rejects at most alpha of the
good documents, and one may choose among them: the one taken has the largest share of bad labels rejected less the share of good
ones (of equal ones that with the laxest settings, then the first). Alpha is spent on all rules at once, not split among them.

alpha is 5 %, the loss of good text that fixed quality rules are commonly given, and little enough that the rules stay useful;
with four strata a stratum of some 220 good labels can then pass with none rejected (at 2 % it takes 560). A stratum with fewer
labels has no passing configuration, and its rules reject nothing.

Cases: null text has no words and fails the base. Null lang is a stratum of its own; so is a lang without labels, which no
rule rejects. Null doc_ids are never labelled. Repeated rows are judged one by one, repeated labels of a document count once.
Empty tables give an empty result (or no cutoffs). Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

ALPHA, DELTA = 0.05, 0.05
_GAP = r"[\x20\x09-\x0D]+"

#: Rule -> cutoffs from strict to lax; a document is rejected by a rule if its score is above the cutoff.
RULES: dict[str, tuple[float, float, float]] = {
    "symbols_a_word": (0.1, 0.3, 1.0),
    "capitals": (0.15, 0.3, 0.5),
    "dup_lines": (0.3, 0.5, 0.7),
    "repeats": (0.1, 0.2, 0.35),
    "word_length": (8.0, 10.0, 15.0),
}
#: Settings of a rule: 0 is off, 1 its laxest cutoff, 3 its strictest. A configuration is a number with a digit for each rule.
STEPS = 4
CONFIGURATIONS = STEPS ** len(RULES)


def repeat_words(words: str) -> str:
    """SQL: words of the array `words` in windows of three that occur twice or more, by one sort of the windows' hashes.

    Every array used more than once is bound by a lambda over array(x), so that it is evaluated once.
    """
    hashes = "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
    ordered = "sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))"
    places = "sort_array(filter(transform(s, (e, i) -> CASE WHEN (i > 0 AND s[i - 1].x = e.x) OR (i < size(s) - 1 AND s[i + 1].x = e.x) THEN e.i END), e -> e IS NOT NULL))"
    covered = "aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(3, coalesce(b - a, 3))), 0, (t, x) -> t + x)"
    some = f"transform(array({ordered}), s -> transform(array({places}), p -> {covered})[0])[0]"
    return f"transform(array({words}), w -> CASE WHEN size(w) < 4 THEN 0 ELSE transform(array({hashes}), h -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {some} END)[0] END)[0]"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base's counts and what the rules score, of each row, without a shuffle."""
    own = docs.select("doc_id", F.col("lang").cast("string").alias("stratum"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    trimmed = F.btrim("t", F.lit(C.WHITE))
    own = own.withColumn("trimmed", trimmed)
    words = f"CASE WHEN trimmed = '' THEN CAST(array() AS array<string>) ELSE split(trimmed, '{_GAP}') END".replace("\\", "\\\\")
    without = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    lines = "filter(split(t, '\\n'), x -> rlike(x, '[^\\\\x20\\\\x09-\\\\x0D]'))"
    return own.select(
        "doc_id",
        "stratum",
        F.expr(f"size({words})").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", _GAP, "")).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        F.expr(f"transform(array({lines}), l -> named_struct('n', size(l), 'd', size(l) - size(array_distinct(l))))[0]").alias("l"),
        F.expr(repeat_words(words)).cast("long").alias("n_repeat_words"),
        without(r"[A-Z]+").cast("long").alias("n_capitals"),
    ).select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", F.col("l.d").cast("long").alias("n_dup_lines"), F.col("l.n").cast("long").alias("n_lines"), "n_repeat_words", "n_capitals")


def scores() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {"symbols_a_word": share("n_symbols", "n_words"), "capitals": share("n_capitals", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words")}


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, taken back by the product; good to about 1e-13 for x >= 1."""
    y = x + 8
    back = F.log(x)
    for i in range(1, 8):
        back = back + F.log(x + i)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046728 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - back


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Binomial(n, p), exact to rounding: the term at k times the sum of ratios downwards.

    Terms further than 12 standard deviations below k do not change a double. 1 where k >= n p, which never passes a test.
    """
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.sequence(F.lit(0).cast("long"), F.least(k.cast("long"), (F.lit(12.0) * F.sqrt(n) + 60).cast("long")))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(steps, start, lambda a, j: F.struct((a["term"] * (k - j) * F.lit(1 - p) / ((n - k + j + 1) * F.lit(p))).alias("term"), (a["sum"] + a["term"]).alias("sum")), lambda a: a["sum"])
    return F.when(n <= 0, 1.0).when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def _digit(number: Column, rule: int) -> Column:
    return F.shiftright(number, 2 * rule).bitwiseAND(F.lit(STEPS - 1))


def tests(found: DataFrame, labels: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(name, none, config, n, k, bad, bad_k, p): for each stratum with good labels and configuration, the labelled and the rejected documents.

    Documents are first counted by how many cutoffs of each rule they are above, so what meets the configurations is a few rows a stratum.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    above = F.lit(0)
    for i, (name, cutoffs_) in enumerate(RULES.items()):
        above = above + sum((scores()[name] > c).cast("int") for c in cutoffs_) * STEPS**i
    held = found.join(known, "doc_id").select(F.coalesce("stratum", F.lit("")).alias("name"), F.col("stratum").isNull().alias("none"), above.alias("above"), (F.col("quality") == 1).alias("good"))
    by = held.groupBy("name", "none", "above").agg(F.count_if("good").alias("m"), F.count_if(~F.col("good")).alias("m_bad"))
    each = by.withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(CONFIGURATIONS - 1))))
    out = F.lit(False)
    for i in range(len(RULES)):
        out = out | (_digit(F.col("above"), i) + _digit(F.col("config"), i) >= STEPS)
    sums = each.groupBy("name", "none", "config").agg(F.sum("m").alias("n"), F.sum(F.when(out, F.col("m")).otherwise(0)).alias("k"), F.sum("m_bad").alias("bad"), F.sum(F.when(out, F.col("m_bad")).otherwise(0)).alias("bad_k"))
    return sums.where("n > 0").withColumn("p", binomial_tail(F.col("k").cast("double"), F.col("n").cast("double"), alpha))


def cutoffs(found: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each stratum with a passing configuration: the cutoff of each rule, null where the rule is off.

    Holm's order is over the tests, as many as strata times configurations, whatever the number of documents.
    """
    order = Window.orderBy("p", "name", "none", "config")
    ranked = tests(found, labels, alpha).withColumn("left", F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(order) + 1)
    passes = ranked.withColumn("ok", F.min((F.col("p") <= F.lit(delta) / F.col("left")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("ok = 1")
    strict = sum(_digit(F.col("config"), i) for i in range(len(RULES)))
    best = passes.groupBy("name", "none").agg(F.max_by("config", F.struct((F.col("bad_k") * F.col("n") - F.col("k") * F.col("bad")).alias("gain"), (-strict).alias("lax"), (-F.col("config")).alias("c"))).alias("config"))
    chosen = [F.when(_digit(F.col("config"), i) > 0, F.get(F.array(*map(F.lit, cutoffs_[::-1])), _digit(F.col("config"), i) - 1)).alias(name) for i, (name, cutoffs_) in enumerate(RULES.items())]
    return best.select("name", "none", *chosen)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, the base's four counts, base_failed and kept of each row."""
    found = C.materialize(features(docs), "quality-features")
    limits = cutoffs(found, labels, alpha, delta)
    joined = found.withColumns({"name": F.coalesce("stratum", F.lit("")), "none": F.col("stratum").isNull()}).join(limits, ["name", "none"], "left")
    rejected = F.lit(False)
    for name, score in scores().items():
        rejected = rejected | F.coalesce(score > F.col(name), F.lit(False))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))


def oracle(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The same in DuckDB SQL, by unnested words, windows, configurations and whole binomial sums."""
    share = {"symbols_a_word": ("n_symbols", "n_words"), "capitals": ("n_capitals", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
    score = {rule: f"coalesce(CAST({x} AS DOUBLE) / nullif({y}, 0), 0.0)" for rule, (x, y) in share.items()}
    above = " + ".join(f"CAST({score[rule]} > {c} AS INTEGER) * {STEPS**i}" for i, (rule, cs) in enumerate(RULES.items()) for c in cs)
    digit = lambda x, i: f"(({x} >> {2 * i}) & {STEPS - 1})"
    out = " OR ".join(f"{digit('above', i)} + {digit('config', i)} >= {STEPS}" for i in range(len(RULES)))
    strict = " + ".join(digit("config", i) for i in range(len(RULES)))
    rejected = " OR ".join(f"({score[rule]} > CASE {digit('config', i)} " + " ".join(f"WHEN {n} THEN {c}" for n, c in enumerate(cs[::-1], 1)) + " END)" for i, (rule, cs) in enumerate(RULES.items()))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, w[i:i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM dup, (VALUES (0), (1), (2)) AS o(j) GROUP BY r),
f AS MATERIALIZED (SELECT w.r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
      CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals FROM w LEFT JOIN cov ON cov.r = w.r),
known AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
by_above AS (SELECT coalesce(stratum, '') AS name, stratum IS NULL AS none, {above} AS above, q, count(*) AS m FROM f JOIN known USING (doc_id) GROUP BY ALL),
t AS (SELECT name, none, config, sum(CASE WHEN q = 1 THEN m ELSE 0 END) AS n, sum(CASE WHEN q = 1 AND ({out}) THEN m ELSE 0 END) AS k,
      sum(CASE WHEN q <> 1 THEN m ELSE 0 END) AS bad, sum(CASE WHEN q <> 1 AND ({out}) THEN m ELSE 0 END) AS bad_k
      FROM by_above, (SELECT unnest(range({CONFIGURATIONS})) AS config) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {alpha} THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha})))) END AS p FROM t WHERE n > 0),
holm AS (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY p, name, none, config) + 1 AS tests_left FROM p),
ok AS (SELECT *, bool_and(p <= {delta} / tests_left) OVER (ORDER BY p, name, none, config ROWS UNBOUNDED PRECEDING) AS ok FROM holm),
best AS (SELECT * FROM ok WHERE ok QUALIFY row_number() OVER (PARTITION BY name, none ORDER BY bad_k * n - k * bad DESC, {strict}, config) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce({rejected}, false) AS kept
FROM f LEFT JOIN best ON best.name = coalesce(stratum, '') AND best.none = (stratum IS NULL)
"""
