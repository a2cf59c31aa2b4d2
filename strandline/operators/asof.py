"""As-of joins: each left row with the last right row at or before it, by one union and one window, without pairing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], strict: bool = False, tie: str | None = None) -> DataFrame:
    """left with the columns of the last right row of the same `by` whose `on` is not above left's (strict: is below it).

    Both sides are put in one order for each key and the last right row is carried forward, so the cost is one sort, whatever
    the number of right rows in a key. Rows without an earlier right row, with a null `on` or a null key have nulls. Of right
    rows with the same `on` the one with the largest `tie` counts (else any). Right's columns other than `by` keep their names
    if left has none of the same name, else they get the suffix `_right`.
    """
    mine = [c for c in right.columns if c not in by]
    names = {c: f"{c}_right" if c in left.columns else c for c in mine}
    held = F.struct(*[F.col(c).alias(names[c]) for c in mine])
    empty = F.lit(None).cast(right.select(held.alias("r")).schema["r"].dataType)
    order = F.col(tie) if tie else F.lit(0)
    kind = right.select(order.alias("t")).schema["t"].dataType
    a = left.select(F.struct(*left.columns).alias("__l"), *by, F.col(on).alias("__on"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(kind).alias("__tie"), empty.alias("__r"))
    none = F.lit(None).cast(a.schema["__l"].dataType)
    b = right.where(F.col(on).isNotNull()).select(none.alias("__l"), *by, F.col(on).alias("__on"), F.lit(1 if strict else 0).alias("__side"), order.alias("__tie"), held.alias("__r"))
    both = a.unionByName(b)
    w = Window.partitionBy(*by).orderBy("__on", "__side", F.asc_nulls_first("__tie")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("__on").isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    last = both.withColumn("__r", F.when(known, F.last("__r", ignorenulls=True).over(w))).where(F.col("__l").isNotNull())
    return last.select("__l.*", *[F.col(f"__r.{names[c]}").alias(names[c]) for c in mine])
