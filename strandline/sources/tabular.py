"""Tables from CSV and JSON files, and benchmark results: a JSON document of runs, as rows and as a table by size and program."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The metrics of a run, by the column they get, and where the result format keeps them.
METRICS = {
    "wall": "wall_s",
    "cpu": "cpu_s",
    "ratio": "cpu_wall_ratio",
    "energy_used": "execution.energy_run_used",
    "energy_dur": "execution.energy.duration_s",
    "energy_j": "execution.energy.total_energy_j",
    "energy_w": "execution.energy.avg_total_power_w",
}
RESULTS = "struct<programs: array<string>, results: array<struct<records: double, size_mb: double, input_mb: double, program: string, wall_s: double, cpu_s: double, cpu_wall_ratio: double, execution: struct<energy_run_used: boolean, energy: struct<duration_s: double, total_energy_j: double, avg_total_power_w: double>>>>>"


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, header: bool = True, **options) -> DataFrame:
    """CSV files as a table; without a schema the types are inferred, which reads the files once more."""
    reader = spark.read.options(header=header, **options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str | list[str], schema: str | None = None, multi_line: bool = False, **options) -> DataFrame:
    """JSON files as a table: a document a line, or whole files (multi_line)."""
    reader = spark.read.options(multiLine=multi_line, **options)
    return (reader.schema(schema) if schema else reader).json(path)


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The runs of benchmark documents: size (records, or megabytes), input_mb, program, its place in the document, and the metrics."""
    own = spark.read.text(path, wholetext=True).select(F.from_json("value", RESULTS).alias("d")).select("d.programs", F.explode("d.results").alias("r"))
    metrics = [F.col(f"r.{at}").alias(name) for name, at in METRICS.items()]
    return own.select(F.coalesce("r.records", "r.size_mb").alias("size"), "r.input_mb", "r.program", F.array_position("programs", F.col("r.program")).alias("place"), *metrics)


def pivot_results(runs: DataFrame, programs: list[str]) -> DataFrame:
    """A row a size: input_mb, and of each program its metrics and whether it has the least wall time; sorted by size, nulls last.

    Runs that a size and program have more than once count once, the first of them by wall time.
    """
    first = Window.partitionBy("size", "program").orderBy(F.asc_nulls_last("wall"))
    once = runs.where(F.col("program").isin(programs)).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    best = once.withColumn("best", F.col("wall") == F.min("wall").over(Window.partitionBy("size")))
    cells = [F.first(c).alias(c) for c in (*METRICS, "best")]
    wide = best.groupBy("size").pivot("program", programs).agg(*cells, F.first("input_mb").alias("input_mb"))
    input_mb = F.coalesce(*[F.col(f"`{p}_input_mb`") for p in programs])
    columns = [F.coalesce(F.col(f"`{p}_{c}`"), F.lit(False)).alias(f"{p}_{c}") if c == "best" else F.col(f"`{p}_{c}`") for p in programs for c in (*METRICS, "best")]
    return wide.select("size", input_mb.alias("input_mb"), *columns).orderBy(F.asc_nulls_last("size"))
