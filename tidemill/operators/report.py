"""Analytics of benchmark runs: processor use, comparisons of runs, orders and Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cpu_cores(start: DataFrame, end: DataFrame, seconds: Column) -> DataFrame:
    """Average cores of every container that both samples (name, cpu_s) have."""
    both = start.select("name", F.col("cpu_s").alias("s")).join(end.select("name", F.col("cpu_s").alias("e")), "name")
    return both.select("name", ((F.col("e") - F.col("s")) / seconds).alias("cores"))


def cpu_total(cores: DataFrame) -> DataFrame:
    return cores.agg(F.coalesce(F.sum("cores"), F.lit(0.0)).alias("cores_total"))


def top_cpu(runs: DataFrame, n: int = 3) -> DataFrame:
    """The n containers with the most cores of each run, as one text. runs: run, name, cores."""
    nth = F.row_number().over(W.partitionBy("run").orderBy(F.desc("cores"), "name"))
    rows = runs.withColumn("nth", nth).where(F.col("nth") <= n)
    return rows.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.format_string("%s %.2f", "name", "cores").alias("t")))), lambda x: x["t"]), ", ").alias("top"))


def before_after(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Runs (by file name) that both sides have, with both sides' columns."""
    side = lambda d, name: d.select("file", *[F.col(c).alias(f"{name}_{c}") for c in columns])
    return side(before, "before").join(side(after, "after"), "file")


def by_rate(runs: DataFrame) -> DataFrame:
    """Throughput runs in the order of a report."""
    return runs.orderBy("offered_rate_eps", "file")


def by_store(runs: DataFrame) -> DataFrame:
    """Replays: those on several nodes first, then by rate."""
    return runs.orderBy(F.col("file").contains("1node"), "offered_rate_eps")


def by_mode(runs: DataFrame) -> DataFrame:
    """Serving runs by mode, batch and rate."""
    return runs.orderBy("mode", "batch", "rate_rps")


def markdown(rows: DataFrame, path: str, title: str = "") -> str:
    """A report's table as Markdown, written to one file by Spark and returned. A report has few rows; they come to the driver in their order."""
    from pyspark.sql.types import DoubleType, FloatType

    decimal = {f.name for f in rows.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    text = lambda c, v: "-" if v is None else f"{v:.2f}" if c in decimal else str(v)
    lines = [f"# {title}", ""] if title else []
    lines += ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join(text(c, r[c]) for c in rows.columns) + " |" for r in rows.toLocalIterator()]
    spark = rows.sparkSession
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return "\n".join(lines)


def fault_lines(lines: DataFrame, start_ms: int | Column) -> DataFrame:
    """Faults of an event log: lines `<unix ms> FAULT <name ...>` of three tokens or more; others are ignored."""
    token = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.select("line", token.alias("t")).where((F.size("t") >= 3) & (F.get("t", F.lit(1)) == "FAULT"))
    at = (F.coalesce(F.get("t", F.lit(0)).try_cast("long"), F.lit(0)) - start_ms) / 1000
    return rows.select(F.array_join(F.slice("t", 3, 1 << 30), " ").alias("fault"), at.alias("at_s"))


def check_totals(windows: DataFrame) -> DataFrame:
    """Operations over the windows whose check was conclusive, and whether any was illegal. windows: ops, result (ok, illegal, unknown)."""
    return windows.agg(F.coalesce(F.sum(F.when(F.col("result") == "ok", F.col("ops"))), F.lit(0)).alias("ops_ok"), F.coalesce(F.bool_or(F.col("result") == "illegal"), F.lit(False)).alias("illegal"))
