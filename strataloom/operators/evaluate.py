"""Evaluation of retrieval: latest runs, summaries, metrics, quality-gated comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GATE = 0.95


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run per (case_key, run_kind, mode); of equal times the first stays."""
    place = F.row_number().over(Window.partitionBy("case_key", "run_kind", "mode").orderBy(F.desc("created_at"), "seq"))
    return runs.withColumn("_p", place).filter("_p = 1").drop("_p")


def summary(runs: DataFrame) -> DataFrame:
    """Per (run_kind, mode): cases, means of tokens, recall, input_tokens, output_tokens and duration_ms over the runs that have them, and the share of successes among runs whose success is known."""
    return runs.groupBy("run_kind", "mode").agg(*[F.avg(c).alias(f"avg_{c}") for c in ("input_tokens", "output_tokens", "duration_ms") if c in runs.columns], F.count(F.lit(1)).alias("cases"), F.avg("tokens").alias("avg_tokens"), F.avg("recall").alias("avg_recall"), F.avg(F.col("success").cast("double")).alias("success_rate"))


def metric_means(runs: DataFrame) -> DataFrame:
    """(run_kind, mode, metric, mean) over the metrics map."""
    return runs.select("run_kind", "mode", F.explode("metrics").alias("metric", "value")).groupBy("run_kind", "mode", "metric").agg(F.avg("value").alias("mean"))


def retrieval_counts(rows: DataFrame, total_files: Column, total_bytes: Column, chars_per_token: float = 4.0) -> DataFrame:
    """Metrics per case from rows(case_key, path, expected, candidate, size), counted without holding a case's files in one row."""
    once = rows.groupBy("case_key", "path").agg(F.bool_or("expected").alias("e"), F.bool_or("candidate").alias("c"), F.max("size").alias("size"))
    sums = once.groupBy("case_key").agg(F.count_if(F.col("e") & F.col("c")).alias("hits"), F.count_if("e").alias("m"), F.count_if("c").alias("n"), F.coalesce(F.sum(F.when(F.col("c"), F.col("size"))), F.lit(0)).alias("b"))
    n, m, hits = F.col("n"), F.col("m"), F.col("hits")
    tokens = lambda b: F.ceil(b / F.lit(max(chars_per_token, 0.1)))
    return sums.select(
        "case_key", "hits", (m - hits).alias("missing"), (n - hits).alias("unexpected"), F.when(n > 0, hits / n).otherwise(0.0).alias("precision"), F.when(m > 0, hits / m).otherwise(1.0).alias("recall"),
        F.when(total_files > 0, 1 - n / total_files).otherwise(0.0).alias("candidate_reduction"), tokens(F.col("b")).alias("context_tokens"), F.when(total_bytes > 0, 1 - tokens(F.col("b")) / tokens(total_bytes)).otherwise(0.0).alias("token_reduction"),
    )


def compare(runs: DataFrame, baseline: str, routed: str, observed: bool) -> DataFrame:
    """One row: pairs, eligible pairs, reduction as a ratio of sums over eligible pairs, mean recalls over all pairs.

    Both sides need a recall of ``GATE``; observed runs also need a known success on both.
    """
    a = runs.filter(F.col("mode") == baseline).select("case_key", F.col("tokens").alias("before"), F.col("recall").alias("recall_a"), F.col("success").alias("ok_a"))
    b = runs.filter(F.col("mode") == routed).select("case_key", F.col("tokens").alias("after"), F.col("recall").alias("recall_b"), F.col("success").alias("ok_b"))
    gate = (F.col("recall_a") >= GATE) & (F.col("recall_b") >= GATE)
    if observed:
        gate = gate & F.col("ok_a").eqNullSafe(True) & F.col("ok_b").eqNullSafe(True)
    gate = F.coalesce(gate, F.lit(False))
    before, after = F.sum(F.when(gate, F.col("before"))), F.sum(F.when(gate, F.col("after")))
    return a.join(b, "case_key").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(gate).alias("eligible"), F.when(before > 0, 1 - after / before).alias("reduction"), F.avg("recall_a").alias("recall_before"), F.avg("recall_b").alias("recall_after"))
