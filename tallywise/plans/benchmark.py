"""End-to-end plans: score a generation table, report on raters, pool runs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.functions.extraction import extract_structured
from tallywise.functions.model_ids import bits_per_param, n_params, result_scheme, vram_gb
from tallywise.functions.prompts import ChatTemplate, PromptConfig, build_messages, render_prompt
from tallywise.operators.agreement import rater_cells
from tallywise.operators.bootstrap import bootstrap_ci, bootstrap_halfwidth
from tallywise.operators.generate import backend_answers
from tallywise.operators.pooling import pooled_long, wide_to_votes
from tallywise.operators.scoring import cells, metrics_by_mode, rater_metrics
from tallywise.operators.scratch import scratch_path
from tallywise.operators.significance import (
    comparison_plan,
    icc_consistency,
    icc_interval,
    paired_t,
    verdicts,
    wilcoxon,
)
from tallywise.streaming.resume import run_resumable


def predicted_votes(generations: DataFrame, by: Sequence[str] = (), text_col: str = "output_text") -> DataFrame:
    """Generations to votes: the extracted score of every answer as ``pred``."""
    records = extract_structured(generations, text_col, "PatientInfoSchema")
    return records.select(*by, "row_id", "run_idx", "label", F.col("record.mRS").alias("pred"))


def score_generations(generations: DataFrame, n_runs: int, by: Sequence[str] = ()) -> DataFrame:
    """Error rate and distance of every pooling mode, from raw answers in one plan."""
    return metrics_by_mode(predicted_votes(generations, by), n_runs, by)


def rescore_results(results: DataFrame, id_col: str = "row_id", field: str = "mRS") -> DataFrame:
    """Scores of a saved wide result table, one prediction column per run, without generating anything again."""
    runs = [c for c in results.columns if re.fullmatch(rf"{field}_\d+", c)]
    votes = wide_to_votes(results, [id_col, "label"], f"{field}_")
    return metrics_by_mode(votes.withColumn("pred", F.col("pred").cast("int")), len(runs), id_col=id_col)


def benchmark_answers(
    letters: DataFrame,
    prompts: PromptConfig,
    backend: str,
    n_repeats: int,
    path: str,
    template: ChatTemplate = ChatTemplate(),
    schema_name: str = "PatientInfoSchema",
    chunks: int = 1,
    resume: bool = True,
    batch_rows: int | None = None,
    **settings,
) -> DataFrame:
    """Answers to all letters below ``path``: only letters without all their answers are asked again.

    A crash loses the chunk under way, or with ``batch_rows`` only the batches of about that many letters under way.
    """
    if batch_rows and settings.get("partitions"):
        raise ValueError("give batch_rows or partitions: with batches, the number of letters makes the number of tasks")
    thinking = prompts.enable_thinking
    prompted = render_prompt(build_messages(letters, prompts), template, enable_thinking=thinking)

    def ask(part: DataFrame) -> DataFrame:
        return backend_answers(part, backend, n_repeats, schema_name, thinking, id_cols=("row_id", "label"), **settings)

    identity = ("row_id", "run_idx")
    return run_resumable(prompted, ask, path, "row_id", identity, n_repeats, chunks, resume, batch_rows)


def run_benchmark(
    letters: DataFrame, prompts: PromptConfig, backend: str, n_repeats: int, path: str | None = None, **settings
) -> DataFrame:
    """Letters to scores: prompts, answers, extraction, pooling, metrics.

    Below ``path`` stand the answers (a run that stopped goes on with what is missing) and the scores of the last call.
    ``settings`` go to ``benchmark_answers``, and from there to the generator: ``partitions`` sets how many tasks ask.
    """
    path = path or scratch_path(letters.sparkSession, "benchmark")
    answers = benchmark_answers(letters, prompts, backend, n_repeats, f"{path}/answers", **settings)
    scores = score_generations(answers, n_repeats)
    scores.write.mode("overwrite").parquet(f"{path}/scores")
    return letters.sparkSession.read.parquet(f"{path}/scores")


def run_log(answers: DataFrame, run: str, id_col: str = "row_id") -> DataFrame:
    """What a run's answers cost, as ``run_cost`` reads it: samples and seconds per sample; memory is not known here."""
    prompts = answers.groupBy(id_col).agg(F.max("seconds").alias("seconds"))
    return prompts.agg(F.count(F.lit(1)).alias("n_samples"), F.avg("seconds").alias("time_per_sample")).select(
        F.lit(run).alias("run"), "n_samples", "time_per_sample", F.lit(None).cast("double").alias("memory_gb")
    )


def pooled_cells(votes: DataFrame, n_runs: int, by: Sequence[str] = ()) -> DataFrame:
    """Cells of label against prediction per pooling mode, from one pass; a missing label or outcome counts as -1."""
    known = votes.withColumn("label", F.coalesce("label", F.lit(-1)))
    pooled = pooled_long(known, n_runs, [*by, "row_id"]).withColumn("pred", F.coalesce("pred", F.lit(-1)))
    return cells(pooled, "label", "pred", [*by, "mode"], weight="weight")


def run_characteristics(model_id: Column, scheme: Column, *known_params: Column) -> dict[str, Column]:
    """Size columns of a run as they go into a metric file."""
    params, bits = n_params(model_id, *known_params), bits_per_param(model_id, result_scheme(model_id, scheme))
    return {"nparams": params / 1e9, "nbits": bits.cast("double"), "vram": vram_gb(params, bits)}


def run_intervals(
    votes: DataFrame, n_runs: int, by: Sequence[str], metric: str = "error", replicates: int = 1000
) -> DataFrame:
    """Bootstrap distances of a metric per run and pooling mode."""
    return bootstrap_halfwidth(pooled_cells(votes, n_runs, by), metric, [*by, "mode"], replicates)


def rater_report(df: DataFrame, expert: str, raters: Sequence[str], replicates: int = 1000) -> DataFrame:
    """Kappa, errors, accuracies and ICC of every rater with 95% intervals, as numbers and as text.

    The data are counted once; estimates, intervals and ICC all read the cells.
    """
    counted = rater_cells(df, expert, raters)
    names = ["qwk", "mae", "exact_acc", "tol1_acc"]
    intervals = bootstrap_ci(counted, names, ["rater"], replicates)
    wide = intervals.groupBy("rater").agg(
        F.max("n").alias("n"),
        *[
            F.max(F.when(F.col("metric") == m, F.col(source))).alias(f"{m}{suffix}")
            for m in names
            for source, suffix in (("estimate", ""), ("lower", "_lower"), ("upper", "_upper"))
        ],
    )
    icc = icc_interval(icc_consistency(counted)).select(
        "rater", "icc", F.col("lower").alias("icc_lower"), F.col("upper").alias("icc_upper")
    )
    out = wide.join(icc, "rater")
    for m in [*names, "icc"]:
        out = out.withColumn(
            f"{m}_text", F.format_string("%.3f [%.3f-%.3f]", F.col(m), F.col(f"{m}_lower"), F.col(f"{m}_upper"))
        )
    return out


def significance_report(df: DataFrame, expert: str, model: str, competitors: Sequence[str]) -> DataFrame:
    """Signed rank and paired t tests of the planned comparisons with verdicts, from one counting pass."""
    comparisons: Mapping[str, tuple[str, str]] = comparison_plan(df.columns, model, competitors)
    rows = []
    for name, (a, b) in comparisons.items():
        d = F.abs(F.col(a) - F.col(expert)) - F.abs(F.col(b) - F.col(expert))
        rows.append(("d", name, d, F.lit(0)))
    rows += [("cell", rater, F.col(expert), F.col(rater)) for rater in (model, *competitors)]
    rows = [
        F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), u.cast("int").alias("u"), v.cast("int").alias("v"))
        for kind, name, u, v in rows
    ]
    # one table of counts for both: per task at most as many rows as comparisons and raters have different values
    counted = df.select(F.inline(F.array(*rows))).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    counted = counted.groupBy("kind", "name", "u", "v").agg(F.count("*").alias("n"))
    differences = counted.where(F.col("kind") == "d").select(F.col("name").alias("comparison"), F.col("u").alias("d"), "n")
    by_rater = counted.where(F.col("kind") == "cell").select(
        F.col("name").alias("rater"), F.col("u").alias("y"), F.col("v").alias("p"), "n"
    )
    ranks = wilcoxon(differences).select("comparison", "p_value", "rbc")
    tests = ranks.join(paired_t(differences).select("comparison", "bf10"), "comparison")
    return verdicts(tests, rater_metrics(by_rater).select("rater", "mae"), comparisons)
