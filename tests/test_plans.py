"""What the physical plans must and must not hold."""

import re

import pytest

from tallywise.plans import catalog

PYTHON_ALLOWED = {
    "generate_stub", "benchmark_run", "custom_metric", "wilcoxon", "wilcoxon_exact", "paired_t", "verdicts", "bootstrap_cells",
    "bootstrap_broad_classes", "bootstrap_halfwidth", "bootstrap_inter_rater", "rater_report", "lme_fit",
    "bootstrap_cells_estimates", "bootstrap_inter_rater_estimates", "rater_report_estimates",
}
# these build their input by running jobs before they return a plan
EAGER = {"stream_extract", "resumable_run", "salvage_csv", "scan_letters", "encrypt_roundtrip", "write_read_results",
         "metrics_json_roundtrip", "pool_run_files", "pool_run_intervals", "prediction_arrays", "prepare_letters", "benchmark_run", "rescore_results",
         "salvaged_lines", "benchmark_resumed", "benchmark_log", "resume_attempts", "resume_batches",
         "render_conversations", "conversation_prompts", "sealed_letters", "consensus_file", "report_file", "shuffled_letters"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, sf):
    return {name: plan_of(query(spark, sf)) for name, query in catalog.QUERIES.items() if name not in EAGER}


def test_no_cross_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_python_only_in_user_code_and_final_steps(plans):
    for name, plan in plans.items():
        if re.search(r"Python|Pandas|ArrowEval", plan):
            assert name in PYTHON_ALLOWED, name


def test_python_sees_only_aggregated_rows(plans):
    for name in PYTHON_ALLOWED - EAGER - {"generate_stub"}:
        plan = plans[name]
        python = re.search(r"Python|Pandas|ArrowEval", plan).start()
        assert "HashAggregate" in plan[python:], name


def test_windows_are_partitioned(plans):
    for name, plan in plans.items():
        for window in re.findall(r"windowspecdefinition\(([^\n]*?)(?:ASC|specifiedwindowframe)", plan):
            assert re.match(r"\w+#\d+", window), (name, window)


def test_sample_limits_before_the_shuffle(plans):
    plan = plans["balanced_sample"]
    exchange = plan.index("Exchange")
    assert "WindowGroupLimit" in plan[exchange:], plan


def test_counts_combine_before_the_shuffle(plans):
    for name in ("rater_metrics", "metrics_by_mode", "confusion_matrix", "length_stats", "error_distance", "lme_suffstats"):
        # a plan prints from the result down: what feeds a shuffle stands in the line below it
        fed = re.findall(r"Exchange (?:hashpartitioning|SinglePartition)[^\n]*\n([^\n]*)", plans[name])
        assert any("partial_" in line for line in fed), name


@pytest.mark.parametrize(
    "name, source",
    [(n, "lineitem") for n in ("rater_metrics", "qwk_gap", "error_histogram", "inter_rater", "verdicts", "rater_report", "broad_class_metrics")]
    + [(n, "documents") for n in ("confusion_matrix", "bootstrap_halfwidth", "metrics_by_mode", "score_generations")],
)
def test_data_are_scanned_once(spark, sf, name, source):
    df = catalog.QUERIES[name](spark, sf)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert len(re.findall(rf"FileScan parquet.*{source}\.parquet", final)) == 1


def test_scans_read_only_the_needed_columns(plans):
    for name in ("error_distance", "metrics_by_mode", "pool_majority_5", "balanced_sample"):
        for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plans[name]):
            assert "text" not in schema, (name, schema)
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plans["length_histogram"])
    assert any("text:string" in r for r in read) and not any("lang" in r or "source" in r for r in read)


def test_many_raters_are_counted_after_the_layout(spark):
    from pyspark.sql import functions as F

    from tallywise.operators import agreement, significance

    raters = [f"r{i}" for i in range(40)]
    scores = [((F.hash("id", F.lit(r)) % 7 + 7) % 7).alias(r) for r in raters]
    df = spark.range(0, 4000, 1, 2).select((F.col("id") % 7).cast("int").alias("expert"), *scores)
    for counted, keys in (
        (agreement.rater_cells(df, "expert", raters), "rater"),
        (agreement.broad_class_cells(df, "expert", raters), "rater"),
        (significance.error_differences(df, "expert", {"c": ("r0", "r1")}), "comparison"),
    ):
        plan = plan_of(counted)
        assert plan.count("Exchange") == 1 and re.search(rf"Exchange hashpartitioning\({keys}#", plan)
        assert plan.index("partial_") > plan.index("Exchange") and plan.index("Generate") > plan.index("partial_")
    cells = agreement.rater_cells(df, "expert", raters)
    assert cells.count() <= 40 * 49 and cells.agg(F.sum("n")).first()[0] == 4000 * 40
